"""Answers of language models as fields: tolerant JSON, coercions, and labels for people. Column builders, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions import ids, text
from tallyweave.functions.spans import let

TEXTS, NUMBERS = ("vendor", "invoice_number", "tax_id", "po_number", "bank_account"), ("subtotal", "tax_amount", "total")


def answer_object(c: Column) -> Column:
    """The JSON object of an answer as map<string, string> of its values' texts: the whole answer without code fences, or what stands between
    its outermost braces; null if that is no object."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"(?m)^```(?:json)?|```$", ""))

    def read(t: Column) -> Column:
        whole = F.try_parse_json(t)
        inside = F.regexp_extract(t, r"(?s)\{.*\}", 0)
        found = F.when(whole.isNotNull(), F.when(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), t)).otherwise(F.when(F.try_parse_json(inside).isNotNull(), inside))
        return F.from_json(found, "map<string,string>")

    return let(bare, read)


def to_number(c: Column) -> Column:
    """A number as it stands, or as an amount is printed."""
    return F.coalesce(c.try_cast("double"), text.parse_amount(c))


def coerced(found: Column) -> Column:
    """struct of a reading's fields from the texts of answer_object. Empty values, lists and objects are missing; a currency is three letters; a date that
    isn't ISO is read as printed; line items are those that are objects. The answer is read once, not once a field."""
    return let(found, _coerced)


def _coerced(found: Column) -> Column:
    given = lambda k: F.nullif(F.trim(found[k]), F.lit(""))
    some = lambda k: F.when(~given(k).isin("[]", "{}"), given(k))
    money = F.upper(F.trim(found["currency"]))
    day = given("invoice_date")
    date = F.when(F.rlike(day, F.lit(r"^\d{4}-\d{2}-\d{2}$")), day.try_cast("date")).otherwise(text.parse_date(day))
    objects = F.array_compact(F.transform(F.from_json(found["line_items"], "array<string>"), lambda i: F.from_json(i, "map<string,string>")))
    items = F.transform(objects, lambda i: F.struct(F.coalesce(i["description"], F.lit("")).alias("description"), *(to_number(i[k]).alias(k) for k in ("quantity", "unit_price", "amount"))))
    whole = F.struct(
        *(some(k).alias(k) for k in TEXTS), date.alias("invoice_date"), F.when(F.rlike(money, F.lit("^[A-Z]{3}$")), money).alias("currency"), *(to_number(given(k)).alias(k) for k in NUMBERS), F.coalesce(items, F.array().cast("array<struct<description:string,quantity:double,unit_price:double,amount:double>>")).alias("line_items")
    )
    return F.when(found.isNotNull(), whole)


def label(invoice_id: Column, number: Column, vendor: Column, total: Column, currency: Column) -> Column:
    """How an invoice is called: by its number or else its id, its vendor, and its total."""
    name = F.when(~text.missing(number), F.concat(F.lit("invoice "), number)).otherwise(F.concat(F.lit("invoice #"), invoice_id.cast("string")))
    whose = F.when(~text.missing(vendor), vendor).otherwise("an unknown supplier")
    sum_ = F.when(total.isNotNull(), F.concat(F.lit(" ("), F.format_number(total, 2), F.when(text.missing(currency), "").otherwise(F.concat(F.lit(" "), currency)), F.lit(")"))).otherwise("")
    return F.concat(name, F.lit(" from "), whose, sum_)


def tax_check(tax_id: Column) -> Column:
    """struct(kind, value, valid) of a tax id; null without one."""
    return F.when(~text.missing(tax_id), ids.tax_id(tax_id))


def account_check(bank_account: Column) -> Column:
    """Whether an IBAN's checksum is right; null for other accounts, which have none, and for none."""
    number = ids.compact(F.substring_index(bank_account, "/", 1))
    return F.when(~text.missing(bank_account) & ids.looks_like_iban(number), ids.iban_valid(number))

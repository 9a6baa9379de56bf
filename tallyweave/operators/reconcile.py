"""Reconciling two readings of a document: grounding in its text, then field-wise merging.

A reading is a row beside the document's text, so a batch of any size is one projection after one join. Fields that a reading doesn't have are
left out everywhere. Only similarity of names is an Arrow function, and it is asked only where the names aren't there as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import fuzzy, spans, text
from tallyweave.operators.printed_names import Index

#: How far a number may be from a printed one; what counts as adding up; how alike a printed name must be, and one name to another.
NEAR, TOLERANCE, PRINTED, SAME, KNOWN = 0.006, 0.02, 85, 90, 85
#: What a scan's identifiers must have at least for look-alike characters to be overlooked.
FOLDED = 4
NUMBERS, IDENTIFIERS = ("subtotal", "tax_amount", "total"), ("invoice_number", "tax_id", "po_number", "bank_account")
TEXTS, KEYS = ("vendor", "invoice_number", "inv_date", "currency", "tax_id", "po_number", "bank_account"), ("vendor", "invoice_number", "inv_date", "total")


def _alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def numbers_in(c: Column) -> Column:
    """Every figure of a text, and those whose thousands are apart also in one."""
    plain = F.regexp_extract_all(c, F.lit(spans.FIGURE), F.lit(0))
    apart = F.regexp_extract_all(c, F.lit(r"(?<![\d.,])\d{1,3}(?:[   ]\d{3})+[.,]\d{1,2}(?!\d)"), F.lit(0))
    joined = F.transform(apart, lambda x: F.regexp_replace(x, "[   ]", ""))
    return F.array_compact(F.transform(F.concat(plain, joined), text.parse_amount))


def name_in(name: Column, document: Column) -> Column:
    """Whether some stretch of a document is similar to a name."""

    def run(names: pd.Series, documents: pd.Series) -> pd.Series:
        return pd.Series([bool(n) and bool(d) and bool(Index([n], PRINTED, 0).printed(d)) for n, d in zip(names, documents, strict=True)], dtype=bool)

    low = F.lower(name)
    page = F.lower(F.coalesce(document, F.lit("")))
    return F.contains(page, low) | F.when(~F.contains(page, low), F.pandas_udf(run, "boolean")(low, page)).otherwise(False)


def ground(readings: DataFrame) -> DataFrame:
    """Nulls every value that doc_text does not show, and lists the fields in dropped. Numbers must be printed within NEAR, whatever their sign;
    identifiers must occur as letters and digits in a row; dates in one of their readings; a vendor nearly so. A column ocr marks
    scans: there look-alike characters are overlooked in identifiers of FOLDED characters or more, and numbers and dates are looked for in the mended text too.
    Line items (a column line_items of structs with an amount) stay if their amount is printed or missing. Missing values are left alone."""
    has = readings.columns
    page = F.coalesce("doc_text", F.lit(""))
    scan = F.coalesce("ocr", F.lit(False)) if "ocr" in has else F.lit(False)
    mended = spans.fix_scanned_numbers(page)
    none = F.array().cast("array<double>")
    rows = readings.withColumns({
        "_numbers": F.concat(numbers_in(page), F.when(scan, numbers_in(mended)).otherwise(none)), "_flat": _alnum(page), "_folded": F.when(scan, text.ocr_fold(page)).otherwise(""),
    })
    printed = lambda v: F.exists("_numbers", lambda n: F.abs(F.abs(v) - F.abs(n)) < NEAR)
    shown = {n: printed(F.col(n)) for n in NUMBERS if n in has}
    for n in (i for i in IDENTIFIERS if i in has):
        value = F.substring_index(n, "/", 1) if n == "bank_account" else F.col(n)
        shown[n] = F.contains("_flat", _alnum(value)) | (scan & (F.length(_alnum(value)) >= FOLDED) & F.contains("_folded", text.ocr_fold(value)))
    if "inv_date" in has:
        shown["inv_date"] = F.array_contains(spans.all_dates(page), F.col("inv_date")) | (scan & F.array_contains(spans.all_dates(mended), F.col("inv_date")))
    if "vendor" in has:
        shown["vendor"] = name_in(F.col("vendor"), F.col("doc_text"))
    checks = rows.withColumns({f"_{n}_ok": ok for n, ok in shown.items()})
    gone = F.array_compact(F.array(*(F.when(~text.missing(F.col(n)) & ~F.coalesce(f"_{n}_ok", F.lit(False)), F.lit(n)) for n in shown)))
    out = checks.withColumn("dropped", gone)
    out = out.withColumns({n: F.when(~F.array_contains("dropped", n), F.col(n)) for n in shown})
    if "line_items" in has:
        out = out.withColumn("line_items", F.filter("line_items", lambda i: i["amount"].isNull() | printed(i["amount"])))
    return out.select(*has, "dropped")


def consistent(side: str) -> Column:
    """Whether a side's subtotal and tax add up to its total."""
    s, t, x = (F.col(f"{side}.{n}") for n in ("subtotal", "total", "tax_amount"))
    return F.coalesce(F.abs(s + x - t) <= TOLERANCE, F.lit(False))


def merge(pairs: DataFrame) -> DataFrame:
    """One reading of pairs (doc_id, rules struct, ai struct). The vendor comes from ai, unless trusted (the rules' vendor is on the list); other text
    from rules; either fills the other's gaps, but an invoice number that only ai read must stand at a label: be one of the column labelled, if there
    is one (look-alike characters aside on scans, ocr). Money comes from the side that adds up (rules first; rules too if neither does but they have a total), gaps
    from the other. Line items of ai stay only if they add up to the subtotal or the total. differs lists the fields on which the sides disagree."""
    given = pairs.schema["rules"].dataType.names
    has, false = pairs.columns, F.lit(False)
    trusted = F.coalesce("trusted", false) if "trusted" in has else false
    r, a = (lambda n: F.col(f"rules.{n}")), (lambda n: F.col(f"ai.{n}"))
    missing = lambda c: text.missing(c)
    either = lambda first, then: F.when(~missing(first), first).when(~missing(then), then)
    out = {n: either(r(n), a(n)) for n in TEXTS if n in given}
    if "vendor" in given:
        out["vendor"] = F.when(trusted, either(r("vendor"), a("vendor"))).otherwise(either(a("vendor"), r("vendor")))
    if "labelled" in has and "invoice_number" in given:
        scan = F.coalesce("ocr", false) if "ocr" in has else false
        fold = lambda c: F.when(scan, text.ocr_fold(c)).otherwise(_alnum(c))
        stands = F.exists(F.coalesce("labelled", F.array().cast("array<string>")), lambda c: fold(c) == fold(a("invoice_number")))
        out["invoice_number"] = F.when(missing(r("invoice_number")) & ~stands, None).otherwise(out["invoice_number"])
    by_rules = consistent("rules") | (~consistent("ai") & r("total").isNotNull()) | a("total").isNull()
    money = {n: F.when(by_rules, F.coalesce(r(n), a(n))).otherwise(F.coalesce(a(n), r(n))) for n in NUMBERS}
    unlike = lambda n: ~missing(r(n)) & ~missing(a(n)) & (F.lower(F.trim(r(n).cast("string"))) != F.lower(F.trim(a(n).cast("string"))))
    apart = {n: unlike(n) for n in TEXTS if n in given} | {n: F.abs(r(n) - a(n)) > TOLERANCE for n in NUMBERS}
    if "vendor" in given:
        same = F.when(unlike("vendor"), fuzzy.token_set_ratio(text.norm_vendor(r("vendor")), text.norm_vendor(a("vendor"))) >= SAME).otherwise(False)
        apart["vendor"] = unlike("vendor") & ~same
    differs = F.array_compact(F.array(*(F.when(F.coalesce(c, false), F.lit(n)) for n, c in apart.items())))
    done = pairs.select("doc_id", *(c.alias(n) for n, c in out.items()), *(c.alias(n) for n, c in money.items()), F.when(by_rules, "rules").otherwise("ai").alias("money_from"), differs.alias("differs"), "rules", "ai")
    if "line_items" in given:
        total = F.aggregate(F.transform(a("line_items"), lambda i: F.coalesce(i["amount"], F.lit(0.0))), F.lit(0.0), lambda x, y: x + y)
        adds_up = F.coalesce(F.abs(total - F.col("subtotal")) <= TOLERANCE, false) | F.coalesce(F.abs(total - F.col("total")) <= TOLERANCE, false)
        done = done.withColumn("line_items", F.when((F.size(a("line_items")) > 0) & adds_up, a("line_items")).otherwise(r("line_items")))
    return done.drop("rules", "ai")


def reasons_for_second_reading(readings: DataFrame) -> DataFrame:
    """doc_id and why a document should be read again: what is missing, a scan (ocr), figures that don't add up, a vendor that is not on the list
    (a column known, as matching.first_vendor finds it)."""
    has = readings.columns
    off = F.abs(F.col("subtotal") + F.col("tax_amount") - F.col("total")) > TOLERANCE
    parts = [F.when(text.missing(F.col(n)), F.lit(f"{n} is missing")) for n in KEYS if n in has]
    if "ocr" in has:
        parts.append(F.when(F.col("ocr"), F.lit("a scan")))
    parts.append(F.when(off, F.lit("figures don't add up")))
    if "known" in has:
        parts.append(F.when(~text.missing(F.col("vendor")) & text.missing(F.col("known")), F.lit("vendor is not on the list")))
    return readings.select("doc_id", F.array_compact(F.array(*parts)).alias("reasons"))

"""The seven checks of an invoice in full, and the recommendation, over invoices, vendors and orders with names as they were read.

One row an invoice throughout: what each check needs is joined to it as columns, by keys, and the checks are expressions over these; only the long form
and the reasons unpivot them. Names are compared once, as distinct normalised names (operators.matching); everything else joins on
names, numbers, dates, amounts in bands and accounts. What an earlier invoice says is an aggregate over groups of equal invoices (the
least id of a group is the earliest), so a busy vendor's invoices are never paired with each other.

Missing is null or ''. Of several earlier matches the one with the least id counts, as in a scan of the history in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import ids, text
from tallyweave.functions.fuzzy import ratio
from tallyweave.operators import matching
from tallyweave.operators.matching import similar_names
from tallyweave.operators.printed_names import Index, flat
from tallyweave.sources.shared import by_key, once

SAME, RECORD, ORDERED, NEAR = 80, 85, 70, 85
MONEY, SHARE, OVER = 0.02, 0.005, 1.02
#: The order of the checks, the one in which problems lead, and what the recommendation rests on.
CHECKS = ("completeness", "math", "duplicate", "vendor", "tax_id", "po_match", "bank")
LEAD = ("bank", "completeness", "vendor", "duplicate", "math", "po_match", "tax_id")
HARD, MUST, SURE = ("duplicate", "math", "vendor", "tax_id", "po_match", "bank"), ("completeness", "math", "duplicate", "vendor"), ("duplicate", "math", "bank")
LIMIT = 50_000.0
#: Names of one number, and invoices of a name in one band of amounts, that are simply paired; more are met by a way of their own.
FEW, CROWDED = 64, 64


def _result(status: Column, kind: Column, match: Column | None = None) -> Column:
    return F.struct(status.alias("status"), kind.cast("string").alias("kind"), (F.lit(None) if match is None else match).cast("long").alias("match_id"))


def _cases(*cases: tuple[Column | None, str, str | Column | None]) -> Column:
    """The first case that holds: (condition, status, kind); the last one has no condition."""
    status, kind = None, None
    for condition, s, k in cases:
        k = k if isinstance(k, Column) else F.lit(k)
        if condition is None:
            status, kind = status.otherwise(s), kind.otherwise(k)
            break
        condition = F.coalesce(condition, F.lit(False))
        status = F.when(condition, s) if status is None else status.when(condition, s)
        kind = F.when(condition, k) if kind is None else kind.when(condition, k)
    return _result(status, kind)


def completeness(waived: Column) -> Column:
    """A missing number or total fails, another key field warns; a number or date that accounts payable waived is no fault but is told."""
    gone = lambda c: text.missing(F.col(c))
    excused = {c: gone(c) & F.coalesce(F.array_contains(waived, c), F.lit(False)) for c in ("number", "inv_date")}
    return _cases(
        ((gone("number") & ~excused["number"]) | gone("total"), "fail", None), (gone("vendor") | (gone("inv_date") & ~excused["inv_date"]) | gone("currency"), "warn", None),
        (excused["number"] | excused["inv_date"], "warn", "waived"), (None, "pass", None),
    )


def arithmetic() -> Column:
    """Subtotal and tax make the total, or printed charges explain the gap; line items make the subtotal or the total. What doesn't add up on
    a scan may be misread and only warns."""
    total, sub, tax, items = (F.col(c) for c in ("total", "subtotal", "tax_amount", "line_sum"))
    gap = total - sub - tax
    stated = gap.isNotNull()
    explained = (F.abs(gap) <= MONEY) | text.explained(gap, text.charges(F.col("doc_text")))
    listed = items.isNotNull() & (sub.isNotNull() | total.isNotNull())
    fits = F.coalesce(F.abs(items - sub) <= MONEY, F.lit(False)) | F.coalesce(F.abs(items - total) <= MONEY, F.lit(False))
    wrong = (stated & ~explained) | (listed & ~fits)
    return _cases((total <= 0, "fail", "not_payable"), (wrong & F.coalesce("ocr", F.lit(False)), "warn", "scanned"), (wrong, "fail", None), (stated | listed, "pass", None), (None, "skip", None))


def near_numbers(left: DataFrame, right: DataFrame, on: list[str], cutoff: float) -> DataFrame:
    """Pairs of left (on, n, ...) and right (on, other, ...) that agree in `on` and whose numbers are similar but not the same. If d letters of both are in
    one only, one of d + 1 segments of the one stands whole in the other, moved by no more than d: pairs meet by these."""
    most = F.floor((F.length("n") + F.col("m")) * (1 - cutoff / 100) + 1e-9).cast("int")
    lengths = lambda c: F.explode(F.sequence(F.ceil(F.length(c) * (cutoff / (200 - cutoff)) - 1e-9).cast("int"), F.floor(F.length(c) * ((200 - cutoff) / cutoff) + 1e-9).cast("int")))
    mine = left.withColumn("m", lengths("n")).withColumn("k", most + 1).withColumn("i", F.explode(F.expr("sequence(0, k - 1)")))
    mine = mine.withColumn("at", F.expr("cast(i * length(n) div k AS int)")).withColumn("g", F.expr("substr(n, at + 1, cast((i + 1) * length(n) div k AS int) - at)")).withColumn("l", F.length("n"))
    theirs = right.withColumn("m", F.length("other")).withColumn("l", lengths("other")).withColumn("k", F.floor((F.col("l") + F.col("m")) * (1 - cutoff / 100) + 1e-9).cast("int") + 1)
    theirs = theirs.withColumn("i", F.explode(F.expr("sequence(0, k - 1)"))).withColumns({"at": F.expr("cast(i * l div k AS int)"), "size": F.expr("cast((i + 1) * l div k AS int) - cast(i * l div k AS int)")})
    theirs = theirs.withColumns({"low": F.expr("greatest(0, at - k + 1)"), "high": F.expr("least(m - size, at + k - 1)")}).filter("low <= high")
    theirs = theirs.withColumn("g", F.explode(F.expr("array_distinct(transform(sequence(low, high), p -> substr(other, p + 1, size)))"))).drop("k", "at", "size", "low", "high")
    pairs = mine.drop("k", "at").join(theirs, [*on, "l", "m", "i", "g"]).filter("n != other").drop("l", "m", "i", "g").distinct()
    return pairs.filter(ratio(F.col("n"), F.col("other")) >= cutoff)


def duplicates(invoices: DataFrame, alike: DataFrame) -> DataFrame:
    """id, tier and what was found (kind, match_id) of invoices (id, name, number, inv_date, total, file_hash) that repeat an earlier one; alike (a, b):
    names of the same vendor. Tiers: 1 the same file; 2 the vendor's number, or without a number its date and amount; 3 an
    almost equal number, or the same date, at the same amount; 4 of whatever vendor, number, date and amount."""
    rows = invoices.withColumn("n", F.when(~text.missing(F.col("number")), text.norm_number(F.col("number"))))
    files = rows.filter(~text.missing(F.col("file_hash"))).groupBy("file_hash").agg(F.min("id").alias("match_id"))
    same_file = rows.join(files, "file_hash").select("id", F.lit(1).alias("tier"), F.lit("same_file").alias("kind"), "match_id")

    # names with the same number meet by it; where very many have one, each meets the names that are alike
    groups = once(rows.filter("n IS NOT NULL AND name != ''").groupBy("name", "n").agg(F.min(F.struct("id", "total")).alias("first")), "numbers")
    held = groups.groupBy("n").agg(F.count(F.lit(1)).alias("names")).filter("names > 1")
    few, many = (groups.join(held.filter(c), "n", "left_semi") for c in (F.col("names") <= FEW, F.col("names") > FEW))
    as_a, as_b = (lambda g: g.select(F.col("name").alias("a"), "n")), (lambda g: g.select(F.col("name").alias("b"), "n", "first"))
    met = as_a(few).join(as_b(few), "n").join(alike, ["a", "b"]).select("a", "n", "first").union(as_a(many).join(alike, "a").join(as_b(many), ["b", "n"]).select("a", "n", "first"))
    earliest = met.withColumnRenamed("a", "name").unionByName(groups).groupBy("name", "n").agg(F.min("first").alias("first"))
    differs = F.when(F.abs(F.col("total") - F.col("first.total")) > MONEY, "same_number_different_amount").otherwise("same_number")
    same_number = rows.join(earliest, ["name", "n"]).select("id", F.lit(2).alias("tier"), differs.alias("kind"), F.col("first.id").alias("match_id"))

    # equal invoices count once; amounts lie in bands as wide as the tolerance, so a match is in the same band or a next one
    kinds = rows.filter("total IS NOT NULL AND name != ''").groupBy("name", "n", "inv_date", "total").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    size = F.abs("total")
    band = F.floor(F.signum("total") * F.when(size <= MONEY / SHARE, size / MONEY).otherwise(MONEY / SHARE / MONEY + F.log(size * SHARE / MONEY) / SHARE) / 1.02).cast("long")
    kinds = once(kinds.withColumn("band", band), "kinds")
    # an invoice meets each name that is alike once: the bands next to its own are those that the other side is in
    met_by = kinds.join(alike, F.col("name") == F.col("a"))
    around = lambda rows: rows.withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    theirs = kinds.select(F.col("name").alias("b"), F.col("n").alias("other"), F.col("inv_date").alias("day"), F.col("total").alias("t"), "band", "first")
    near = (F.abs(F.col("total") - F.col("t")) <= F.greatest(F.lit(MONEY), SHARE * F.abs("t"))) & (F.col("first") < F.col("last"))
    mine = met_by.drop("first", "a")
    unnumbered = F.col("n").isNull() & (F.abs(F.col("total") - F.col("t")) <= MONEY)
    same_day = (F.col("inv_date") == F.col("day")) & (unnumbered | (F.col("n").isNotNull() & ~F.col("n").eqNullSafe(F.coalesce("other", F.lit("0")))))
    found = lambda pairs, late: pairs.select("name", "n", "inv_date", "total", "first", F.lit(late).alias("late") if isinstance(late, int) else late.alias("late"))
    # a band holds few invoices of a name, which are paired; of a crowded one only those of the same date or with almost the same number
    crowded = theirs.groupBy("b", "band").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CROWDED)
    pairs = mine.join(around(theirs.join(crowded, ["b", "band"], "left_anti")), ["b", "band"]).filter(near)
    comparable = (F.col("n") != F.col("other")) & (200 * F.least(F.length("n"), F.length("other")) >= NEAR * (F.length("n") + F.length("other")))
    alike_number = F.coalesce(ratio(F.when(comparable, F.col("n")), F.col("other")) >= NEAR, F.lit(False))
    paired = found(pairs, F.when(alike_number, 0).when(same_day, 1)).filter("late IS NOT NULL")
    many = around(theirs.join(crowded, ["b", "band"], "left_semi"))
    # only invoices beside a crowded band are taken apart for it; these bands are few and written, so that this costs no shuffle of the others
    busy = mine.join(once(around(crowded.select("b", "band")).distinct(), "crowded"), ["b", "band"], "left_semi")
    dated = found(busy.filter("inv_date IS NOT NULL").join(many.withColumn("inv_date", F.col("day")), ["b", "band", "inv_date"]).filter(near & same_day), 1)
    numbered = found(near_numbers(busy.filter("n IS NOT NULL"), many.filter("other IS NOT NULL"), ["b", "band"], NEAR).filter(near), 0)
    best = paired.unionByName(dated).unionByName(numbered).groupBy("name", "n", "inv_date", "total").agg(F.min(F.struct("first", "late")).alias("m"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("name", "n", "inv_date", "total")]
    kind = F.when(F.col("m.late") == 0, "near_duplicate").otherwise("same_amount_date")
    close = rows.alias("r").join(best.alias("k"), on).select("r.id", F.when(F.col("r.n").isNull(), 2).otherwise(3).alias("tier"), kind.alias("kind"), F.col("m.first").alias("match_id"))

    any_vendor = matching.any_vendor_duplicates(rows.filter("n IS NOT NULL").select("id", "number", "total", "inv_date"))
    others = any_vendor.select("id", F.lit(4).alias("tier"), F.lit("number_amount_date").alias("kind"), "match_id")
    every = same_file.unionByName(same_number).unionByName(close).unionByName(others).filter("match_id < id")
    return every.groupBy("id").agg(F.min(F.struct("tier", "match_id", "kind")).alias("d")).select("id", "d.tier", "d.kind", "d.match_id")


def account(c: Column) -> tuple[Column, Column]:
    """The number and the bank code (IFSC) of an account, in a form that can be compared."""
    s = F.coalesce(c, F.lit(""))
    return ids.compact(F.substring_index(s, "/", 1)), F.when(F.contains(s, F.lit("/")), ids.compact(F.regexp_replace(s, "^[^/]*/", ""))).otherwise("")


def earlier_accounts(invoices: DataFrame, alike: DataFrame) -> DataFrame:
    """id, paid (an earlier invoice of the vendor with an account was approved) and same (one with this account was). invoices: id, name, status, number_of
    and code_of the account."""
    approved = invoices.filter("status = 'approved' AND number_of != ''")
    firsts = approved.groupBy("name").agg(F.min("id").alias("first"))
    any_first = alike.join(firsts.withColumnRenamed("name", "b"), "b").groupBy("a").agg(F.min("first").alias("any_first"))
    used = approved.groupBy("name", "number_of", "code_of").agg(F.min("id").alias("first"))
    asked = invoices.filter("number_of != ''").select("name", "number_of", "code_of").distinct()
    met = asked.join(alike, F.col("name") == F.col("a")).join(used.select(F.col("name").alias("b"), "number_of", F.col("code_of").alias("code"), "first"), ["b", "number_of"])
    same = met.filter((F.col("code_of") == "") | (F.col("code") == "") | (F.col("code_of") == F.col("code"))).groupBy("name", "number_of", "code_of").agg(F.min("first").alias("same_first"))
    out = invoices.filter("number_of != ''").join(any_first.withColumnRenamed("a", "name"), "name", "left").join(same, ["name", "number_of", "code_of"], "left")
    return out.select("id", F.coalesce(F.col("any_first") < F.col("id"), F.lit(False)).alias("paid"), F.coalesce(F.col("same_first") < F.col("id"), F.lit(False)).alias("same"))


def name_printed(name: Column, document: Column) -> Column:
    """Whether this one name stands on this document; only asked where names disagree."""

    def run(names: pd.Series, documents: pd.Series) -> pd.Series:
        return pd.Series([bool(n and t and Index([n]).printed(t)) for n, t in zip(names, documents, strict=True)], dtype=bool)

    return F.pandas_udf(run, "boolean")(text.norm_vendor(name), flat(document))


def review(invoices: DataFrame, vendors: DataFrame, orders: DataFrame, require_order: bool = False, require_receipt: bool = False) -> DataFrame:
    """A row an invoice: id, total, and a struct (status, kind, match_id) for each of CHECKS.

    invoices: id, vendor, number, inv_date, currency, subtotal, tax_amount, total, tax_id, po_number, bank_account, status, file_hash, doc_text, ocr, line_sum
    (null without line items), waived (array of field names), receipt (null, true or false); vendors: name, tax_id, status, bank_account; orders: po_number,
    vendor, currency, amount, invoiced.
    """
    rows = invoices.withColumn("name", text.norm_vendor(F.col("vendor")))
    number, code = account(F.col("bank_account"))
    rows = base = rows.withColumns({"number_of": number, "code_of": code})
    read = rows.select("vendor").filter("vendor != ''").distinct()
    alike = once(similar_names(read, read, SAME).select("a", "b"), "alike")

    # the vendor's record: the first by name that is similar
    listed = vendors.filter(~text.missing(F.col("name"))).select("name", F.col("tax_id").alias("v_tax"), F.col("status").alias("v_status"), F.col("bank_account").alias("v_bank"))
    names = listed.select(F.col("name").alias("v_name"), text.norm_vendor(F.col("name")).alias("b"))
    close = once(similar_names(read, listed.select("name"), RECORD).select("a", "b"), "known")
    record = close.join(names, "b").groupBy("a").agg(F.min("v_name").alias("record"))
    rows = rows.join(record.withColumnRenamed("a", "name"), "name", "left").join(listed.withColumnRenamed("name", "record"), "record", "left")

    # accounts that other vendors have on file
    v_number, v_code = account(F.col("v_bank"))
    on_file = listed.withColumns({"number_of": v_number, "v_code": v_code}).filter("number_of != ''").select("number_of", "v_code", F.col("name").alias("other"), text.norm_vendor(F.col("name")).alias("b"))
    holders = rows.filter("number_of != ''").select("name", "number_of", "code_of").distinct().join(on_file, "number_of")
    holders = holders.filter((F.col("code_of") == "") | (F.col("v_code") == "") | (F.col("code_of") == F.col("v_code"))).join(close.withColumnRenamed("a", "name"), ["name", "b"], "left_anti")
    shared = holders.groupBy("name", "number_of", "code_of").agg(F.min("other").alias("shared"))
    rows = rows.join(shared, ["name", "number_of", "code_of"], "left").join(once(earlier_accounts(base, alike), "accounts"), "id", "left").join(once(duplicates(base, alike), "duplicates"), "id", "left")

    # the order as cited, else in upper, else in lower case
    known = orders.select(F.col("po_number").alias("po"), F.col("vendor").alias("p_vendor"), F.col("currency").alias("p_currency"), "amount", F.coalesce("invoiced", F.lit(0.0)).alias("invoiced"))
    cited = rows.filter(~text.missing(F.col("po_number"))).select("po_number").distinct()
    tried = cited.select("po_number", F.posexplode(F.array("po_number", F.upper("po_number"), F.lower("po_number"))).alias("k", "po"))
    order = tried.join(known, "po").groupBy("po_number").agg(F.min_by(F.struct("p_vendor", "p_currency", "amount", "invoiced"), "k").alias("o")).select("po_number", F.lit(True).alias("ordered"), "o.*")
    rows = rows.join(order, "po_number", "left").withColumn("p_name", text.norm_vendor(F.col("p_vendor")))
    supplies = similar_names(read, orders.select("vendor").filter("vendor != ''").distinct(), ORDERED).select(F.col("a").alias("name"), F.col("b").alias("p_name"), F.lit(True).alias("supplies"))
    rows = rows.join(supplies, ["name", "p_name"], "left")

    nothing = lambda c: text.missing(F.col(c))
    left = F.col("amount") - F.col("invoiced")
    wrong_tax = ~nothing("v_tax") & ~nothing("tax_id") & ~ids.same_tax_id(F.col("v_tax"), F.col("tax_id"))
    state = F.coalesce(F.nullif("v_status", F.lit("")), F.lit("approved"))
    bad_iban = ids.looks_like_iban(F.col("number_of")) & ~ids.iban_valid(F.col("number_of"))
    f_number, f_code = account(F.col("v_bank"))
    on_record = (F.col("number_of") == f_number) & ((F.col("code_of") == "") | (f_code == "") | (F.col("code_of") == f_code))
    tax = ids.tax_id(F.col("tax_id"))
    here = F.coalesce("supplies", F.lit(False)) | F.when(F.col("ordered") & F.col("supplies").isNull(), name_printed(F.col("p_vendor"), F.col("doc_text"))).otherwise(False)
    cases = {
        "completeness": completeness(F.col("waived")),
        "math": arithmetic(),
        "duplicate": F.when(F.col("tier").isNotNull(), _result(F.when(F.col("kind").isin("same_file", "same_number", "same_number_different_amount"), "fail").otherwise("warn"), F.col("kind"), F.col("match_id"))).otherwise(_result(F.when(nothing("number"), "skip").otherwise("pass"), F.lit(None))),
        "vendor": _cases((nothing("vendor"), "skip", None), (F.col("record").isNull(), "warn", "new"), (wrong_tax, "fail", "tax_id"), (state == "rejected", "fail", "rejected"), (state == "pending", "warn", "pending"), (state == "verified", "warn", "awaiting_approval"), (None, "pass", None)),
        "tax_id": _cases((nothing("tax_id"), "skip", None), (tax["valid"], "pass", tax["kind"]), (tax["kind"] == "GSTIN", "fail", tax["kind"]), (None, "warn", tax["kind"])),
        "po_match": _cases(
            (nothing("po_number") & F.lit(require_order), "fail", None), (nothing("po_number"), "skip", None), (F.col("ordered").isNull(), "warn", "po_unknown"), (F.col("total") > left * OVER + MONEY, "fail", "remaining"),
            (~F.col("here"), "warn", "other_vendor"), (F.col("receipt") == F.lit(False), "fail", "receipt_problem"),
            ((F.col("total") > left + MONEY) | (~nothing("p_currency") & ~nothing("currency") & (F.col("p_currency") != F.col("currency"))), "warn", "issues"),
            (F.lit(require_receipt) & ~F.coalesce("receipt", F.lit(False)), "warn", "awaiting_receipt"), (F.col("receipt"), "pass", "received"), (None, "pass", None),
        ),
        "bank": _cases(
            (nothing("bank_account"), "skip", None), (bad_iban & F.coalesce("ocr", F.lit(False)), "warn", "iban_invalid"), (bad_iban, "fail", "iban_invalid"), (~nothing("v_bank") & ~F.rlike("v_bank", F.lit(r"\d")), "fail", "changed"),
            (~nothing("v_bank") & on_record, "pass", None), (~nothing("v_bank"), "fail", "changed"), (F.col("paid") & ~F.col("same"), "fail", "changed"), (F.col("shared").isNotNull(), "warn", "shared"), (F.col("paid"), "pass", None),
            (F.col("record").isNotNull(), "warn", "new"), (None, "pass", None),
        ),
    }
    # each check is told in many places: the results are worked out once, by all tasks, as adaptive execution would take few rows of much work for few tasks
    return once(by_key(rows, "id").withColumn("here", here).select("id", "total", *(c.alias(n) for n, c in cases.items())), "reviewed")


def checks(reviewed: DataFrame) -> DataFrame:
    """id, name, status, kind, match_id: a row a check."""
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"{n}.status").alias("status"), F.col(f"{n}.kind").alias("kind"), F.col(f"{n}.match_id").alias("match_id")) for n in CHECKS))
    return reviewed.select("id", F.inline(each))


def decide(reviewed: DataFrame, limit: float = LIMIT) -> DataFrame:
    """id, outcome, confidence, lead (the check that the summary begins with) and reasons, 'check:kind' in the order in which they are told."""
    is_ = lambda n, *s: F.col(f"{n}.status").isin(*s)
    told = lambda names, condition: F.array_compact(F.array(*(F.when(condition(n), F.concat_ws(":", F.lit(n), F.col(f"{n}.kind"))) for n in names)))
    hard = told([n for n in LEAD if n in HARD], lambda n: is_(n, "fail"))
    warned = told(LEAD, lambda n: is_(n, "warn"))
    blocks = lambda n: ~is_(n, "pass") if n in MUST else ~is_(n, "pass", "skip")
    blockers, not_ok = told(LEAD, blocks), told(LEAD, lambda n: is_(n, "fail", "warn"))
    big = F.coalesce(F.col("total") > limit, F.lit(False))
    rejected = F.size(hard) > 0
    approved = ~rejected & (F.size(blockers) == 0) & (F.size(not_ok) == 0) & ~big
    sure = (F.size(hard) > 1) | F.substring_index(F.get(hard, F.lit(0)), ":", 1).isin(*SURE)
    outcome = F.when(rejected, "reject").when(approved, "auto_approve").otherwise("needs_review")
    confidence = F.when(rejected, F.when(sure, "high").otherwise("medium")).when(approved, "high").when(F.size(not_ok) > 0, "low").otherwise("medium")
    open_ = F.array_union(blockers, not_ok)
    reasons = F.when(rejected, F.concat(hard, warned)).when(approved, told(CHECKS, lambda n: is_(n, "pass"))).otherwise(F.concat(open_, F.when(big, F.array(F.lit("amount"))).otherwise(F.array().cast("array<string>"))))
    return reviewed.select("id", outcome.alias("outcome"), confidence.alias("confidence"), reasons.alias("reasons"))

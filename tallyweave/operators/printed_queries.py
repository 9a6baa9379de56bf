"""Queries over printed invoices and the words of documents: lines, labels, amounts, fields and how well they were read.

The oracles take no boxes: they put the rows together that were printed, follow every line's mean word by word in a recursive query,
and compare what was read with the facts that the pages were made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import fuzzy
from tallyweave.operators import fields, layout, printed_names, reconcile
from tallyweave.plans.reports import statement
from tallyweave.plans.views import SUPPLIER_TAX_ID, with_views
from tallyweave.sources import printed
from tallyweave.sources.shared import by_key, once


def _lines(spark: SparkSession, sf_dir: str, neighbours: bool = True) -> DataFrame:
    return layout.lines(printed.printed_words(spark, sf_dir), dealt=True, neighbours=neighbours)


def printed_lines(spark, sf_dir):
    """The lines of all printed invoices, put together from the boxes of their words."""
    return _lines(spark, sf_dir, neighbours=False).select("doc_id", "line", "page", "text")


def document_lines(spark, sf_dir):
    """The lines of all documents, whose rows sink and overlap."""
    found = layout.lines(printed.document_words(spark, sf_dir), dealt=True)
    return found.select("doc_id", "page", "line", F.size("words").alias("n_words"), F.round("y", 6).alias("y"))


#: The labels of totals and orders, of which label_hits gives every place.
SHOWN = [("total", 2, "(?iuU)" + fields.TOTAL), ("subtotal", 1, "(?iuU)" + fields.ANY_SUBTOTAL), *(("po", k, "(?iuU)" + p) for k, p in enumerate(fields.ORDER_LABELS))]


def label_hits(spark, sf_dir):
    """Every place of some labels: the line, the characters, the box, and the words below."""
    hits = layout.iter_hits(_lines(spark, sf_dir), SHOWN)
    return hits.select("doc_id", "line", "field", "begin", "stop", "x0", "x1", F.trim("after").alias("after"), "below1")


def invoice_number_candidates(spark, sf_dir):
    """The values that may be an invoice's number, the best first."""
    return fields.number_candidates(_lines(spark, sf_dir)).select("doc_id", "rank", "value")


def money_triples(spark, sf_dir):
    """Total, subtotal and tax of each printed invoice, and whether arithmetic confirmed them."""
    return fields.read_money(_lines(spark, sf_dir)).select("doc_id", "total", "subtotal", "tax", "rule")


def extracted_fields(spark, sf_dir):
    """All fields of each printed invoice."""
    return fields.read_fields(_lines(spark, sf_dir)).withColumn("inv_date", F.col("inv_date").cast("string")).drop("rule")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and whether each field was read as the facts say; null where there is no truth."""
    facts = statement(spark, sf_dir, "SELECT id, vendor_name, number AS t_number, day, currency AS t_currency, subtotal AS t_subtotal, tax_amount AS t_tax, total AS t_total FROM facts", printed.PRINTED)
    both = facts.join(fields.read_fields(_lines(spark, sf_dir)), F.col("id") == F.col("doc_id"), "left")
    bare = lambda c: F.lower(F.translate(F.coalesce(c, F.lit("")), "#/- ", ""))
    near = lambda a, b: F.coalesce(F.abs(a - b) < 0.011, F.lit(False))
    known = lambda t, ok: F.when(F.col(t).isNotNull(), ok)
    got, want = F.lower(F.coalesce("vendor", F.lit(""))), F.lower("vendor_name")
    # the similarity is worked out only where the name isn't there as it is
    vendor = F.when(F.contains(got, want), True).when(got == "", False).otherwise(fuzzy.partial_ratio(want, got) >= 88)
    return both.select(
        F.col("id").alias("doc_id"), vendor.alias("vendor"), known("t_number", bare(F.col("number")) == bare(F.col("t_number"))).alias("number"),
        known("day", F.coalesce(F.col("inv_date").cast("string") == F.col("day"), F.lit(False))).alias("inv_date"), known("t_currency", F.coalesce(F.col("currency") == F.col("t_currency"), F.lit(False))).alias("currency"),
        known("t_subtotal", near(F.col("subtotal"), F.col("t_subtotal"))).alias("subtotal"), known("t_tax", near(F.col("tax_amount"), F.col("t_tax"))).alias("tax_amount"), known("t_total", near(F.col("total"), F.col("t_total"))).alias("total"),
    )


SCORED = ("vendor", "number", "inv_date", "currency", "subtotal", "tax_amount", "total")


def field_scores(spark, sf_dir):
    """Whether each field of each printed invoice was read right."""
    return _scored(spark, sf_dir)


def score_summary(spark, sf_dir):
    """How many fields were scored and read right, by field and in all."""
    pairs: list[Column] = [F.struct(F.lit(f).alias("field"), F.col(f).alias("ok")) for f in SCORED]
    each = _scored(spark, sf_dir).select(F.inline(F.array(*pairs))).filter("ok IS NOT NULL")
    return each.rollup("field").agg(F.count(F.lit(1)).alias("scored"), F.count_if("ok").alias("correct")).select(F.coalesce("field", F.lit("all")).alias("field"), "scored", "correct")


#: What was read of an invoice's seller, the approved vendors, and the invoices' texts: every third lacks the name, every third the tax id as well.
READ = f"SELECT id, CASE WHEN id % 3 = 0 THEN vendor_name END AS vendor, CASE WHEN id % 3 < 2 THEN tax_id END AS tax_id FROM facts"
APPROVED = f"SELECT s_suppkey AS supp, {printed.VENDOR_NAME.format('s_suppkey')} AS name, {SUPPLIER_TAX_ID} AS tax_id FROM supplier WHERE s_suppkey % 13 <> 0"


def _joined(rows: DataFrame) -> DataFrame:
    """doc_id and text of printed rows."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "text"))), lambda r: r["text"]), "\n")
    return rows.groupBy(F.col("id").alias("doc_id")).agg(text.alias("text"))


def approved_vendor(spark, sf_dir):
    """The approved vendor of each printed invoice, by the name read, the tax id, or the only name printed."""
    facts = printed.facts(spark, sf_dir)

    def texts(open_: DataFrame) -> DataFrame:
        # only the rows of invoices that are still open are laid out and shuffled
        few = once(facts.join(open_.withColumnRenamed("doc_id", "id"), "id", "left_semi"), "open")
        return _joined(by_key(printed.printed_rows(spark, sf_dir, few), "id"))

    read = statement(spark, sf_dir, READ, printed.PRINTED, {"facts": facts}).withColumnRenamed("id", "doc_id")
    return printed_names.approved_vendor(read, texts, statement(spark, sf_dir, APPROVED))


#: Two readings of each printed invoice, with errors of their own: the second one's is right where the first one's isn't, and the other way round.
FIRST = """SELECT id AS doc_id, CASE WHEN id % 9 <> 0 THEN vendor_name END AS vendor, CASE WHEN id % 8 <> 0 THEN printed_number END AS invoice_number, cast(day AS date) AS inv_date, currency, subtotal,
    CASE WHEN id % 6 <> 0 THEN tax_amount END AS tax_amount, total, tax_id, po_number, CASE WHEN bank_account IS NULL THEN NULL WHEN way = 2 THEN iban ELSE digits END AS bank_account, id % 17 = 0 AS ocr FROM facts"""
SECOND = """SELECT id AS doc_id, CASE WHEN id % 7 = 0 THEN 'Quickstep Zephyr Woodworks' ELSE upper(vendor_name) END AS vendor, CASE WHEN id % 5 = 0 THEN concat('ORD', cast(id AS string), 'Z') ELSE printed_number END AS invoice_number, cast(CASE WHEN id % 11 = 0 THEN '2019-02-28' ELSE day END AS date) AS inv_date, currency, subtotal, tax_amount,
    CASE WHEN id % 4 = 0 THEN total + 31.07 ELSE total END AS total, CASE WHEN id % 10 = 0 THEN 'XQ77Q' ELSE tax_id END AS tax_id, po_number, CASE WHEN bank_account IS NULL THEN NULL WHEN way = 2 THEN iban ELSE digits END AS bank_account, id % 17 = 0 AS ocr FROM facts"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(printed.printed_rows(spark, sf_dir)).withColumnRenamed("text", "doc_text")


def ground_fields(spark, sf_dir):
    """The second reading without what its document doesn't show, and the fields that had to go."""
    second = statement(spark, sf_dir, SECOND, printed.PRINTED).join(_texts(spark, sf_dir), "doc_id")
    grounded = reconcile.ground(second)
    return grounded.select("doc_id", "vendor", "invoice_number", F.col("inv_date").cast("string").alias("inv_date"), "total", "tax_id", F.array_join("dropped", ",").alias("dropped"))


def merge_readings(spark, sf_dir):
    """Both readings as one, and the fields on which they differ."""
    fields = ("vendor", "invoice_number", "inv_date", "currency", "tax_id", "po_number", "bank_account", "subtotal", "tax_amount", "total")
    first = statement(spark, sf_dir, FIRST, printed.PRINTED).select("doc_id", "ocr", F.struct(*fields).alias("rules"))
    second = statement(spark, sf_dir, SECOND, printed.PRINTED).select("doc_id", F.struct(*fields).alias("ai"))
    labelled = statement(spark, sf_dir, "SELECT id AS doc_id, printed_number FROM facts", printed.PRINTED).select("doc_id", F.array_compact(F.array("printed_number")).alias("labelled"))
    merged = reconcile.merge(first.join(second, "doc_id").join(labelled, "doc_id").withColumn("trusted", F.col("doc_id") % 3 == 0))
    return merged.select("doc_id", "vendor", "invoice_number", "tax_amount", "total", "money_from", F.array_join("differs", ",").alias("differs"))


def reasons_for_ai(spark, sf_dir):
    """Why the first reading of each printed invoice should be checked by a second one."""
    read = statement(spark, sf_dir, FIRST, printed.PRINTED).withColumn("known", F.when(F.col("doc_id") % 13 != 0, F.col("vendor")))
    return reconcile.reasons_for_second_reading(read).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {f.__name__: f for f in (ground_fields, merge_readings, reasons_for_ai, approved_vendor, printed_lines, document_lines, label_hits, invoice_number_candidates, money_triples, extracted_fields, field_scores, score_summary)}


def _facts(sql: str) -> str:
    return with_views(sql, printed.PRINTED)


_ROWS = f"""(SELECT id, nth, page, string_agg(text, ' ' ORDER BY x) AS text, first(text ORDER BY x) AS head
    FROM (SELECT id, x, text, cast(dense_rank() OVER (PARTITION BY id ORDER BY place) - 1 AS int) AS nth, cast(floor((dense_rank() OVER (PARTITION BY id ORDER BY place) - 1) / {printed.PAGE_ROWS}) AS int) AS page FROM printed_rows) r GROUP BY id, nth, page)"""
_TAX_ID = "CASE WHEN tax_id LIKE 'DE%' OR tax_id LIKE '100%' OR tax_id LIKE '%AABCO%' THEN tax_id END"
# a tax of nothing is read only where arithmetic confirms it
_CONFIRMED = "abs(subtotal + tax_amount - total) <= 0.02"
_TAX = f"CASE WHEN {_CONFIRMED} OR tax_amount > 0 THEN tax_amount END"
_MISPRINT = "(id % 37 <> 0 OR number IS NULL)"
ORACLE_SQL = {
    # from the errors that the readings were given; Indian invoices print their tax in parts only
    "ground_fields": _facts(f"""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN vendor END AS vendor, CASE WHEN doc_id % 5 <> 0 THEN invoice_number END AS invoice_number, CASE WHEN doc_id % 11 <> 0 THEN cast(inv_date AS string) END AS inv_date,
        CASE WHEN doc_id % 4 <> 0 THEN total END AS total, CASE WHEN doc_id % 10 <> 0 THEN tax_id END AS tax_id,
        concat_ws(',', CASE WHEN currency = 'INR' AND tax_amount > 0 THEN 'tax_amount' END, CASE WHEN doc_id % 4 = 0 THEN 'total' END, CASE WHEN doc_id % 5 = 0 THEN 'invoice_number' END, CASE WHEN doc_id % 10 = 0 THEN 'tax_id' END, CASE WHEN doc_id % 11 = 0 THEN 'inv_date' END, CASE WHEN doc_id % 7 = 0 THEN 'vendor' END) AS dropped FROM ({SECOND}) r"""),
    "merge_readings": _facts(f"""SELECT f.doc_id, CASE WHEN f.doc_id % 3 = 0 THEN coalesce(f.vendor, s.vendor) ELSE s.vendor END AS vendor,
        CASE WHEN f.invoice_number IS NOT NULL THEN f.invoice_number WHEN f.doc_id % 5 <> 0 THEN s.invoice_number END AS invoice_number, coalesce(f.tax_amount, s.tax_amount) AS tax_amount,
        CASE WHEN src = 'rules' THEN f.total ELSE s.total END AS total, src AS money_from,
        concat_ws(',', CASE WHEN f.vendor IS NOT NULL AND f.doc_id % 7 = 0 THEN 'vendor' END, CASE WHEN f.invoice_number IS NOT NULL AND f.doc_id % 5 = 0 THEN 'invoice_number' END, CASE WHEN f.doc_id % 11 = 0 AND f.inv_date <> date '2019-02-28' THEN 'inv_date' END,
                  CASE WHEN f.doc_id % 10 = 0 AND f.tax_id IS NOT NULL THEN 'tax_id' END, CASE WHEN f.doc_id % 4 = 0 THEN 'total' END) AS differs
        FROM (SELECT r.*, CASE WHEN abs(r.subtotal + r.tax_amount - r.total) <= 0.02 THEN 'rules' WHEN abs(t.subtotal + t.tax_amount - t.total) <= 0.02 THEN 'ai' ELSE 'rules' END AS src FROM ({FIRST}) r JOIN ({SECOND}) t ON t.doc_id = r.doc_id) f JOIN ({SECOND}) s ON s.doc_id = f.doc_id"""),
    "reasons_for_ai": _facts(f"""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 9 = 0 THEN 'vendor is missing' END, CASE WHEN invoice_number IS NULL THEN 'invoice_number is missing' END, CASE WHEN doc_id % 17 = 0 THEN 'a scan' END,
        CASE WHEN doc_id % 6 <> 0 AND abs(subtotal + tax_amount - total) > 0.02 THEN 'figures don''t add up' END, CASE WHEN doc_id % 9 <> 0 AND doc_id % 13 = 0 THEN 'vendor is not on the list' END) AS reasons FROM ({FIRST}) r"""),
    # no two names are alike, so the vendor is the one that the page was printed for
    "approved_vendor": _facts("""SELECT id AS doc_id, CASE WHEN supp % 13 <> 0 THEN vendor_name END AS vendor,
        CASE WHEN supp % 13 <> 0 THEN CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 AND tax_id IS NOT NULL THEN 2 ELSE 3 END END AS tier FROM facts"""),
    "printed_lines": _facts(f"SELECT id AS doc_id, nth AS line, page, text FROM {_ROWS} x"),
    # one word after another
    "document_lines": f"""WITH RECURSIVE w AS ({printed.DOCUMENT_WORDS.format(words=printed.DUCKDB_WORDS.replace(chr(92) + "n", chr(10)))}),
        p AS (SELECT doc_id, page, (y0 + y1) / 2 AS yc, greatest(y1 - y0, 1.0) AS h, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0 + y1, x0, seq) AS n FROM w),
        f AS (SELECT doc_id, page, n, yc, yc AS total, 1 AS many, h AS first_h, 1 AS row FROM p WHERE n = 1
              UNION ALL
              SELECT doc_id, page, n, yc, CASE WHEN fresh THEN yc ELSE total + yc END, CASE WHEN fresh THEN 1 ELSE many + 1 END, CASE WHEN fresh THEN h ELSE first_h END, CASE WHEN fresh THEN row + 1 ELSE row END
              FROM (SELECT p.doc_id, p.page, p.n, p.yc, p.h, f.total, f.many, f.first_h, f.row, abs(p.yc - f.total / f.many) > 0.55 * greatest(p.h, f.first_h) AS fresh FROM f JOIN p ON p.doc_id = f.doc_id AND p.page = f.page AND p.n = f.n + 1) s),
        l AS (SELECT doc_id, page, row, count(*) AS n_words, sum(yc) / count(*) AS y FROM f GROUP BY doc_id, page, row)
        SELECT doc_id, page, cast(row_number() OVER (PARTITION BY doc_id ORDER BY page, row) - 1 AS int) AS line, cast(n_words AS int) AS n_words, round(y, 6) AS y FROM l""",
    # from the rows that were printed: a label begins its row, so its box and those of the row below follow from their lengths
    "label_hits": _facts(f"""SELECT h.id AS doc_id, h.nth AS line, field, 0 AS begin, cast(length(label) AS int) AS stop, cast(50 AS double) AS x0, cast(right_end AS double) AS x1, trim(substr(h.text, length(label) + 1)) AS after,
        string_agg(word, ' ' ORDER BY w.x0) AS below1
        FROM (SELECT *, 50 + 6 * CASE WHEN substr(text || ' ', length(label) + 1, 1) = ' ' THEN length(label) ELSE length(label) + strpos(substr(text || ' ', length(label) + 1), ' ') - 1 END AS right_end
              FROM (SELECT id, nth, page, text, CASE WHEN starts_with(text, 'Amount Due') THEN 'total' WHEN starts_with(text, 'Subtot') THEN 'subtotal' WHEN starts_with(text, 'PO Number:') THEN 'po' END AS field,
                    CASE WHEN starts_with(text, 'Amount Due') THEN 'Amount Due' WHEN starts_with(text, 'Subtotaal') THEN 'Subtotaal' WHEN starts_with(text, 'Subtotal') THEN 'Subtotal' WHEN starts_with(text, 'PO Number:') THEN 'PO Number:' END AS label
                    FROM {_ROWS} x) y WHERE field IS NOT NULL) h
        LEFT JOIN (SELECT id, nth, page, word, x + 6 * coalesce(sum(length(word) + 1) OVER (PARTITION BY id, nth, x ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0
                   FROM (SELECT id, x, cast(dense_rank() OVER (PARTITION BY id ORDER BY place) - 1 AS int) AS nth, cast(floor((dense_rank() OVER (PARTITION BY id ORDER BY place) - 1) / {printed.PAGE_ROWS}) AS int) AS page,
                                unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS k FROM printed_rows) v) w
          ON w.id = h.id AND w.nth = h.nth + 1 AND w.page = h.page AND w.x0 + 3 * length(w.word) BETWEEN 25 AND right_end + 70
        GROUP BY ALL"""),
    "money_triples": _facts(f"SELECT id AS doc_id, total, subtotal, {_TAX} AS tax, CASE WHEN {_CONFIRMED} THEN 'confirmed' ELSE 'label' END AS rule FROM facts"),
    "extracted_fields": _facts(f"""SELECT id AS doc_id, vendor_name AS vendor, printed_number AS number, day AS inv_date, currency, subtotal, {_TAX} AS tax_amount, total, {_TAX_ID} AS tax_id, po_number,
        CASE WHEN bank_account IS NULL THEN NULL WHEN way = 2 THEN iban ELSE digits END AS bank_account FROM facts"""),
    "field_scores": _facts(f"SELECT id AS doc_id, true AS vendor, CASE WHEN number IS NOT NULL THEN {_MISPRINT} END AS number, true AS inv_date, true AS currency, true AS subtotal, {_TAX} IS NOT NULL AS tax_amount, true AS total FROM facts"),
    "score_summary": _facts(f"""SELECT field, count(*) AS scored, count(*) FILTER (WHERE ok) AS correct FROM (SELECT unnest(['vendor', 'inv_date', 'currency', 'subtotal', 'total']) AS field, true AS ok FROM facts UNION ALL SELECT 'tax_amount', {_TAX} IS NOT NULL FROM facts UNION ALL SELECT 'number', {_MISPRINT} FROM facts WHERE number IS NOT NULL) s GROUP BY field
        UNION ALL SELECT 'all', count(*) * 6 + count(number), count(*) * 5 + count({_TAX}) + count(number) FILTER (WHERE {_MISPRINT}) FROM facts"""),
}

"""Invoices as they would be printed: words with boxes on pages, derived from the invoice views, and the words of documents.

Each invoice is laid out in one of four ways (by its id): labels beside their values, labels above them in columns, Dutch, and Indian
with the tax in parts. The rows say what the views say, so what is read back from the boxes has a known truth; every 37th has its number misprinted. One SQL text makes the rows
for both engines; only the splitting into words differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.plans.reports import statement
from tallyweave.plans.views import SUPPLIER_TAX_ID, with_views
from tallyweave.sources.shared import by_key, folder

PAGE_ROWS, PITCH, ROW, TOP, HEIGHT = 45, 6.0, 18.0, 60.0, 10.0

#: A supplier's printed name, from its key.
VENDOR_NAME = """concat(upper(substr(translate(cast({0} * 7919 % 89989 + 10007 AS string), '0123456789', 'bdfgklmnpr'), 1, 1)), 'a', translate(cast({0} * 7919 % 89989 + 10007 AS string), '0123456789', 'aeiouyktsv'), translate(cast({0} * 31337 % 88993 + 10007 AS string), '0123456789', 'nortelumba'), CASE {0} % 4 WHEN 0 THEN ' Traders Pvt Ltd' WHEN 1 THEN ' Handel GmbH' WHEN 2 THEN ' Supplies Inc' ELSE ' Commerce B.V.' END)"""


def _amount(column: str, way: str = "way") -> str:
    """An amount as its layout prints it: 1,234.56 or, in Dutch, 1.234,56."""
    cents = f"cast(round(abs({column}) * 100) AS bigint)"
    whole = f"cast(floor({cents} / 100) AS bigint)"
    grouped = f"CASE WHEN {whole} >= 1000 THEN concat(cast(cast(floor({whole} / 1000) AS bigint) AS string), ',', lpad(cast({whole} % 1000 AS string), 3, '0')) ELSE cast({whole} AS string) END"
    text = f"concat({grouped}, '.', lpad(cast({cents} % 100 AS string), 2, '0'))"
    return f"CASE WHEN {way} = 2 THEN translate({text}, ',.', '.,') ELSE {text} END"


#: What stands on an invoice's rows: id, place (its row's order), x, text.
ROWS = f"""
SELECT id, 10 AS place, 50 AS x, vendor_name AS text FROM facts
UNION ALL SELECT id, 15, 50, concat(CASE WHEN tax_id LIKE 'DE%' THEN 'VAT No: ' WHEN tax_id LIKE '%AABCO%' THEN 'GSTIN: ' ELSE 'TRN: ' END, tax_id) FROM facts WHERE tax_id IS NOT NULL
UNION ALL SELECT id, 20, 50, CASE way WHEN 2 THEN 'Factuur' ELSE 'Tax Invoice' END FROM facts
UNION ALL SELECT id, 30, 50, concat(CASE way WHEN 2 THEN 'Factuurnummer: ' ELSE 'Invoice No: ' END, printed_number) FROM facts WHERE number IS NOT NULL AND way <> 1
UNION ALL SELECT id, 30, 50, 'Invoice Number' FROM facts WHERE way = 1
UNION ALL SELECT id, 30, 250, 'Invoice Date' FROM facts WHERE way = 1
UNION ALL SELECT id, 30, 430, 'Due Date' FROM facts WHERE way = 1
UNION ALL SELECT id, 32, 50, printed_number FROM facts WHERE way = 1 AND number IS NOT NULL
UNION ALL SELECT id, 32, 250, day FROM facts WHERE way = 1
UNION ALL SELECT id, 32, 430, '2031-01-01' FROM facts WHERE way = 1
UNION ALL SELECT id, 40, 50, concat(CASE way WHEN 2 THEN 'Factuurdatum: ' ELSE 'Date: ' END, day) FROM facts WHERE way <> 1
UNION ALL SELECT id, 41, 50, 'Due date: 2031-01-01' FROM facts WHERE way = 0
UNION ALL SELECT id, 44, 50, 'Bill To' FROM facts
UNION ALL SELECT id, 45, 50, 'Buyer Holding Ltd' FROM facts
UNION ALL SELECT id, 48, 50, concat('PO Number: ', po_number) FROM facts WHERE po_number IS NOT NULL
UNION ALL SELECT id, 50, 50, 'Item' FROM facts
UNION ALL SELECT id, 50, 300, 'Qty' FROM facts
UNION ALL SELECT id, 50, 430, 'Value' FROM facts
UNION ALL SELECT f.id, 100 + l.nth, 50, concat('Part no ', cast(l.l_partkey AS string)) FROM facts f JOIN items l ON l.l_orderkey = f.id
UNION ALL SELECT f.id, 100 + l.nth, 300, cast(cast(l.l_quantity AS bigint) AS string) FROM facts f JOIN items l ON l.l_orderkey = f.id
UNION ALL SELECT f.id, 100 + l.nth, 430, {_amount("l.l_extendedprice", "f.way")} FROM facts f JOIN items l ON l.l_orderkey = f.id
UNION ALL SELECT id, 300, 50, concat(CASE way WHEN 2 THEN 'Subtotaal ' ELSE 'Subtotal ' END, sign, {_amount("subtotal")}) FROM facts
UNION ALL SELECT id, 310, 50, CASE way WHEN 2 THEN concat('BTW ', sign, {_amount("tax_amount")}) WHEN 3 THEN concat('CGST @ 9% ', {_amount("part")}) ELSE concat('VAT ', CASE WHEN currency = 'PLN' THEN '' ELSE sign END, {_amount("tax_amount")}) END FROM facts
UNION ALL SELECT id, 311, 50, concat('SGST @ 9% ', {_amount("tax_amount - part")}) FROM facts WHERE way = 3
UNION ALL SELECT id, 320, 50, concat(CASE way WHEN 1 THEN 'Amount Due ' WHEN 2 THEN 'Totaal ' ELSE 'Total ' END, sign, {_amount("total")}) FROM facts
UNION ALL SELECT id, 400, 50, concat('Bank Account: ', digits) FROM facts WHERE bank_account IS NOT NULL AND way <> 2
UNION ALL SELECT id, 400, 50, concat('IBAN: ', iban) FROM facts WHERE bank_account IS NOT NULL AND way = 2
UNION ALL SELECT id, 410, 50, 'Please pay by bank transfer' FROM facts"""

FACTS = f"""
SELECT id, way, number, CASE WHEN id % 37 = 0 THEN replace(number, '0', 'O') WHEN way = 3 THEN replace(number, '-', '/') ELSE number END AS printed_number, po_number, bank_account, subtotal, tax_amount, total, currency, sign, supp, {VENDOR_NAME.format("supp")} AS vendor_name, cast(inv_date AS string) AS day, {SUPPLIER_TAX_ID.replace("s_suppkey", "supp")} AS tax_id,
       cast(floor(tax_amount * 50) / 100 AS double) AS part, CASE WHEN account IS NOT NULL THEN concat('77', lpad(account, 8, '0')) END AS digits,
       CASE WHEN account IS NOT NULL THEN concat('NL', lpad(cast(cast(98 - cast(concat('18231611', lpad(account, 10, '0'), '232100') AS decimal(38,0)) % 97 AS int) AS string), 2, '0'), 'INGB', lpad(account, 10, '0')) END AS iban
FROM (SELECT *, substr(bank_account, 4) AS account, CASE currency WHEN 'EUR' THEN '€ ' WHEN 'USD' THEN '$ ' WHEN 'GBP' THEN '£ ' ELSE concat(currency, ' ') END AS sign
      FROM (SELECT l.*, cast(CASE WHEN currency = 'INR' THEN 3 WHEN currency = 'EUR' AND id % 2 = 0 THEN 2 ELSE id % 2 END AS int) AS way FROM live l WHERE subtotal IS NOT NULL) w) s"""

ITEMS = "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS nth FROM lineitem"
PRINTED = {"facts": FACTS, "items": ITEMS, "printed_rows": ROWS}


def rows_sql() -> str:
    """The rows of all printed invoices, for either engine."""
    return with_views("SELECT * FROM printed_rows", PRINTED)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every kind of row looks at the facts: they are worked out once
    found = statement(spark, sf_dir, "SELECT * FROM facts", PRINTED)
    found.write.parquet(at := f"{folder(spark, 'facts')}/facts")
    return spark.read.schema(found.schema).parquet(at)


def printed_rows(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The rows of all printed invoices, or of those whose facts are given."""
    return statement(spark, sf_dir, "SELECT id, place, x, text FROM printed_rows", PRINTED, {"facts": facts(spark, sf_dir) if of is None else of})


#: Invoices that one task lays out: their words are sorted in memory, without spilling.
AT_ONCE = 50_000


def printed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words (doc_id, page, x0, y0, x1, y1, text, seq) of all printed invoices, a little out of line as a printer's are, dealt by document: rows
    are shuffled, words stay where their rows are."""
    known = facts(spark, sf_dir)
    rows = by_key(printed_rows(spark, sf_dir, known), "id", -(-known.count() // AT_ONCE))
    at = F.dense_rank().over(Window.partitionBy("id").orderBy("place")) - 1
    words = rows.withColumn("at", at).select("id", "at", "place", "x", "text", F.posexplode(F.split("text", " ")).alias("k", "word"))
    # a word begins after those before it
    left = F.col("x") + PITCH * (F.length(F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("k")), " ")) + F.when(F.col("k") > 0, 1).otherwise(0))
    jitter = ((F.col("id") * 7 + F.col("k") * 3 + F.col("place")) % 3) * 0.7
    top = TOP + ROW * (F.col("at") % PAGE_ROWS) + jitter
    return words.filter("word != ''").select(
        F.col("id").alias("doc_id"), F.floor(F.col("at") / PAGE_ROWS).cast("int").alias("page"), left.cast("double").alias("x0"), top.cast("double").alias("y0"),
        (left + PITCH * F.length("word")).cast("double").alias("x1"), (top + HEIGHT).cast("double").alias("y1"), F.col("word").alias("text"), (F.col("place") * 10000 + F.col("x") + F.col("k")).alias("seq"),
    )


#: Words of documents on pages of PAGE_WORDS, rows of ROW_WORDS that sink by a quarter of a point a word and overlap: their breaks depend on the mean.
PAGE_WORDS, ROW_WORDS = 400, 9
DOCUMENT_WORDS = f"""
SELECT doc_id, cast(floor(k / {PAGE_WORDS}) AS int) AS page, cast(20 + 40 * (k % {ROW_WORDS}) AS double) AS x0, cast(y AS double) AS y0, cast(20 + 40 * (k % {ROW_WORDS}) + 35 AS double) AS x1, cast(y + h AS double) AS y1, word AS text, k AS seq
FROM (SELECT doc_id, k, word, 8 + (k * 5 + length(word)) % 4 * 0.5 AS h, 30 + floor(k % {PAGE_WORDS} / {ROW_WORDS}) * 6.5 + (k % {ROW_WORDS}) * 0.25 + length(word) % 3 * 0.5 AS y FROM ({{words}}) w WHERE word <> '') p"""
SPARK_WORDS = "SELECT doc_id, posexplode(split(text, '[ \\n]')) AS (k, word) FROM documents"
DUCKDB_WORDS = "SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS word, generate_subscripts(regexp_split_to_array(text, '[ \\n]'), 1) - 1 AS k FROM documents"


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with boxes of all documents, dealt by document: texts are shuffled, words stay where their texts are."""
    texts = by_key(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    return statement(spark, sf_dir, DOCUMENT_WORDS.format(words=SPARK_WORDS.replace("\\n", "\\\\n")), tables={"documents": texts})

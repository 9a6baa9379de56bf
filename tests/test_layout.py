"""Lines, labels, money and fields of pages against plain loops and known answers."""

from __future__ import annotations

import random
import re
import time
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import spans
from tallyweave.operators import fields, layout

WORDS = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string, seq int"


def fold(words):
    """The lines of words (page, x0, y0, x1, y1, text), one word after another."""
    out = []
    for page in sorted({w[0] for w in words}):
        line = []
        for w in sorted((w for w in words if w[0] == page), key=lambda w: ((w[2] + w[4]), w[1])):
            centre, height = (w[2] + w[4]) / 2, max(w[4] - w[2], 1.0)
            if line and abs(centre - sum((v[2] + v[4]) / 2 for v in line) / len(line)) > 0.55 * max(height, max(line[0][4] - line[0][2], 1.0)):
                out.append((page, line))
                line = []
            line.append(w)
        if line:
            out.append((page, line))
    return [(page, " ".join(w[5] for w in sorted(line, key=lambda w: w[1]))) for page, line in out]


@pytest.mark.parametrize("spread", [0.3, 2, 6, 20])
def test_lines_equal_a_plain_loop(spark, spread):
    rng = random.Random(spread)
    docs = {}
    for doc in range(12):
        n = rng.choice([1, 2, 40, 400])
        tops = [rng.randrange(3) for _ in range(n)], [round(rng.uniform(0, 500), 2), *(0.0 for _ in range(n - 1))]
        y = tops[1][0]
        docs[doc] = []
        for k in range(n):
            y += abs(rng.gauss(0, spread))
            h = rng.choice([0.4, 3, 8, 9, 14])
            docs[doc].append((tops[0][k], round(rng.uniform(0, 500), 3), y, 0.0, y + h, f"w{k}"))
    rows = [(d, w[0], w[1], w[2], w[1] + 5, w[4], w[5], k) for d, words in docs.items() for k, w in enumerate(words)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # lines go over batches
    try:
        got = layout.lines(spark.createDataFrame(rows, WORDS)).orderBy("doc_id", "line").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for d, words in docs.items():
        mine = [r for r in got if r.doc_id == d]
        assert [(r.page, r.text) for r in mine] == fold(words)
        assert [r.line for r in mine] == list(range(len(mine)))
        for r in mine:
            assert all(r.text[w.begin : w.begin + len(w.text)] == w.text for w in r.words)


def test_a_page_of_a_million_words_takes_linear_time(spark):
    n = 1_000_000
    words = spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page"), (F.col("id") % 50 * 10.0).alias("x0"), (F.floor(F.col("id") / 50) * 7.0 + F.col("id") % 50 * 0.05).alias("y0"),
        (F.col("id") % 50 * 10.0 + 8).alias("x1"), (F.floor(F.col("id") / 50) * 7.0 + F.col("id") % 50 * 0.05 + 10).alias("y1"), F.lit("word").alias("text"), F.col("id").cast("int").alias("seq"),
    )
    began = time.time()
    assert layout.lines(words).agg(F.sum(F.size("words")), F.count(F.lit(1))).first()[0] == n
    assert time.time() - began < 60


def test_odd_words(spark):
    rows = [(None, 0, 1.0, 1.0, 2.0, 9.0, "a", 1), (None, 0, 3.0, 1.0, 4.0, 9.0, "b", 2), (1, 0, 1.0, 1.0, 2.0, 9.0, "  ", 1), (2, 0, None, 1.0, 2.0, 9.0, "x", 1), (3, None, 1.0, 1.0, 2.0, 9.0, "c", 1)]
    got = layout.lines(spark.createDataFrame(rows, WORDS)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("3", "c"), ("None", "a b")]
    assert layout.lines(spark.createDataFrame([], WORDS)).count() == 0


def page(rows, doc=1):
    """Words of rows of text or of (x, text) parts, 18 points apart, 6 a character."""
    out, seq = [], 0
    for k, row in enumerate(rows):
        for x, part in [(50, row)] if isinstance(row, str) else row:
            for m in re.finditer(r"\S+", part):
                out.append((doc, 0, x + 6.0 * m.start(), 60 + 18.0 * k, x + 6.0 * m.end(), 70 + 18.0 * k, m[0], seq := seq + 1))
    return out


def read(spark, *pages):
    words = [w for d, rows in enumerate(pages) for w in page(rows, d)]
    return fields.read_fields(layout.lines(spark.createDataFrame(words, WORDS))).orderBy("doc_id").collect()


GST = ["Sri Lakshmi Traders Pvt Ltd", "Tax Invoice", "Invoice No: SLT/2026/0412", "Date: 12/09/2026", "GSTIN: 29AABCU9603R1ZX", "Item Qty Rate Amount", "Steel rods 10 1,000.00 10,000.00", "Subtotal 10,000.00", "CGST @ 9% 900.00", "SGST @ 9% 900.00", "Total 11,800.00"]
IGST = ["Coastal Supplies Ltd", "Invoice No: CS-88", "Date: 01/09/2026", "Subtotal 5,000.00", "IGST @ 18% 900.00", "Total 5,900.00"]


def test_known_pages(spark):
    columns = [[(50, "Invoice Number"), (250, "Invoice Date"), (430, "Due Date")], [(50, "AB-10077"), (250, "03/20/2023"), (430, "04/20/2023")], "Seller: Blue Sky, Inc Buyer: Other", "Bill to Some Buyer Ltd", "Total $ 5 640,17 $ 564,02 $ 6 204,19", "IBAN NLSOINGB0683251309"]
    tie = ["Acme Trading GmbH", "Rechnung", "Rechnungsnr. 4711-A", "Datum 7. Mai 2014", "Zwischensumme 100,00", "MwSt 19,00", "Total 119,50", "Total 120,00", "Carried 119,50", "UStId DE 232 446 240", "Bank Account: 12 3456 78901"]
    a, b, c, d, e = read(spark, GST, IGST, columns, tie, ["nothing here"])
    assert (a.subtotal, a.tax_amount, a.total, a.number, a.vendor, a.inv_date, a.tax_id) == (10000.0, 1800.0, 11800.0, "SLT/2026/0412", "Sri Lakshmi Traders Pvt Ltd", date(2026, 9, 12), "29AABCU9603R1ZX")
    assert (b.subtotal, b.tax_amount, b.total, b.number) == (5000.0, 900.0, 5900.0, "CS-88")
    assert (c.number, c.inv_date, c.vendor, c.currency, c.total, c.rule, c.bank_account) == ("AB-10077", date(2023, 3, 20), "Blue Sky, Inc", "USD", 6204.19, "row", "NL50INGB0683251309")
    assert (d.vendor, d.number, d.inv_date, d.total, d.subtotal, d.tax_amount, d.tax_id, d.bank_account, d.rule) == ("Acme Trading GmbH", "4711-A", date(2014, 5, 7), 119.5, 100.0, 19.0, "DE232446240", "12345678901", "label")
    assert (e.vendor, e.number, e.total, e.rule) == ("nothing here", None, None, None)


def test_money_and_dates(spark):
    texts = ["Total $ 5 640,17 $ 564,02 $ 6 204,19", "Montant 1 234,56 €", "Total 1 278.61 40.39 319.00", "BTW 21% € 124,61", "Rs 1939 x 1 Night", None, "", "\u0001 12.50 \u0002"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", spans.find_money(F.col("t")).alias("m")).orderBy("k").collect()
    assert [r.m for r in rows] == [[5640.17, 564.02, 6204.19], [1234.56], [278.61, 40.39, 319.0], [124.61], [1939.0], [], [], [12.5]]
    days = spark.createDataFrame([("03/04/2023 and 31.12.2017, Jan 1, 2022 or 02 Juillet 2015",), ("none",), (None,)], "t string").select(spans.all_dates(F.col("t")).alias("d")).collect()
    assert [[str(x) for x in r.d] for r in days] == [["2015-07-02", "2017-12-31", "2022-01-01", "2023-03-04", "2023-04-03"], [], []]
    fixed = spark.createDataFrame([("4O53,67 1l9.00 SOIL O1",)], "t string").select(spans.fix_scanned_numbers(F.col("t")).alias("f"), spans.repair_iban(F.lit("NLSO INGB 0683 2513 09")).alias("i")).first()
    assert (fixed.f, fixed.i) == ("4053,67 119.00 SOIL O1", "NL50INGB0683251309")


def test_spans_equal_finditer(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab1 é😀.") for _ in range(rng.randrange(30))) for _ in range(200)]
    for pattern in (r"a+", r"[ab]1", r"\d\.?", "é|😀"):
        got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", spans.spans(F.col("t"), pattern).alias("s"), spans.rewrite(F.col("t"), pattern, lambda m: F.concat(F.lit("<"), m, F.lit(">"))).alias("r")).orderBy("k").collect()
        for r, t in zip(got, texts, strict=True):
            assert [(s.begin, s.stop) for s in r.s] == [m.span() for m in re.finditer(pattern, t)]
            assert r.r == re.sub(pattern, lambda m: f"<{m[0]}>", t)


def test_hits_equal_plain_loops(spark):
    rng = random.Random(9)
    pages = {d: [[(rng.randrange(0, 400), " ".join(rng.choice(["total", "Total", "due", "x", "subtotal", "12", "grand"]) for _ in range(rng.randint(1, 4)))) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 12))] for d in range(15)}
    lines = layout.lines(spark.createDataFrame([w for d, rows in pages.items() for w in page(rows, d)], WORDS))
    known = {}
    for r in lines.orderBy("line").collect():
        known.setdefault(r.doc_id, []).append(r)
    want = []
    for d, rows in known.items():
        for tier, label in enumerate((r"grand\s+total", r"\btotal")):
            for k, r in enumerate(rows):
                for m in re.finditer(label, r.text, re.IGNORECASE):
                    touched = [w for w in r.words if w.begin < m.end() and w.begin + len(w.text) > m.start()]
                    x0, x1 = touched[0].x0, touched[-1].x1
                    below = [" ".join(w.text for w in q.words if x0 - 25 <= (w.x0 + w.x1) / 2 <= x1 + 70) or None for q in rows[k + 1 : k + 3]] + [None, None]
                    want.append((d, k, tier, m.start(), m.end(), x0, x1, r.text[: m.start()], r.text[m.end() :], below[0], below[1]))
    hits = layout.iter_hits(lines, [("t", 0, r"(?i)grand\s+total"), ("t", 1, r"(?i)\btotal")])
    got = [(r.doc_id, r.line, r.tier, r.begin, r.stop, r.x0, r.x1, r.before, r.after, r.below1, r.below2) for r in hits.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 50


def loops(totals, subtotals, taxes):
    best = None
    for tier, t in totals:
        for s in subtotals:
            for x in taxes:
                if t > 0 and s > 0 and x < t and abs(s + x - t) <= 0.02:
                    score = (tier, sum(abs(v - t) < 0.005 for _, v in totals))
                    if best is None or score > best[0]:
                        best = (score, (t, s, x))
    return best and best[1]


def test_confirmed_totals_equal_the_triple_loop():
    rng = random.Random(10)
    amount = lambda: rng.choice([0.0, -5.0, 10.0, 10.01, 12.0, 2.0, 2.01, 1.99, 119.0, 100.0, 19.0, 19.02, round(rng.uniform(0, 120), 2)])
    found = 0
    for _ in range(3000):
        lists = [(rng.randint(1, 2), amount()) for _ in range(rng.randrange(6))], [amount() for _ in range(rng.randrange(6))], [amount() for _ in range(rng.randrange(6))]
        assert fields.confirmed(*lists) == loops(*lists)
        found += loops(*lists) is not None
    assert found > 300
    rng = np.random.default_rng(1)
    many = [np.round(rng.uniform(lo, hi, 3334), 2).tolist() for lo, hi in ((5e6, 9e6), (1, 4e6), (1, 9e5))]
    began = time.time()
    assert fields.confirmed([(1, v) for v in many[0]], many[1], many[2]) is None  # 10 000 figures, none of which add up
    assert time.time() - began < 30
    assert fields.confirmed([(1, v) for v in many[0]] + [(2, many[1][5] + many[2][7])], many[1], many[2]) is not None


def test_number_candidates_in_order(spark):
    rows = ["Invoice INV/2023/03/0008", "Customer # 12345", "Invoice No: 2023-01-02 x", "Bill no 77A", [(50, "Factuurnummer"), (300, "Invoice number")], [(50, "F-100200"), (300, "I-300400")]]
    got = fields.number_candidates(layout.lines(spark.createDataFrame(page(rows), WORDS))).orderBy("rank").collect()
    assert [r.value for r in got] == ["2023-01-02", "I-300400", "F-100200", "77A", "INV/2023/03/0008", "12345"]


def test_neighbours_taken_as_lines_come_are_those_of_a_window(spark, monkeypatch):
    """Over batches of any size, pages and documents, null ids among them; and no line is shuffled for them."""
    rng = random.Random(5)
    words = [(rng.choice([None, 1, 2, 3]), rng.randrange(3), 1.0 * k, 20.0 * rng.randrange(9), k + 0.9, 20.0 * rng.randrange(9) + 9, f"w{k}", k) for k in range(300)]
    words = spark.createDataFrame([(*w[:3], w[3], w[4], w[3] + 9, *w[6:]) for w in words], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string, seq int")
    shown = lambda rows: sorted(map(str, rows.select("doc_id", "line", "page", "text", "words", "below1", "below2").collect()))
    expected = shown(layout.with_neighbours(layout.lines(words)))
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        taken = layout.lines(words, neighbours=True)
        assert shown(taken) == expected
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = layout.iter_hits(layout.lines(layout.by_document(words), dealt=True, neighbours=True), [("total", 1, "w1")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Window" not in plan


def test_no_match_lacks_the_words_that_its_pattern_needs(spark):
    """Random matches of every pattern, in any case and with the letters that match others when case is ignored, hold one of its words."""
    rng, lines = random.Random(9), []
    seeds = ["invoice no.", "Inv # ", "factuurnummer", "facture n°", "n° de facture", "rechnungsnr", "bill no", "factuur 7", "booking id", "date of issue", "factuurdatum", "date d'émission", "issued", "facture n° 7 du", "P.O.:", "purchase order", "bestelnummer",
             "total amount due", "somme à payer", "gesamtbetrag", "net payable", "totaal", "exclusief btw", "total ht", "net worth", "untaxed", "taxable value", "montant eur ht", "grondslag", "sub-total", "subtotaal", "zwischensumme", "vat amount", "sales tax",
             "mwst", "igst", "utgst", "seller:", "service provider :", "USt-Id", "IBAN:", "bank account no", "a/c no", "acct. no", "rekeningnummer", "kontonummer", "n° de compte", "bill to", "t.a.v", "factuuradres", "attn", "bic", "neft", "receipt"]
    for seed in seeds:
        for change in (str.upper, str.title, lambda t: t.replace("s", "ſ").replace("k", "K"), lambda t: t.replace("i", rng.choice("İı"))):
            lines += [(seed,), (change(seed),)]
    text = spark.createDataFrame(lines, "text string")
    for pattern, needs in fields.NEEDS.items():
        lost = text.filter(F.rlike("text", F.lit("(?iuU)" + pattern)) & ~layout.holds(F.col("text"), needs)).collect()
        assert not lost, (pattern, lost)


def test_texts_of_documents_are_shuffled_not_words(spark, sf):
    from tallyweave.operators import printed_queries

    plan = printed_queries.document_lines(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Repartition")


def test_money_of_one_line_is_that_of_the_column(spark):
    rng = random.Random(12)
    parts = ["1", "23", "456", ".", ",", " ", " ", "%", "-", "€", "$", "rs", "Rs. ", "EUR ", "usd", "zł", " kr", "x", "1 234,56", "1 234.567", "12.50", "a", "\u0001", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", spans.find_money(F.col("t")).alias("m"), F.rlike("t", F.lit(spans.MAY_BE_MONEY)).alias("may")).orderBy("k").collect()
    assert sum(len(r.m) for r in got) > 1000
    for r, t in zip(got, texts, strict=True):
        assert spans.money_of(t) == r.m and (r.may or not r.m), t


def test_fields_are_read_without_a_shuffle_of_lines(spark):
    words = spark.createDataFrame(page(GST), WORDS)
    plan = fields.read_fields(layout.lines(layout.by_document(words), dealt=True, neighbours=True))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Window" not in plan


def test_what_other_lines_say_tells_which_evidence_counts(spark):
    rows = ["Invoice", "Bill to", "x", "Buyer Trading Ltd", "Seller Trading Ltd", "Account no 1234567", "x", "x", "Account no 7654321", "x", "our bank", "Ref # AB-1000"]
    a, b = read(spark, rows, ["Receipt", "Ref # AB-1000"])
    assert (a.vendor, a.bank_account, a.number, b.number) == ("Seller Trading Ltd", "7654321", "AB-1000", None)


def test_currencies_are_counted_where_their_letters_stand(spark):
    from tallyweave.functions import text

    rng = random.Random(13)
    parts = ["EUR", "euro", "Euros", "€", "$", "usd", "US dollars", "uſd", "₹", "INR", "inr", "Rs. 5", "Rupees", "£", "gbp", "AED", "د.إ", "DİRHAM", "dirhams", "PLN", "zł", "ZŁ", "traders", "x", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(7))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    counts = rows.select("k", text.detect_currency(F.col("t")).alias("got"), *(F.regexp_count("t", F.lit(p)).alias(n) for n, p in text.CURRENCIES)).collect()
    for r in counts:
        most = max(r[n] for n, _ in text.CURRENCIES)
        assert r.got == (next(n for n, _ in text.CURRENCIES if r[n] == most) if most else None), texts[r.k]

"""Answers of models as fields, labels and suggestions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyweave.functions import answers


def test_answers_are_read_with_tolerance(spark):
    texts = ['{"a": 1, "b": {"c": [1]}, "d": null}', '```json\n{"a": "x"}\n```', 'Sure: {"a": "{y}"} done', '[{"a": 1}]', "7", "", None, "no json", '{"a": ', 'x } {', "{} and {"]
    got = [r.m for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(answers.answer_object(F.col("t")).alias("m")).collect()]
    assert got == [{"a": "1", "b": '{"c":[1]}', "d": None}, {"a": "x"}, {"a": "{y}"}, None, None, None, None, None, None, None, {}]


def test_values_are_coerced(spark):
    texts = [
        '{"vendor": " Acme ", "invoice_number": 77, "invoice_date": "7. Mai 2014", "currency": "eur", "subtotal": "1.234,50", "tax_amount": 5, "total": "€ 1 239", "tax_id": [], "po_number": "", "line_items": [{"description": "a", "amount": "2,50", "quantity": 2}, 3, "x", null]}',
        '{"invoice_date": "2014-02-31", "currency": "Rs.", "total": "about ten", "line_items": "none", "bank_account": {}}', "nothing",
    ]
    a, b, c = [r.f for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(answers.coerced(answers.answer_object(F.col("t"))).alias("f")).collect()]
    assert (a.vendor, a.invoice_number, a.invoice_date, a.currency, a.subtotal, a.tax_amount, a.total, a.tax_id, a.po_number) == ("Acme", "77", date(2014, 5, 7), "EUR", 1234.5, 5.0, 1239.0, None, None)
    assert [(i.description, i.quantity, i.unit_price, i.amount) for i in a.line_items] == [("a", 2.0, None, 2.5)]
    assert (b.invoice_date, b.currency, b.total, b.bank_account, b.line_items) == (None, None, None, None, []) and c is None


def test_labels_and_checks(spark):
    rows = [(7, "A-1", "Acme", 1234.5, "EUR", "NL810433941B01", "NL50 INGB 0683 2513 09"), (8, "", None, 3.0, None, "", "12345678 / HDFC0000003"), (9, None, "", None, "EUR", "DE1", "NL50INGB0683251300")]
    c = F.col
    got = spark.createDataFrame(rows, "id long, n string, v string, t double, c string, x string, b string").select(answers.label(c("id"), c("n"), c("v"), c("t"), c("c")).alias("l"), answers.tax_check(c("x")).alias("x"), answers.account_check(c("b")).alias("b")).collect()
    assert [r.l for r in got] == ["invoice A-1 from Acme (1,234.50 EUR)", "invoice #8 from an unknown supplier (3.00)", "invoice #9 from an unknown supplier"]
    assert [r.x and (r.x.kind, r.x.valid) for r in got] == [("EU_VAT", True), None, ("EU_VAT", False)] and [r.b for r in got] == [True, None, False]


def test_an_answer_is_read_once(spark):
    rows = spark.createDataFrame([('{"vendor": "A", "total": "1,50"}',)], "answer string")
    plan = rows.select(answers.coerced(answers.answer_object(rows.answer)).alias("f")).select("f.vendor", "f.total", "f.currency")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("```(?:json)?") == 1

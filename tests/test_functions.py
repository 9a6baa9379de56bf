from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import fuzzy, ids, text


def each(spark, values, build):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").select("k", build(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_parse_amount(spark):
    want = {"1.234,56": 1234.56, "1,234.56": 1234.56, "34,73": 34.73, "1939": 1939.0, "1.234": 1234.0, "1,234.567": 1234567.0, ".50": 50.0, "12-34": None, "-5.00": -5.0, "12.3456": None, "abc": None, "": None}
    assert each(spark, [*want, None], text.parse_amount) == [*want.values(), None]


def test_parse_date(spark):
    d = datetime.date
    want = {
        "2022-11-28": d(2022, 11, 28), "28/11/2022": d(2022, 11, 28), "03-20-2023": d(2023, 3, 20), "31.12.17": d(2017, 12, 31), "03/04/2023": d(2023, 4, 3),
        "19 april 2014": d(2014, 4, 19), "7. Mai 2014": d(2014, 5, 7), "02 Juillet 2015": d(2015, 7, 2), "Jan 1, 2022": d(2022, 1, 1), "August 3rd, 2014": d(2014, 8, 3),
        "2022-13-40 or 5 may 2020": None, "30/02/2020": None, "words": None,
    }
    assert each(spark, [*want, None], text.parse_date) == [*want.values(), None]
    assert each(spark, ["03/04/2023"], lambda c: text.parse_date(c, True)) == [d(2023, 3, 4)]


def test_numbers_and_names(spark):
    assert each(spark, ["INV-0042", "inv 42", "--", None, "a00b007"], text.norm_number) == ["inv42", "inv42", "0", "0", "a0b7"]
    assert each(spark, ["Acme Traders Pvt. Ltd", "ACME Inc."], text.norm_vendor) == ["acme traders", "acme"]
    assert each(spark, ["US$ 5 USD EUR", "none", "€5", None], text.detect_currency) == ["USD", None, "EUR", None]
    assert each(spark, ["O0 Il|", None], text.ocr_fold) == ["00111", ""]
    assert each(spark, ["pay 1.234,56 by 12.50 at 19% now"], text.find_amounts) == [[1234.56, 12.5]]
    assert each(spark, ["x" * 9000], text.compact_text) == ["x" * 6000 + "\n...\n" + "x" * 2500]


def test_ibans(spark):
    want = {"GB82 WEST 1234 5698 7654 32": True, "GB82WEST12345698765431": False, "DE89370400440532013000": True, "DE8937040044053201300": False, "": False}
    assert each(spark, [*want, None], ids.iban_valid) == [*want.values(), False]
    assert each(spark, ["370400440532013000"], lambda c: ids.make_iban(F.lit("DE"), c)) == ["DE89370400440532013000"]
    assert each(spark, ["123-45.6", "7"], lambda c: ids.same_account(c, F.lit("12 3456"))) == [True, False]


def test_tax_ids(spark):
    found = each(spark, ["06AABCO6063D1ZQ", "06AABCO6063D1ZP", "100123456789012", "200123456789012", "DE123456789", "DE12", "XX1", "12"], ids.tax_id)
    assert [(r.kind, r.valid) for r in found] == [
        ("GSTIN", True), ("GSTIN", False), ("UAE_TRN", True), ("UAE_TRN", False), ("EU_VAT", True), ("EU_VAT", False), ("EU_VAT", False), ("UNKNOWN", False)
    ]
    assert each(spark, ["DE123", "124", None], lambda c: ids.same_tax_id(c, F.lit("123"))) == [True, False, True]


@pytest.mark.parametrize(("a", "b", "score"), [("inv1043", "inv1044", 100 * 12 / 14), ("abc", "abc", 100), ("", "a", 0)])
def test_indel(a, b, score):
    assert fuzzy.indel(a, b) == pytest.approx(score)


def test_other_scores():
    assert fuzzy.token_set("acme traders", "acme traders india") == 100
    assert fuzzy.token_set("acme", "zebra") < 50
    assert fuzzy.partial("acme", "the acme company") == 100

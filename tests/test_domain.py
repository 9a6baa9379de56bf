from __future__ import annotations

import random
from datetime import date

from pyspark.sql import functions as F

from tallyweave.functions import fuzzy, text
from tallyweave.operators import matching, workflow_queries


def test_charges(spark):
    page = "Shipping & Handling  $ 5.00\nDiscount 2.50\nFreight -1,000.00\nSubtotal incl. delivery 9.99\nRounding (0.01)\npostage five\nCarriage 3.00 and 1 250,75"
    rows = spark.createDataFrame([(page,), ("",), (None,), ("Packing 4.00 packing",)], "t string").select(text.charges(F.col("t")).alias("c")).collect()
    assert [(c.name, c.amount) for c in rows[0].c] == [("shipping", 5.0), ("discount", -2.5), ("freight", -1000.0), ("rounding", -0.01), ("carriage", 1250.75)]
    assert rows[1].c == rows[2].c == [] and [(c.name, c.amount) for c in rows[3].c] == [("packing", 4.0)]


def test_explained(spark):
    rows = spark.createDataFrame([(5.0,), (2.5,), (-2.5,), (0.5,), (2.51,)], "gap double")
    found = text.charges(F.lit("Shipping 5.00\nDiscount 2.50"))
    assert [r[0] for r in rows.select(text.explained(F.col("gap"), found)).collect()] == [True, True, True, False, True]
    assert rows.select(text.explained(F.col("gap"), text.charges(F.lit("")))).distinct().collect() == [(False,)]


def test_any_vendor_duplicates_equal_all_pairs(spark):
    draw = random.Random(5)
    base = [f"INV{draw.randrange(10**6):06d}" for _ in range(12)]
    rows = []
    for i in range(300):
        number = draw.choice(base) if draw.random() < 0.8 else None
        if number and draw.random() < 0.4:
            number = number[:4] + draw.choice("0123456789") + number[5:]
        rows.append((i, number if draw.random() < 0.95 else "A1", draw.choice([10.0, 10.01, 10.02, 10.05, -10.0, None]), date(2024, 1, draw.randrange(1, 4)) if draw.random() < 0.95 else None))
    frame = spark.createDataFrame(rows, "id long, number string, total double, inv_date date")
    norm = {r.id: r.n for r in frame.select("id", text.norm_number(F.col("number")).alias("n")).collect()}
    want = {}
    for i, number, total, day in rows:
        for j, other, t, d in rows[:i]:
            if None in (number, other, total, t, day) or day != d or len(norm[i]) < 6 or abs(total - t) > 0.02 or fuzzy.indel(norm[i], norm[j]) < 90:
                continue
            want[i] = j
            break
    assert want and {r.id: r.match_id for r in matching.any_vendor_duplicates(frame).collect()} == want


def test_some_invoices_have_planted_duplicates_elsewhere(spark, sf):
    found = {r.id: r.match_id for r in workflow_queries.duplicate_any_vendor(spark, sf).collect()}
    assert found and all(i % 100 == 50 and m == i - 1 for i, m in found.items())


def test_tax_ids_reach_the_decision(spark, sf):
    from tallyweave import catalogue

    wrong = {r.id for r in catalogue.QUERIES["check_tax"](spark, sf).filter("status = 'fail'").collect()}
    outcome = {r.id: r.outcome for r in catalogue.QUERIES["review_flagship"](spark, sf).collect()}
    assert all(outcome[i] == "reject" for i in wrong)


def test_charges_read_a_line_once(spark, sf):
    """A line is marked once and its figure taken once, not once a use; rows of much work are dealt over all tasks."""
    from tallyweave.operators import domain_queries

    plan = spark.createDataFrame([("Shipping 5.00",)], "t string").select(text.charges(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 20
    assert "RepartitionByExpression" in domain_queries.explained_charges(spark, sf)._jdf.queryExecution().optimizedPlan().toString()

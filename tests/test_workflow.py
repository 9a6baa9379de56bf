"""Vendor histories, guards, readings under a budget, evidence, schema generations and rechecks against plain loops."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import cascade, evidence, guards, layout, vendor_states
from tallyweave.sources import generations
from tallyweave.sources.generations import Field
from tallyweave.streaming.recheck import Recheck, check

ACTION = "vendor long, seq long, action string, actor string, role string, note string"


def random_actions(rng, n):
    kinds = ["propose", "add", "verify", "refuse", "approve", "reject", "verify", "approve", "nonsense", None]
    return [(rng.choice(kinds[2:] if rng.random() < 0.85 else kinds), rng.choice(["a", "b", "c", "d", None]), rng.choice(["local", "local", "ap", "procurement", "approver", "viewer", None]), rng.choice(["why", "", None])) for _ in range(n)]


def test_summaries_compose_to_the_row_by_row_fold():
    rng = random.Random(2)
    for _ in range(400):
        actions = random_actions(rng, rng.randint(1, 40))
        start = vendor_states.State(rng.choice(vendor_states.STATUSES), rng.choice(["a", "b", None, "z"]), rng.choice(["a", "c", None, "z"]))
        state = start
        for a in actions:
            state, _ = vendor_states.act(state, *a, lambda name, who: name == who)
        at, composed = 0, start
        while at < len(actions):
            size = rng.randint(1, 12)
            block = json.loads(json.dumps(vendor_states.summary(actions[at : at + size])))
            assert max(len(cases) for cases in block) <= 24
            composed, at = vendor_states.through(composed, block), at + size
        assert composed == state


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_histories_equal_the_fold(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, *a) for k, a in enumerate(random_actions(rng, 400))]
    want, states = {}, {}
    for vendor, seq, *a in rows:
        states[vendor], reason = vendor_states.act(states.get(vendor, vendor_states.State()), *a, lambda name, who: name == who)
        want[seq] = (vendor, states[vendor].status, reason)
    got = vendor_states.histories(spark.createDataFrame(rows, ACTION).repartition(5), block).collect()
    assert {r.seq: (r.vendor, r.status, r.reason) for r in got} == want and len(got) == 400
    assert len({s for _, s, _ in want.values()}) >= 3 and len({r for *_, r in want.values()}) >= 5
    assert vendor_states.histories(spark.createDataFrame([], ACTION)).count() == 0


def test_guards_name_the_first_rule(spark):
    rows = [("ap", "x", None, "ap_review", "pending", False, ["y"], 5.0), ("approver", "y", None, "approval", "pending", False, ["y"], 5.0), ("approver", "x", 4.0, "approval", "approved", False, [], 5.0), ("approver", "x", 4.0, "approval", "pending", True, [], None), ("viewer", None, None, None, None, False, None, None), (None, None, None, None, None, None, None, None), ("local", "x", 5.0, "ap_review", "pending", False, ["y"], 5.0)]
    c = F.col
    got = spark.createDataFrame(rows, "role string, name string, lim double, stage string, status string, removed boolean, touched array<string>, total double").select(
        guards.review(c("role"), c("stage")).alias("r"), guards.approve(c("role"), c("name"), c("lim"), c("removed"), c("touched"), c("total")).alias("a"), guards.remove(c("role"), c("removed"), c("status")).alias("d"), guards.edit(c("role"), c("removed"), c("stage")).alias("e")
    ).collect()
    assert [r.r for r in got] == [None, *["accounts payable reviews invoices"] * 5, None]
    assert [r.a for r in got] == ["managers approve invoices", "you uploaded or corrected it", "above your approval limit", "removed, so it is not paid", *["managers approve invoices"] * 2, None]
    assert [r.d for r in got] == [None, None, "already decided", "already removed", *["accounts payable or a manager removes"] * 2, None]
    assert [r.e is None for r in got] == [True, False, False, False, False, False, True]


def test_readings_equal_a_plain_fold(spark):
    rng = random.Random(7)
    readings = [(f"k{k}", t, rng.random() < 0.6, rng.random() < 0.4, rng.randrange(5), rng.choice([0.0, 0.25, 0.5])) for k in range(40) for t in range(1, 4) if k % 9]
    documents = [(k * 3, f"2024-01-{1 + k // 40:02d} 00:00:00" if k < 600 else f"2024-02-{1 + k // 80:02d} 00:00:00", f"k{rng.choice([1, 2, rng.randrange(40)])}") for k in range(1000)]
    plans = {}
    for k in {r[0] for r in readings}:
        calls, cost, won, best = 0, 0.0, 0, None
        for _, tier, ok, complete, score, price in sorted(r for r in readings if r[0] == k):
            calls, cost = calls + 1, cost + price
            if ok:
                won += 1
                best = max(best or (-1, 0), (score, -tier))
                if complete or won >= 2:
                    break
        plans[k] = (calls, cost, won > 0, best and -best[1])
    want, cached, day, month, used, spent = {}, set(), None, None, 0, 0.0
    for seq, at, key in documents:
        if at[:10] != day:
            day, used = at[:10], 0
        if at[:7] != month:
            month, spent = at[:7], 0.0
        if key not in plans:
            want[seq] = "none"
        elif key in cached:
            want[seq] = "cache"
        elif used >= 5 or spent >= 6.0:
            want[seq] = "refused"
        else:
            used, spent = used + plans[key][0], spent + plans[key][1]
            want[seq] = "read" if plans[key][2] else "failed"
            cached |= {key} if plans[key][2] else set()
    docs = spark.createDataFrame(documents, "seq long, at string, key string").withColumn("at", F.col("at").cast("timestamp"))
    table = spark.createDataFrame(readings, "key string, tier int, ok boolean, complete boolean, score int, cost double")
    assert {r.key: (r.calls, float(r.cost), r.read, r.tier) for r in cascade.cascades(table).collect()} == plans
    got = cascade.read_under_budget(docs.repartition(4), table, calls=5, budget=6.0, block=50)
    assert {r.seq: r.outcome for r in got.collect()} == want and set(want.values()) == {"none", "cache", "refused", "read", "failed"}


def test_evidence_equals_a_plain_search(spark):
    rng = random.Random(8)
    lines = {}
    words = []
    for doc in range(20):
        for k in range(rng.randint(1, 12)):
            row = [rng.choice(["12", "1,2", "34.50", "1 ", "AB", "abc", "Tot", "al", "5"]) for _ in range(rng.randint(1, 5))]
            lines.setdefault(doc, []).append([(40.0 * i, 20.0 * (k % 6), 40.0 * i + 30, 20.0 * (k % 6) + 10, t.strip(), k // 6) for i, t in enumerate(row)])
            words += [(doc, k // 6, 40.0 * i, 20.0 * (k % 6), 40.0 * i + 30, 20.0 * (k % 6) + 10, t, len(words) + i) for i, t in enumerate(row)]
    asked = [(doc, f"i{j}", [rng.choice(["1234.50", "12 1", "ABabc", "total", "34.50", "5", "125", "(x"]) for _ in range(2)], rng.random() < 0.5, rng.random() < 0.5) for doc in range(20) for j in range(6)]

    def search(doc, needles, numeric, lowest):
        for needle in needles:
            n, hits = re.sub(r"\s+", "", needle).upper(), []
            for line in lines[doc] if len(n) >= 3 else []:
                text, places = "", []
                for w in line:
                    places.append((len(text), len(text) + len(w[4]), w))
                    text += w[4].upper()
                at = next((m for m in range(len(text)) if text.startswith(n, m) and not (numeric and (text[m - 1 : m].isdigit() and m or text[m + len(n) : m + len(n) + 1].isdigit()))), -1)
                if at >= 0:
                    hits.append([w for a, b, w in places if a < at + len(n) and b > at])
            if hits:
                ws = max(hits, key=lambda ws: (ws[0][5], ws[0][1])) if lowest else hits[0]
                return (n, ws[0][5], min(w[0] for w in ws) / 100, min(w[1] for w in ws) / 200, (max(w[2] for w in ws) - min(w[0] for w in ws)) / 100)
        return None

    kind = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string, seq int"
    needles = spark.createDataFrame(asked, "doc_id long, item string, needles array<string>, numeric boolean, lowest boolean")
    got = evidence.find(needles, layout.lines(spark.createDataFrame(words, kind)), 100, 200).collect()
    want = {(d, i): found for d, i, *q in asked if (found := search(d, *q))}
    assert {(r.doc_id, r.item): (r.needle, r.page, r.x, r.y, pytest.approx(r.w)) for r in got} == want and len(want) > 20


def test_generations_become_one_table(spark, tmp_path):
    for k, rows in enumerate([[{"name": "a", "tax": "1"}, {"name": "b"}], [{"name": "c", "tax_id": "2", "status": ""}, {"name": "d", "tax_id": None, "status": "rejected"}], [{"name": "e", "tax_id": 5, "status": "pending", "score": "x", "new": {"z": 1}}, {"name": "f", "score": "7"}]]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.json").write_text("\n".join(map(json.dumps, rows)))
    target = [Field("name", "string"), Field("tax_id", "string", before=("tax",)), Field("status", "string", "approved"), Field("score", "int", 0)]
    got = sorted(tuple(r) for r in generations.read_generations(spark, [f"{tmp_path}/{k}" for k in range(3)], target).collect())
    assert got == [("a", "1", "approved", 0), ("b", None, "approved", 0), ("c", "2", "approved", 0), ("d", None, "rejected", 0), ("e", "5", "pending", 0), ("f", None, "approved", 7)]
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "t.json").write_text('{"_note": "x", "_list": [1],\n "one": {"total": 1.5, "extra": 2}, "two": {"number": "n"}, "three": null}')
    keyed = generations.keyed_objects(spark, str(tmp_path / "truth"), "struct<number:string,total:double>").select("key", "value.*").collect()
    assert sorted(map(tuple, keyed), key=str) == [("one", None, 1.5), ("three", None, None), ("two", "n", None)]


def test_recheck_equals_the_full_recomputation(spark, tmp_path):
    rng = random.Random(9)
    invoices = [(k, rng.choice([None, *range(60)]), rng.choice([None, "", *(f"PO-{i}" for i in range(50))]), float(rng.randrange(200))) for k in range(500)]
    table = spark.createDataFrame(invoices, "id long, vendor long, po_number string, total double")
    vendors = spark.createDataFrame([(v, rng.choice(["approved", "pending", None])) for v in range(50)], "vendor long, status string")
    orders = spark.createDataFrame([(f"PO-{i}", float(rng.randrange(200))) for i in range(40)], "po_number string, remaining double")
    kept = Recheck(spark, str(tmp_path / "state"), 64)
    kept.begin(table, vendors, orders)
    kind = "kind string, key string, seq long, status string, remaining double"
    batches = [[("vendor", "3", 1, "rejected", None), ("vendor", "3", 2, "verified", None)], [("order", "PO-7", 3, None, 5.0), ("vendor", "55", 4, "pending", None)], [("order", "PO-45", 5, None, 1000.0), ("order", "PO-999", 6, None, 1.0)], [("vendor", "777", 7, "approved", None)]]
    inbox = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(inbox))
        for t in (kept.invoices, kept.results, kept.vendors, kept.orders, kept.cited):
            t.touched.clear()
        query = kept.follow(spark.readStream.schema(kind).parquet(str(inbox)), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120)
        assert all(len(b) <= 32 for t in (kept.invoices, kept.results) for b in t.touched), k  # not all of the 64 buckets
        rows = sorted(map(tuple, kept.results.get().collect()), key=str)
        assert rows == sorted(map(tuple, kept.full().collect()), key=str) and len(rows) == 500
    status = {r.id: r for r in kept.results.get().collect()}
    assert all(status[k].vendor_kind == "awaiting_approval" for k, v, *_ in invoices if v == 3) and any(v == 3 for _, v, *_ in invoices)
    kept.apply(spark.createDataFrame(batches[1], kind), 1)  # a batch that is run again
    assert check(table, kept.vendors.get(), kept.orders.get()).count() == 500


def test_an_amount_of_millions_is_found_with_only_its_last_thousands_apart(spark):
    amounts = spark.createDataFrame([(1234567.89,), (234567.89,)], "v double").select(evidence.amount_forms(F.col("v")).alias("forms")).collect()
    assert amounts[0]["forms"] == ["1,234,567.89", "1.234.567,89", "1234567.89", "1234567,89", "1234,567.89", "1234.567,89"]
    assert amounts[1]["forms"] == ["234,567.89", "234.567,89", "234567.89", "234567,89"]
    needles = spark.createDataFrame([(1, "total", ["x"], True, True)], "doc_id int, item string, needles array<string>, numeric boolean, lowest boolean")
    needles = needles.withColumn("needles", evidence.amount_forms(F.lit(1234567.89)))
    words = spark.createDataFrame([(1, 0, 10.0, 10.0, 30.0, 20.0, "Total", 1), (1, 0, 40.0, 10.0, 90.0, 20.0, "1234,567.89", 2)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string, seq int")
    assert [(r["item"], r["x"]) for r in evidence.find(needles, layout.lines(words), 100, 200).collect()] == [("total", 0.4)]


def test_repeated_invoices_are_dealt_evenly(spark, sf):
    """No task gets all invoices that repeat none, and they are the same as with the statement that both engines read."""
    from tallyweave.operators import workflow_queries as w
    from tallyweave.plans.reports import statement
    from tallyweave.sources import printed

    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        columns = "id, number, vendor_name, total, day"
        ours, theirs = (statement(spark, sf, f"SELECT {columns} FROM repeated", printed.PRINTED | {"repeated": r}) for r in (w.SPARK_REPEATED, w.REPEATED))
        sizes = [r[1] for r in ours.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < sum(sizes) / 2
        assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_only_long_histories_are_summed_up(spark):
    """Histories no longer than a block are answered as they stand, beside longer ones and those of no vendor."""
    kinds = [("propose", "ap"), ("verify", "procurement"), ("approve", "approver"), ("reject", "approver"), ("refuse", "procurement"), ("add", "procurement"), ("propose", "viewer")]
    rows = [(None if k % 10 == 9 else k % 10 if k % 3 else 0, k, *kinds[(k * 7 + k // 5) % len(kinds)][:1], f"p{k % 4}", kinds[(k * 7 + k // 5) % len(kinds)][1], "why" if k % 2 else None) for k in range(240)]
    found = vendor_states.histories(spark.createDataFrame(rows, "vendor long, seq long, action string, actor string, role string, note string"), block=30)
    assert "LeftAnti" in found._jdf.queryExecution().toString()
    states, want = {}, {}
    for vendor, seq, action, actor, role, note in rows:
        states[vendor], reason = vendor_states.act(states.get(vendor, vendor_states.State()), action, actor, role, note, lambda a, b: a == b)
        want[seq] = (vendor, states[vendor].status, reason)
    assert {r.seq: (r.vendor, r.status, r.reason) for r in found.collect()} == want
    assert {len([r for r in rows if r[0] == v]) > 30 for v in states} == {True, False}


def test_lines_meet_their_needles_before_their_letters_are_made(spark):
    needles = spark.createDataFrame([(1, "total", ["1,50", "1.50"], True, True), (1, "number", ["AB 7"], False, False), (2, "total", ["9.99"], True, True)], "doc_id long, item string, needles array<string>, numeric boolean, lowest boolean")
    word = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string,begin:int>>"
    words = lambda *ts: [(10.0 * k, 5.0, 10.0 * k + 8, 9.0, t, 0) for k, t in enumerate(ts)]
    lines = spark.createDataFrame([(1, 0, 0, words("ab", "7")), (1, 1, 0, words("sum", "1.50")), (2, 0, 0, words("19.99"))], f"doc_id long, line int, page int, words {word}")
    found = evidence.find(needles, lines, 100.0, 100.0)
    assert sorted((r.doc_id, r.item, r.needle, r.x) for r in found.collect()) == [(1, "number", "AB7", 0.0), (1, "total", "1.50", 0.1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS letters") < plan.index("Join")

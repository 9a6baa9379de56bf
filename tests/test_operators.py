from __future__ import annotations

import random
import time
from collections import defaultdict, deque

from tallyweave.functions import fuzzy, text
from tallyweave.operators import matching, text_queries
from tallyweave.streaming import limits


def test_limits_equal_a_plain_fold(spark, sf):
    events = limits.prepared(spark.read.parquet(f"{sf}/events.parquet"))
    rows = sorted((r.user_id, r.seconds, r.event_id, r.ok) for r in events.collect())
    seen, want = defaultdict(deque), {}
    for user, now, event, _ in rows:
        q = seen[user]
        while q and now - q[0] > 86400:
            q.popleft()
        want[event] = len(q) < 3
        if want[event]:
            q.append(now)
    assert {r.event_id: r.accepted for r in limits.rate_limit(events, 3, 86400).collect()} == want
    state, locked = defaultdict(lambda: [0, 0]), {}
    for user, now, event, ok in rows:
        s = state[user]
        if now < s[1]:
            locked[event] = "refused"
        elif ok:
            s[0], locked[event] = 0, "ok"
        else:
            s[0] += 1
            locked[event] = "locked" if s[0] == 2 else "failed"
            if s[0] == 2:
                s[:] = [0, now + 900]
    assert {r.event_id: r.outcome for r in limits.lockout(events, 2).collect()} == locked


def test_first_vendor_is_not_the_best(spark):
    vendors = spark.createDataFrame([("Acme",), ("Acme Traders",), ("Zebra Works",)], "name string")
    invoices = spark.createDataFrame([(1, "ACME TRADERS Ltd"), (2, "Zebra Worx"), (3, None), (4, "Quite other")], "id long, vendor string")
    assert {r.id: r.match for r in matching.first_vendor(invoices, vendors).collect()} == {1: "Acme", 2: "Zebra Works", 3: None, 4: None}


def test_near_duplicates(spark):
    rows = [(1, 7, "INV-10431", 100.0), (2, 7, "INV-10432", 100.4), (3, 7, "INV-10431", 100.0), (4, 8, "INV-10433", 100.0), (5, 7, "X1", 100.0), (6, 7, None, 100.0), (7, 7, "INV-10439", 0.0)]
    got = matching.near_duplicates(spark.createDataFrame(rows, "id long, vendor_key long, number string, total double"))
    assert {r.id: r.match_id for r in got.collect()} == {2: 1, 3: 2}


def test_no_pair_of_names_is_lost(spark):
    rng = random.Random(1)
    names = ["acme", "acrme", "sony", "sorny", "a", "ab"]
    for _ in range(150):
        name = list(rng.choice(names))
        name.insert(rng.randint(0, len(name)), rng.choice("abcde  "))
        names.append("".join(name))
    names += ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12))) for _ in range(100)]
    table = spark.createDataFrame([(n,) for n in names], "name string")
    distinct = {r.n for r in table.select(text.norm_vendor(table.name).alias("n")).collect()} - {""}
    for cutoff in (80, 85):
        got = {(r.a, r.b) for r in matching.similar_names(table, table, cutoff).collect()}
        assert got == {(a, b) for a in distinct for b in distinct if fuzzy.token_set(a, b) >= cutoff}
        assert ("acme", "acrme") in got and ("sorny", "sony") in got


def test_names_that_share_a_frequent_word_are_not_all_paired(spark):
    rng = random.Random(6)
    names = {"".join(rng.choice("abcdefghijklmnop") for _ in range(12)) + " traders" for _ in range(6000)}
    table = spark.createDataFrame([(n,) for n in sorted(names)] + [("traders",), ("traders works",)], "name string")
    began = time.time()
    got = {(r.a, r.b) for r in matching.similar_names(table, table, 92).filter("a < b").collect()}
    assert time.time() - began < 60
    # a name of the frequent word alone is in all of them
    assert got >= {tuple(sorted((n, "traders"))) for n in names} and len(got) < len(names) + 100
    words = spark.createDataFrame([(w,) for n in names for w in n.split()], "g string")
    assert {r.g for r in matching._leading(table.filter("length(name) = 20"), "name", words, 92 / 108).collect()} == {n.split()[0] for n in names}


def test_blocks_of_names_lose_no_pair():
    rng = random.Random(7)
    known = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(1, 9))) for _ in range(25)]
    names = {" ".join(rng.choice(known) for _ in range(rng.randint(1, 4))) for _ in range(60)}
    names |= {" ".join((n[:k] + rng.choice("abcdeo ") + n[k:]).split()) for n in list(names) for k in (rng.randrange(len(n)), 0)}
    for cutoff in (70, 80, 92):
        got = {(a, b): score for a, b, score in fuzzy.alike(sorted(names), sorted(names), cutoff)}
        assert all(score == fuzzy.token_set(a, b) >= cutoff for (a, b), score in got.items())
        for a in names:
            for b in names:
                x, y = set(a.split()), set(b.split())
                left, right = (" ".join(sorted(x & y) + sorted(side - other)) for side, other in ((x, y), (y, x)))
                assert (a, b) in got or fuzzy.indel(left, right) < cutoff


def test_no_pair_of_amounts_is_lost(spark):
    rng = random.Random(2)
    totals = [0.5, 0.515, -100.0, -100.3, 0.01, -0.01, 0.0, *(rng.choice((-1, 1)) * round(base * rng.uniform(0.99, 1.01), 2) for base in (0.3, 2, 3.99, 4, 4.5, 100, 1e6) for _ in range(25))]
    rows = [(k, 1, f"INV-{1000000 + k}", t) for k, t in enumerate(totals)]
    want = {}
    for i, _, mine, t in rows:
        for j, _, other, total in rows[:i]:
            if i not in want and abs(t - total) <= max(0.02, 0.005 * abs(total)) and fuzzy.indel(mine, other) >= 85:
                want[i] = j
    got = matching.near_duplicates(spark.createDataFrame(rows, "id long, vendor_key long, number string, total double"))
    assert {r.id: r.match_id for r in got.collect()} == want
    assert want[1] == 0 and want[3] == 2 and want[5] == 4


def test_adapter_names_are_dissimilar(spark, sf):
    rows = text_queries.vendor_first_match(spark, sf).collect()
    assert rows and all(r.match.lower().removesuffix(" ltd") == r.vendor.lower().removesuffix(" limited") for r in rows)


def test_usage_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    query = limits.usage_by_day(stream).writeStream.outputMode("complete").format("memory").queryName("by_day").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    days = {str(r.day): r.calls for r in spark.sql("SELECT * FROM by_day").collect()}
    assert sum(days.values()) == spark.read.parquet(f"{sf}/events.parquet").count()

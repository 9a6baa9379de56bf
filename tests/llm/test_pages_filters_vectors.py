"""Main text of pages, the filter audit and whitening against brute force and on planted cases."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter
from html import unescape
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import filter_audit, html_extract, queries, whitening
from tallyweave.llm.html_tree import parse

# ---- pages


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def text(html, model):
    return next(html_extract.extract([html], model))


def test_main_text_of_all_pages(spark):
    rows = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op11_main_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows) == 250
    for r in got:
        article = re.search(r"<article>(.*)</article>", rows[r.page_id].html, re.DOTALL)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))).split())
        assert (r.text, r.n_chars, r.url) == (want, len(want), rows[r.page_id].url)


def test_layouts_that_were_not_learned(spark, model):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    contents = [html_extract.content_of(parse(h)) for h in pages]
    rng, same, shared, found, wanted = random.Random(991), 0, 0, 0, 0
    for _ in range(200):
        html = html_extract.layout(rng, contents)
        page = parse(html)
        want, got = html_extract.text_of(page, np.array(html_extract.parts(page), bool)), text(html, model)
        same += want == got
        a, b = Counter(want.split()), Counter(got.split())
        shared, found, wanted = shared + (a & b).total(), found + b.total(), wanted + a.total()
    assert same >= 160 and shared / found > 0.95 and shared / wanted > 0.95


PAGE = """<html><body><div id="wrapper"><div class="site-header"><a href="/">My site</a> <span>A tagline</span></div>
<ul class="menu"><li><a href=/a>Home</a><li><a href=/b>About</a></ul>
<div class="cookie-notice"><p>We use cookies to improve your experience. By continuing you agree to our policy.</p><button>OK</button></div>
<div class="content"><h1>The  big&nbsp;story</h1><p>First paragraph of the story, which tells quite a lot about the matter at hand.</p>
<p>Second paragraph, with a <a href="/x">link</a> and some <i>emp</i>hasis &lt;here&gt;.</p><div class="ad">Buy now! Best offers today.</div>
<script>var x = "<p>not text</p>";</script><p>Third paragraph<br>ends it all.</p>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>Bob</p><p>I like this story a lot, thank you very much for writing this up for us all.</p></div></div></div>
<div class="sidebar"><h3>Popular</h3><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></div><div class="footer">&copy; 2024 My site</div></div></body></html>"""


def test_a_page_of_another_make(model):
    want = "The big story First paragraph of the story, which tells quite a lot about the matter at hand. Second paragraph, with a link and some emphasis <here>. Third paragraph ends it all."
    assert text(PAGE, model) == want
    for cut in (PAGE.replace("</div></div></body></html>", ""), PAGE.replace("</p>", ""), PAGE.replace('class="content"', "class='content' data-x=don't")):
        assert text(cut, model) == want


def test_decoding_never_contradicts_an_ancestor():
    page = parse("<div><p>a</p><div><p>bb</p><div><p>ccc</p></div></div></div><p>d</p>")
    rng = np.random.default_rng(3)
    _, own = html_extract.features(page, {})
    for _ in range(300):
        odds = rng.normal(0, 3, len(page.tags))
        kept = html_extract.decode(page, odds, own)
        states = {}
        weight = np.where(own > 0, odds * (1 + np.log1p(own)), 0.5 * odds)

        def best(k, state, states=states, weight=weight):
            """The value of a subtree in a state, by trying all of each child."""
            if state == "cut":
                return 0.0
            below = [c for c in range(len(page.tags)) if page.parents[c] == k]
            if state == "main":
                return weight[k] + sum(max(best(c, "main"), best(c, "cut") - html_extract.CUT) for c in below)
            return sum(max(best(c, "context"), best(c, "main") - html_extract.ENTER, 0.0) for c in below)

        def value(k, kept=kept, weight=weight):
            below = [c for c in range(len(page.tags)) if page.parents[c] == k]
            if kept[k]:
                return weight[k] + sum(value(c) if kept[c] else -html_extract.CUT for c in below)
            return sum(value(c) - html_extract.ENTER * kept[c] for c in below)

        want = max(best(0, "context"), best(0, "main") - html_extract.ENTER)
        assert value(0) - html_extract.ENTER * kept[0] == pytest.approx(want)
        for k in range(1, len(kept)):  # main below main only, or where it is entered from context
            p = page.parents[k]
            assert not kept[p] or kept[k] or not kept[k : page.ends[k]].any()


def test_markup_in_linear_time(model):
    for html in ("<" * 200_000, "<a b='" * 100_000, '<a b="' * 100_001, "<!--" * 100_000, "<div>" * 60_000 + "x", "<p>x" * 60_000, "</p>" * 200_000, "<li><td>" * 30_000, "<script>" * 50_000, "&amp" * 200_000, "<a " * 100_000):
        began = time.time()
        page = parse(html)
        assert time.time() - began < 6, html[:10]
        assert len(page.ends) == len(page.tags) and page.ends[0] == len(page.tags)
    began = time.time()
    text("<body>" + "<div><p>word word.</p>" * 20_000, model)
    assert time.time() - began < 20
    assert text("no markup &amp; just\n text < here", model) == "no markup & just text < here" and text("", model) == ""


def test_pages_of_odd_rows(spark):
    kind = "page_id long, url string, html string, text string, n_chars string, id string"
    rows = [(1, "u", PAGE, "x", "y", "z"), (1, "u", PAGE, "x", "y", "z"), (None, None, None, None, None, None), (2, None, "", "", "", "")]
    got = html_extract.extract_pages(spark, spark.createDataFrame(rows, kind)).collect()
    assert sorted(Counter((r.page_id, r.url) for r in got).items(), key=str) == [((1, "u"), 2), ((2, None), 1), ((None, None), 1)]
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id != 1) and len({r.text for r in got if r.page_id == 1}) == 1
    empty = html_extract.extract_pages(spark, spark.createDataFrame([], kind))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0


# ---- filters


def fails(rows, k):
    doc_id, _, t = rows[k]
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    out = ""
    out += "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
    return out + "E" * any((o or "") == t and i is not None and doc_id is not None and i < doc_id for i, _, o in rows)


def audited(rows, labels):
    marks = [fails(rows, k) for k in range(len(rows))]
    good, bad = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {r[1] or "" for r in rows}:
        here = [k for k in range(len(rows)) if (rows[k][1] or "") == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                gone = [k for k in here if k not in set(left)]
                lost, left = [k for k in left if f in marks[k]], [k for k in left if f not in marks[k]]
                total[f] += len(lost)
                out[part, order, step] = [len(left), len(lost), sum(f in marks[k] for k in gone), sum(marks[k] == f for k in here), sum(rows[k][0] in good for k in lost), sum(rows[k][0] in bad for k in lost), f]
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = total[v[6]]
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "DELTA", "e$", " f g", "h\x0bi", "Ünï"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 99, 100, 130)] + [" ".join(f"w{i}" for i in range(n)) for n in (99, 100, 120)] + [None, "A" * 11 + "b" * 99, "A" * 10 + "b" * 90]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, "en", "de", ""]), rng.choice(texts)) for _ in range(90)]
    labels = [(rng.choice([None, *range(14)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("part", F.lit("x")).withColumn("mask", F.lit(1)).withColumn("n", F.lit(2)).withColumn("of", F.lit(3))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")).withColumn("n", F.lit(7))
    want = audited(rows, labels)
    for hold in (400, 32 << 20):
        counted = filter_audit.mask_counts(filter_audit.masks(docs.repartition(3), hold), marks)
        got = {(part, r[0], r[1]): list(r[2:]) for part, counts in counted.collect() for r in filter_audit.orders(counts)}
        assert got == want
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in filter_audit.audit(docs, marks).collect()} == want
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_colliding_texts_and_hot_copies(monkeypatch):
    monkeypatch.setattr(filter_audit, "text_hash", lambda raw: len(raw) % 2)
    rows = [(k, "en", "same" if k % 3 else f"own {k}") for k in range(300)]
    random.Random(1).shuffle(rows)
    routed = [r for at in range(0, 300, 50) for r in filter_audit.route([(k, part, t.encode()) for k, part, t in rows[at : at + 50]], 3000)]
    assert sum(1 for r in routed if r[1] == b"same") <= 60  # once a flush, not once a row
    settled = Counter()
    for doc_id, part, mask, n in filter_audit.settle(sorted(((r[0], r[1:]) for r in routed if r[0] is not None), key=lambda x: x[0])):
        settled[doc_id, part, bool(mask & filter_audit.COPY)] += n
    for _, _, doc_id, part, mask, n in (r for r in routed if r[0] is None):
        settled[doc_id, part, bool(mask & filter_audit.COPY)] += n
    assert settled == Counter((k, "en", bool(k % 3 and k != 1)) for k, _, _ in rows)


def test_audit_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.op12_filter_audit(spark, sf)
    want = con.execute(queries.ORACLE_SQL["op12_filter_audit"]).df()
    assert sorted(map(tuple, got.toPandas().itertuples(index=False))) == sorted(map(tuple, want[got.columns].itertuples(index=False)))


# ---- vectors


def brute_force(vectors):
    """deviation, whitened and explained with Python's integers throughout."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    scatter = [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]
    v = np.array([[s / n**3 for s in row] for row in scatter])
    values, vec = np.linalg.eigh(v)
    values, vec = values[::-1], vec[:, ::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.array([[c / n for c in r] for r in y]) @ vec / np.sqrt(values)
    return [sum(c * c for c in r) for r in y], z, values / np.trace(v), scatter


def check(got, vectors, components):
    deviation, z, explained, _ = brute_force(vectors)
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(rows) == len(got) == len(vectors) * components
    for k in range(len(vectors)):
        for c in range(1, components + 1):
            r = rows[k, c]
            assert r.n == len(vectors) and r.deviation == deviation[k] and r.explained == pytest.approx(explained[c - 1], rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(z[k, c - 1]), abs=1e-8) and r.identity_error < 1e-9


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(150, 40)) @ rng.normal(size=(40, 40)) * 3 + rng.normal(size=40) * 100).tolist()
    df = spark.createDataFrame([(k, v, 1, 2.0) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, component int, v double")
    check(whitening.whiten(df.repartition(4)).collect(), vectors, 32)
    few = [v[:3] for v in vectors[:20]]
    check(whitening.whiten(spark.createDataFrame(list(enumerate(few)), "vec_id long, embedding array<float>")).collect(), np.array(few, np.float32).astype(float).tolist(), 3)


def test_scatter_is_exact(spark):
    rng = random.Random(6)
    vectors = [[rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 9, 14]) for _ in range(5)] for _ in range(60)]
    rows = spark.createDataFrame([(v,) for v in vectors], "v array<double>").repartition(3)
    d, m = whitening.measure(rows)
    assert d == 5 and whitening.exact_scatter(rows, d, m).tolist() == brute_force(vectors)[3]
    deviation = {k: d if (d := brute_force(vectors)[0][k]) < 2**63 else None for k in range(60)}
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<double>")).filter("component = 1").collect()
    assert {r.vec_id: r.deviation for r in got} == deviation


def test_vectors_that_go(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 5.0]), (3, [0.0, 9.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, []), (9, [1.0]), (None, [3.0, 3.0]), (1, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter([(i, c) for i in (1, 2, 3, None, 1) for c in (1, 2)]) and {r.n for r in got} == {5}
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, None, None, 0.0)] * 4
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(5)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and max(r.identity_error for r in line) < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 3 and {r.deviation for r in huge} <= {None, 0} | {r.deviation for r in huge if r.vec_id == 3}
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0

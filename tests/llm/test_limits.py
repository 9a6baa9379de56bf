"""Long headers, damaged manifests, and redaction of texts with very many or very long identifiers."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import media, pii, warc


def test_a_header_of_any_length(spark):
    pages = spark.createDataFrame([(1, "https://x.example/" + "a" * (2 << 20), "<p>one"), (2, "u", "<p>two"), (3, "v" * 300_000, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.round_trip(spark, pages).collect()}
    assert got == {1: (6, "response"), 2: (6, "response"), 3: (0, "response")}


def test_a_damaged_manifest_or_index_is_an_error(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string").repartition(3)
    files, manifest = media.write_archives(docs, folder := __import__("tallyweave.llm.store", fromlist=["shared_dir"]).shared_dir(spark, "media"))
    assert media.read_archives(spark, folder, manifest).count() == 40
    index = next(Path(folder.removeprefix("file://")).glob("*.idx"))
    whole = index.read_bytes()
    index.write_bytes(whole[: -media.ENTRY.itemsize])
    with pytest.raises(Exception, match="damaged or lacks members"):
        media.read_archives(spark, folder, manifest).count()
    index.write_bytes(whole)
    part = next(Path(manifest.removeprefix("file://")).glob("*.parquet"))
    part.write_bytes(b"PAR1 nothing of use")
    with pytest.raises(Exception):
        media.read_archives(spark, folder, manifest).count()


def test_spans_are_cut_by_their_union(spark):
    rng = random.Random(4)
    texts, spans = [], []
    for _ in range(60):
        t = "".join(rng.choice("ab é😀.") for _ in range(rng.randrange(60)))
        some = sorted({(a, rng.randrange(4), rng.randint(a + 1, len(t)), rng.choice(["email", "ip"])) for a in (rng.randrange(len(t)) for _ in range(rng.randrange(6)))}) if t else []
        texts.append(t)
        spans.append(some)

    def plain(t, some):
        groups = []
        for s in some:
            if groups and s[0] < groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], s[2])
                groups[-1][2].append(s)
            else:
                groups.append([s[0], s[2], [s]])
        for a, b, g in reversed(groups):
            kind = max(g, key=lambda s: (s[2] - s[0], -s[0], -s[1]))[3]
            t = t[:a] + f"[{kind.upper()}]" + t[b:]
        return t

    kind = "of long, key string, text string, spans array<struct<start:long,rank:int,end:long,kind:string>>"
    rows = spark.createDataFrame([(k, "k", t, s) for k, (t, s) in enumerate(zip(texts, spans, strict=True))], kind)
    union = pii._union(rows.filter("size(spans) > 0").select("of", "key", "spans")).withColumnRenamed("of", "id")
    got = rows.join(union, F.col("of") == F.col("id")).select("of", pii._cut(F.col("text"), F.col("union")).alias("t")).collect()
    assert {r["of"]: r["t"] for r in got} == {k: plain(t, s) for k, (t, s) in enumerate(zip(texts, spans, strict=True)) if s}


def test_redaction_is_linear_in_the_spans(spark):
    keys = " ".join(f'key = "a{k:038x}f"' for k in range(16_000))
    docs = spark.createDataFrame([(1, keys), (2, "é" + keys)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.time() - began < 60
    assert got[1] == " ".join(['key = "[SECRET]"'] * 16_000) and got[2] == "é" + got[1]


def test_identifiers_have_no_longest(spark):
    rows = [(k, f"contact: {c * 3}{k}@mail.example today") for k, c in enumerate("abcdefghijkl")] + [(90, "contact: " + "x" * 300 + "@localhost"), (91, "contact: me@" + "y" * 140 + " and so on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.spans, r.n_added, r.n_discovered) for r in pii.span_digests(docs).collect()}
    assert found[90] == ("email:9:319", 1, 1) and found[91] == ("email:9:152", 1, 1)
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert redacted[90] == "contact: [EMAIL]" and redacted[91] == "contact: [EMAIL] and so on"
    began = time.time()
    long = spark.createDataFrame([(1, "a1" * 1_000_000), (2, "@" * 300_000), (3, "ab" * 500_000), (4, "1 " * 200_000), (5, ".@" * 200_000)], "doc_id long, text string")
    assert pii.span_digests(long).count() == 5 and time.time() - began < 90


def test_uses_are_counted_by_whole_patterns(spark):
    """A common word before an identifier lets through only the tokens that stand in a possible pattern, not all uses of the word."""
    docs = spark.createDataFrame([(1, "call the 1 " + "over the hill " * 50), (2, "call the 2 call the 3"), (3, "call the 2 call the 3")], "doc_id long, text string")
    possible = spark.createDataFrame([("the", "two call the")], "anchor string, pattern string")
    uses = pii._uses(docs, possible)
    joins = [line for line in uses._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert [tuple(r) for r in uses.collect()] == [("two call the", 3)]
    assert len(joins) == 1 and "pattern" in joins[0]


def test_patterns_of_common_words_are_settled_by_few_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"see the hill {k}" + (" by rote" if k < 3 else "")) for k in range(400)], "doc_id long, text string")
    possible = spark.createDataFrame([("word the", 5), ("word rote", 2), ("word none", 3)], "pattern string, n long")
    monkeypatch.setattr(pii, "SHARES", (4, 1))
    uses = {r.pattern: r.uses for r in pii._uses_as_needed(docs, possible).collect()}
    assert uses["word rote"] == 3 and uses["word none"] == 0
    # its score is below the least already, and the other texts are not searched for it
    assert 5 / pii.MIN_SCORE < uses["word the"] < 200

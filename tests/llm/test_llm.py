from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import fingerprints, media, neardup, packing, pieces, pii, queries, sharding, token_counts, toxicity, warc
from tallyweave.llm.chunks import ByteBpe

SCHEMA = "doc_id long, text string, lang string, place int, guest string"
ODD = [(None, "a b c d e f"), (1, None), (2, ""), (3, "x"), (3, "x"), (4, "long text " * 20000), (5, "same words here in this line"), (6, "same words here in this line"), (7, "  two  spaces ▁ mark\n\n"), (8, "😀 é 日本\x00")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", k, "g") for k, (i, t) in enumerate(ODD)], SCHEMA).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True  # op1's rule: the separator's name in a text is ordinary text; op4 is tested at the defaults
    return t


def test_chunked_ids_equal_the_libraries():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "the", "é", "▁", "日本", "\t", "\x00", "<s>", "😀", "ab", "1", "½", "'s", "<|endoftext|>", "　"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    bpe, want = ByteBpe(queries.RANKS, queries.PATTERN, limit=50), tokenizer().encode_batch(some, add_special_tokens=False)
    assert all(np.frombuffer(bpe.encode(t), "<u4").tolist() == w.ids for t, w in zip(some, want, strict=True))
    code = pieces.PieceCodec(queries.PIECES, limit=50)
    for t, (ids, decoded) in zip(some, code(some), strict=True):
        whole = code.lib.encode(t)
        assert (ids, decoded) == (",".join(map(str, whole)), code.lib.decode(whole))


def test_token_files(spark, tmp_path):
    rng, want = random.Random(2), []
    for k in range(4):
        ids = [9 if rng.random() < (0.2, 0.01)[k == 3] else rng.randint(10, 99) for _ in range(rng.randint(1, 150))]
        np.array(ids, "<u2").tofile(tmp_path / f"f{k}.bin")
        start = n = 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((f"f{k}.bin", n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            want.append((f"f{k}.bin", n, start, len(ids) - start, False))
    (tmp_path / "empty.bin").touch()
    folder = f"file://{tmp_path}"
    got = token_counts.document_tokens(token_counts.token_files(spark, folder), folder, 9, block_bytes=7).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_token_counts(docs, odd):
    lib = tokenizer()
    for table in (docs, odd):
        count = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
        want = sorted((str(r.doc_id), count(r.text)) for r in table.collect())
        got = token_counts.count_documents(table, queries.RANKS, queries.PATTERN, queries.END_OF_TEXT).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want


def test_toxicity(spark, docs, odd):
    train = spark.createDataFrame([(k, f"word{k} you idiot, near{k} zorgle{k} here{k} text" if k % 2 else f"word{k} kind and calm here{k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    assert any("zorgle".startswith(w) or w.startswith("zorgle") for w, _ in model.stems)
    assert model.score("you near zorgle77 and you idiot") > 0.7 > 0.3 > model.score("calm and kind")
    assert odd.select(toxicity.score(model, F.col("text")).alias("s")).filter("s BETWEEN 0 AND 1").count() == len(ODD)
    none = toxicity.fit(train, labels.limit(0))
    assert none.score("you idiot, you moron") > none.score("hello")


SEEDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(SEEDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            if {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans(spark, docs, odd):
    rng = random.Random(3)
    parts = [*"0123456789", ".", "@", "+", " ", "-", "a", "é", "😀", "(", "\n", "1.2.3.4", "x@y.z", "4111 1111 1111 1111", "+1 415 555 2671"]
    noise = spark.createDataFrame([(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for k in range(1500)], "doc_id long, text string")
    for table in (docs, odd, noise):
        got = sorted((str(r.doc_id), r.base_sha256) for r in pii.span_digests(table).collect())
        assert got == sorted((str(r.doc_id), hashlib.sha256(spans(r.text).encode()).hexdigest()) for r in table.collect())


def test_bootstrapping(spark):
    rows = [(k, f"some words contact: user{k}@mail.com and more of the words") for k in range(30)] + [(100, "so contact: user1@localhost is new, the user2@other is not")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.span_digests(table).filter("doc_id = 100").first().spans == "email:12:27"
    clean = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert clean[100] == "so contact: [EMAIL] is new, the user2@other is not" and clean[0] == "some words contact: [EMAIL] and more of the words"


def test_bootstrapping_with_copies_and_glued_labels(spark):
    rows = [(k, f"some words contact: user{k}@mail.com and more, or tel:+1415555{1000 + k} {k}") for k in range(30)]
    rows += [(100 + k, "so contact: user1@localhost is new") for k in range(500)]  # copies
    rows += [(1000 + k, f"line {k} write mail{k % 10}@mail.com to them") for k in range(60)]  # values that recur
    rows += [(2000, "call tel:030 1234567 or write user2@other now, the user3@other is not")]
    got = {r.doc_id: r.spans for r in pii.span_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[100 + k] for k in range(500)} == {"email:12:27"}
    assert got[2000] == "phone:9:20,email:30:41"


def test_redaction_of_overlapping_spans(spark):
    rng = random.Random(7)
    parts = [*"0123456789", ".", "+", " ", "a", "😀", "1.2.3.4", "x@y.z", "4111 1111 1111 1111", "+1 415 555 2671"]
    some = ["at +33.1.42.68.53.00 now", "1.2.3.4@x.com", None, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800))]
    table = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    found = {r.doc_id: [(int(a), int(b), k) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in pii.span_digests(table).collect()}
    got = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert got[0] == "at [PHONE] now" and got[1] == "[EMAIL]" and got[2] is None
    overlaps = 0
    for k, t in enumerate(some):
        t, union = t or "", []
        for a, b, kind in found[k]:
            overlaps += bool(union) and a < union[-1][1]
            if union and a < union[-1][1]:
                union[-1] = (union[-1][0], max(b, union[-1][1]), *max(union[-1][2:], (b - a, kind), key=lambda x: x[0]))
            else:
                union.append((a, b, b - a, kind))
        for a, b, _, kind in reversed(union):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        assert spans(got[k]) == "" and (got[k] or "") == t or spans(t) != "", (some[k], t, got[k])
    assert overlaps > 20


def test_best_fit_keeps_bounds():
    fit, rng, filled = packing.BestFit(100, 5), random.Random(4), collections.Counter()
    for _ in range(3000):
        n = rng.randint(1, 100)
        bin_id, offset = fit.place(n)
        assert offset == filled[bin_id]
        filled[bin_id] += n
        assert filled[bin_id] <= 100 and fit.n_open <= 5 and sum(map(len, fit.bins)) == fit.n_open
    assert len(filled) < 1.15 * sum(filled.values()) / 100


def test_packing(docs, odd):
    lib = tokenizer()
    for table in (docs, odd):
        rows = packing.pack_documents(table, queries.RANKS, queries.PATTERN).collect()
        ids = collections.Counter()
        for r in table.collect():
            full = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            first = len(full) % 1024 or 1024
            cuts = [0, *range(first, len(full) + 1, 1024)]
            ids.update((str(r.doc_id), k, a, b - a, zlib.crc32(full[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
        assert collections.Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == ids
        for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
            at = 0
            for r in group:
                assert r.offset == at
                at += r.length
            assert at <= 1024


def test_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)  # at its defaults
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", " the", "é", "'s", "1"]
    some = ["a <|endoftext|> b", "<|endoftext|>" * 1500, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(500))]
    want = collections.Counter()
    for k, t in enumerate(some):
        full = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(full) % 1024 or 1024, len(full) + 1, 1024)]
        want.update((k, i, a, b - a, zlib.crc32(full[a:b].tobytes())) for i, (a, b) in enumerate(itertools.pairwise(cuts)))
    table = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    rows = packing.pack_documents(table, queries.RANKS, queries.PATTERN).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_sharding(spark, docs):
    table = docs.select(F.when(F.col("doc_id") < 60, 7).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") < 30, "copy " * 200).otherwise(F.col("text")).alias("text"))
    rows = sharding.assign_shards(table, 5000).collect()
    assert len(rows) == docs.count()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += r.n_bytes
    counts = collections.Counter(r.shard for r in rows)
    assert all(n <= 5000 or counts[s] == 1 for s, n in sizes.items())
    names = sorted(s for s in sizes if "-" not in s)
    assert not any(b.startswith(a) for a, b in itertools.pairwise(names))  # a prefix code


def test_warc(spark, tmp_path):
    pages = [(1, "u", "aa"), (2, None, "aa"), (3, "u\nv", None), (4, "u", ""), (None, "k", "aa"), (5, "z", "a\r\n\r\nb" * 50000), (5, "z", "a\r\n\r\nb" * 50000), (6, "é", "é")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("key", F.lit(1))
    got = collections.Counter((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, table).collect())
    best = {}
    for i, _, html in pages:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    want = collections.Counter()
    for i, _, html in pages:
        data, top = (html or "").encode(), best[html or ""]
        want[str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top] += 1
    assert got == want
    member = warc.record(1, "u", b"payload", None)
    for broken in (member[:-9], member + member[:40]):
        import io

        with pytest.raises((EOFError, ValueError, zlib.error)):
            list(warc.members(io.BytesIO(broken).read, 16))
    text = next(warc.members(__import__("io").BytesIO(member).read, 7))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(text.replace(b"payload", b"pay1oad"))


def test_sentencepiece(docs, odd):
    code = pieces.PieceCodec(queries.PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for table in (docs, odd):
        want = []
        for r in table.collect():
            ids = code.lib.encode(r.text or "")
            want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids))), sha(code.lib.decode(ids) if ids else "")))
        assert sorted((str(r.doc_id), *r[1:]) for r in pieces.encode_digests(table, queries.PIECES).collect()) == sorted(want)
    full = {r.doc_id: r for r in pieces.encode_documents(docs, queries.PIECES).collect()}
    assert all(code.lib.decode(r.ids) == r.decoded for r in full.values())


def test_media(odd, docs):
    for table in (docs, odd):
        want = collections.Counter()
        for r in table.collect():
            data = (r.text or "").encode()
            full = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
            want[str(r.doc_id), len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), media.feature(full)] += 1
        got = media.round_trip(table).collect()
        assert collections.Counter((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got) == want


def test_media_retries_members_by_offset(spark, docs, tmp_path):
    folder = f"file://{tmp_path}"
    media.write_archives(docs, folder)
    reader = media.MediaReader({"path": folder, "rangebytes": "20000"})
    parts = reader.partitions()
    assert len(parts) > 3
    good = [m for p in parts for b in reader.read(p) for m in b.column("media").to_pylist()]
    calls, real = [], reader.member

    def flaky(data):
        calls.append(1)
        if len(calls) % 5 == 0:
            raise ValueError("a bad read")
        return real(data)

    reader.member = flaky
    assert [m for p in parts for b in reader.read(p) for m in b.column("media").to_pylist()] == good
    assert len(good) == docs.count()


def test_bagminhash_estimates_weighted_jaccard():
    rng, errors = np.random.default_rng(0), []
    for _ in range(40):
        a = rng.integers(0, 6, 300)
        b = np.where(rng.random(300) < 0.2, rng.integers(0, 6, 300), a)
        ids = neardup.mix(np.arange(300).astype(np.uint64) + np.uint64(rng.integers(1, 1 << 40)))
        x, y = (neardup.bagminhash(np.zeros((w > 0).sum(), np.int64), ids[w > 0], w[w > 0], 1)[0] for w in (a, b))
        errors.append((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def brute_classes(rows):
    words = {k: re.findall(r"\w+", (t or "").lower()) for k, (_, t) in enumerate(rows)}
    bags = {k: collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k, w in words.items()}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        same = (rows[a][1] or "") == (rows[b][1] or "")
        if not same and words[a] and words[b]:
            both = (bags[a] & bags[b]).total()
            same = both >= 0.8 * (bags[a].total() + bags[b].total() - both)
        if same:
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), str(least.get(find(k)))) for k, (i, _) in enumerate(rows))


def test_near_duplicates(spark, docs):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 500)}" for _ in range(200)]
    rows = [(k, t) for k, t in texts(docs).items()][:60] + [(i, t) for i, t in ODD if i != 4]
    for k in range(40):  # a star of near copies, some alike to the middle only
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(200)] = f"v{rng.randint(0, 10**6)}"
        rows.append((1000 + k, " ".join(words)))
    table = spark.createDataFrame([(i, t, "g", 1) for i, t in rows], "doc_id long, text string, label string, band int")
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.class_ids(table).collect())
    assert got == brute_classes(rows)
    kept = neardup.representatives(table)
    assert kept.columns == table.columns and kept.count() == neardup.classes(table).select("label").distinct().count()


def test_fingerprints(docs, odd):
    t = [v for _, v in sorted(texts(docs).items())]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    for (i, r), x, after in zip(sorted(got.items()), t, [*t[1:], t[0]], strict=True):
        edited = x[: len(x) - len(x) // 2] + after[: len(x) // 2]
        assert r.n_chars == len(x) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert r.fingerprint == fingerprints.fingerprint(x) and r.edited_fingerprint == fingerprints.fingerprint(edited)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    rows = fingerprints.fingerprint_documents(odd).collect()
    assert len(rows) == len(ODD) and [r.n_chars for r in rows if r.doc_id is None] == [11]


def test_prefix_hashes():
    a, b = fingerprints.PrefixHashes("xxabcabcabc\x00é"), fingerprints.PrefixHashes("abcabcabd")
    assert a.span(2, 5) == a.span(5, 8) == b.span(0, 3) != b.span(1, 4)
    assert a.common(2, b, 0) == 8 and a.common(0, b, 0) == 0 and a.common(5, a, 2) == 6


@pytest.mark.parametrize(
    "run",
    [
        lambda d: token_counts.count_documents(d, queries.RANKS, queries.PATTERN, 50256), pii.span_digests, pii.redact, sharding.assign_shards, media.round_trip,
        lambda d: packing.pack_documents(d, queries.RANKS, queries.PATTERN), lambda d: pieces.encode_digests(d, queries.PIECES), neardup.class_ids,
        neardup.representatives, fingerprints.fingerprint_documents,
        lambda d: warc.round_trip(d.sparkSession, d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))),
    ],
)
def test_empty_tables(odd, run):
    assert run(odd.limit(0)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, neardup.written(stage(spark, docs, sf), name)
        assert docs.columns == before.columns and docs.count() <= before.count(), name
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(not spans(t) for _, t in rows)
    packed = corpus_pipeline.STAGES[3][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in rows}

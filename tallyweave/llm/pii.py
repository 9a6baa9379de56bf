"""Personal data by bootstrapped contextual extraction, in DataFrame operations throughout.

Seeds are the matches of four fixed patterns (email, ip, card, phone) that pass their checks, and of a fifth
strict one (secret: access key ids, and long lower-case hexadecimal strings assigned in quotes). Looser
identifier-like strings that are no seeds are candidates. Every mention, seed or candidate, stands in up to four lexical
patterns: the word or sign before it (quotes aside), the two before it, the one before with the one after, and a sign before it
with the shape of the mention.

Patterns and instances (kind, value) form a graph that is scored in rounds. In each round a pattern is induced if
``MIN_SEEDS`` distinct accepted instances stand in it, seeds or instances found in rounds before; its
score is the mass of its accepted instances over all uses of its words in the corpus (of a sign with a shape: over
all mentions in it). An instance's score is the best of its patterns', and it is accepted from ``MIN_SCORE`` on, so that
what a round finds induces new patterns in the next. Seeds keep the score 1, candidates that fail a fixed
kind's own check 0. Both sides of a score are counted in distinct texts: copies change nothing. Common words score next to nothing.

Positions come from splitting a text at a pattern's matches: gaps and matches alternate, and sums of their
lengths give the offsets in code points. Sums are taken by blocks, so a text of very many matches costs
little more than its length. The graph's tables hold matches, never texts; nothing is collected.

Null text: empty, hence no spans. Repeated rows: each has its result. Null ids are kept. An empty table gives
no rows. Added spans never overlap a base span or each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.store import written

#: Kinds of base spans, and the kind that only the method adds.
KINDS, SECRET = ("email", "ip", "card", "phone"), "secret"
#: Fixed patterns of the four kinds. Possessive repeats and the condition on what stands before give the same
#: leftmost matches without backtracking; a card pattern's match is a whole run of digits, so shorter runs are left out.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: What every identifier contains.
ANY = "[0-9@]"
#: Identifier-like strings: anything around an @ sign, letters and digits mixed, and longer groups of digits.
CANDIDATE = (
    r"(?<![^\s@,;<>])[^\s@,;<>]++@[^\s@,;<>]++"
    r"|(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{8,}+"
    r"|(?<![A-Za-z0-9])[0-9][0-9\x20().-]{5,40}[0-9](?![A-Za-z0-9])"
)
#: Candidates of letters and digits that are seeds as they stand, or between an assignment's quotes.
SECRET_SEED, QUOTED_SEED, ASSIGNED = "^AKIA[0-9A-Z]{16}$", "^[0-9a-f]{32,}$", r'[=:]\x20?"$'
#: Words and signs of a context; quotes and white space are passed over.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}\"'`]"
BLOCK, ROUNDS = 256, 4
#: Accepted instances that a pattern needs, and the score from which an instance is accepted.
MIN_SEEDS, MIN_SCORE = 3, 0.4
#: Uses are counted in one of so many distinct texts, then in one of fewer, then in all: a pattern of a common word is settled by few texts.
SHARES = (1024, 32, 1)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often a lambda in body uses it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _starts(gaps: Column, hits: Column) -> Column:
    """The start of each hit, from alternating gaps and hits, by sums over blocks of BLOCK."""
    before = F.concat(F.array(F.lit(0)), F.transform(hits, lambda h: F.length(h)))
    steps = F.zip_with(F.transform(gaps, lambda g: F.length(g)), before, lambda g, h: (g + h).cast("long"))

    def by_block(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))

    def in_block(xs: Column, base: Column) -> Column:
        return F.transform(xs, lambda _, i: base + _total(F.slice(xs, F.lit(1), i + 1)))

    def all_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, _total)
        return _let(sums, lambda s: F.flatten(F.transform(blocks, lambda xs, b: _let(_total(F.slice(s, F.lit(1), b)), lambda base: in_block(xs, base)))))

    return _let(F.slice(steps, F.lit(1), F.size(hits)), lambda s: _let(by_block(s), all_blocks))


def _passes(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _found(text: Column, pattern: str, assigned: bool = False) -> Column:
    """Array of (start, end, hit, one, two, next) of the matches in text: the token before it, the token before
    that and the token after it, in lower case and empty if there is none; and whether it is assigned in quotes."""

    def context(gaps: Column, hits: Column) -> Column:
        n = F.size(hits)

        def before(g: Column) -> Column:
            tokens = F.regexp_extract_all(F.lower(g), F.lit(TOKEN), F.lit(0))
            extra = [F.rlike(F.right(g, F.lit(3)), F.lit(ASSIGNED)).alias("assigned")] if assigned else []
            return _let(tokens, lambda t: F.struct(F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit("")).alias("one"), F.coalesce(F.try_element_at(t, F.lit(-2)), F.lit("")).alias("two"), *extra))

        left = F.transform(F.slice(gaps, F.lit(1), n), before)
        right = F.transform(F.slice(gaps, F.lit(2), n), lambda g: F.regexp_extract(F.lower(g), rf"^[\s\"'`]*({TOKEN})", 1))
        return F.zip_with(left, right, lambda x, y: F.struct(x["one"].alias("one"), x["two"].alias("two"), y.alias("next"), *([x["assigned"].alias("assigned")] if assigned else [])))

    def each(gaps: Column, hits: Column) -> Column:
        extra = ["assigned"] if assigned else []
        known = F.zip_with(hits, context(gaps, hits), lambda h, c: F.struct(h.alias("hit"), *(c[f].alias(f) for f in ("one", "two", "next", *extra))))
        return F.zip_with(_starts(gaps, hits), known, lambda at, x: F.struct(at.alias("start"), (at + F.length(x["hit"])).alias("end"), *(x[f].alias(f) for f in ("hit", "one", "two", "next", *extra))))

    def some(gaps: Column) -> Column:
        return F.when(F.size(gaps) > 1, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: each(gaps, hits)))

    return _let(F.split(text, pattern, -1), some)


def _replaced(text: Column, kind: str, mark) -> Column:
    """text with mark(hit) for every match of a kind that passes."""

    def put(gaps: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda h: F.when(_passes(kind, h), mark(h)).otherwise(h))
        return F.when(F.size(gaps) > 1, F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")).otherwise(text)

    replaced = _let(F.split(text, PATTERNS[kind], -1), put)
    return F.when(F.contains(text, F.lit(NEEDS[kind])), replaced).otherwise(text) if kind in NEEDS else replaced


def _seeds(text: Column) -> Column:
    """The base spans of a text in order: start, rank, end, kind, value and context."""

    def of(rank: int, kind: str) -> Column:
        good = F.filter(_found(text, PATTERNS[kind]), lambda x: _passes(kind, x["hit"]))
        mine = F.transform(good, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["end"], F.lit(kind).alias("kind"), F.lower(x["hit"]).alias("value"), x["one"], x["two"], x["next"]))
        tried = F.when(F.contains(text, F.lit(NEEDS[kind])), mine) if kind in NEEDS else mine
        return F.coalesce(tried, F.array())

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def _extracted(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, row, seeds and candidates of each row. Candidates are looked for in the text with
    its seeds blotted out by as many commas. A text without digit or @ sign is passed over."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text, any_ = F.col("text"), F.rlike(F.col("text"), F.lit(ANY))

    rest = text
    for kind in KINDS:
        rest = _let(rest, lambda t: _replaced(t, kind, lambda h: F.repeat(F.lit(","), F.length(h))))
    kept = rows.select(
        "doc_id",
        F.unhex(F.md5("text")).alias("key"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.when(any_, _seeds(text)), F.array()).alias("seeds"),
        F.coalesce(F.when(any_, _let(rest, lambda t: _found(t, CANDIDATE, assigned=True))), F.array()).alias("candidates"),
    )
    return written(kept, "extracted")  # from here on a row's number is fixed


def _kinds_of(hit: Column, assigned: Column) -> Column:
    """Array of (kind, fixed) that a candidate may be of: fixed is 1 for a seed, 0 for what fails the kind's own check, else null."""
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    seed = F.rlike(hit, F.lit(SECRET_SEED)) | (assigned & F.rlike(hit, F.lit(QUOTED_SEED)))

    def one(kind: str, when: Column, fixed: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), fixed.cast("double").alias("fixed")))

    unknown = F.lit(None)
    number = F.array(
        one("ip", F.rlike(hit, F.lit(r"^[0-9]+(?:\.[0-9]+){3}$")), F.lit(0)),
        one("card", digits.between(13, 19), F.when(digits > 13, F.lit(0))),
        one("phone", digits.between(7, 15), unknown),
    )
    return (
        F.when(F.contains(hit, F.lit("@")), F.array(one("email", F.lit(True), unknown)))
        .when(F.rlike(hit, F.lit("[A-Za-z]")), F.array(one(SECRET, F.lit(True), F.when(seed, F.lit(1)))))
        .otherwise(F.filter(number, lambda x: x.isNotNull()))
    )


def _shape(value: Column) -> Column:
    """x for hexadecimal strings, else the value with runs of letters as a and of digits as 9."""
    return F.when(F.rlike(value, F.lit("^[0-9a-f]+$")), F.lit("x")).otherwise(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[0-9]+", "9"))


def _pattern_names(one: Column, two: Column, next_: Column, shape: Column) -> Column:
    """The names of the patterns of a context; shape may be null."""
    names = F.array(
        F.when(one != "", F.concat(F.lit("word "), one)),
        F.when((one != "") & (two != ""), F.concat(F.lit("two "), two, F.lit(" "), one)),
        F.when((one != "") & (next_ != ""), F.concat(F.lit("around "), one, F.lit(" "), next_)),
        F.when(F.rlike(one, F.lit(r"^[^\p{L}\p{N},.]$")) & shape.isNotNull(), F.concat(F.lit("sign "), one, F.lit(" "), shape)),
    )
    return F.filter(names, lambda x: x.isNotNull())


def _edges(extracted: DataFrame) -> DataFrame:
    """kind, value, fixed, pattern and n (occurrences in distinct texts)."""
    each = extracted.filter("size(seeds) + size(candidates) > 0").select("key", "seeds", "candidates").distinct()  # copies of a text count once
    each = written(each, "each")
    seeds = each.select(F.explode("seeds").alias("m")).select("m.kind", "m.value", F.lit(1.0).alias("fixed"), "m.one", "m.two", "m.next")
    others = each.select(F.explode("candidates").alias("m")).select(F.explode(_kinds_of(F.col("m.hit"), F.col("m.assigned"))).alias("k"), "m.*")
    mentions = seeds.unionByName(others.select("k.kind", F.lower("hit").alias("value"), "k.fixed", "one", "two", "next"))
    named = mentions.select("kind", "value", "fixed", F.explode(_pattern_names(F.col("one"), F.col("two"), F.col("next"), _shape(F.col("value")))).alias("pattern"))
    return named.groupBy("kind", "value", "pattern").agg(F.max("fixed").alias("fixed"), F.count(F.lit(1)).alias("n"))


def _uses(docs: DataFrame, possible: DataFrame, share: int = 1) -> DataFrame:
    """pattern and uses: how often the words of each possible pattern stand so in one of `share` distinct texts of docs. Tokens meet whole patterns, not
    their anchors: a common word before a rare one would let all its uses through."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    rows = rows.filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).select("row", "key", tokens.alias("t"))
    zipped = F.arrays_zip(F.concat(F.array(F.lit("")), F.col("t")).alias("two"), F.col("t").alias("one"), F.expr("slice(t, 3, size(t))").alias("next"))
    each = rows.select("row", "key", F.explode(zipped).alias("c")).select("row", "key", F.col("c.one").alias("one"), F.col("c.two").alias("two"), F.coalesce("c.next", F.lit("")).alias("next"))
    named = each.filter("one IS NOT NULL").select("row", "key", F.explode(_pattern_names(F.col("one"), F.col("two"), F.col("next"), F.lit(None))).alias("pattern"))
    by_row = named.join(possible.select("pattern"), "pattern").groupBy("row", "key", "pattern").agg(F.count(F.lit(1)).alias("n"))
    return by_row.select("key", "pattern", "n").distinct().groupBy("pattern").agg(F.sum("n").alias("uses"))


def _uses_as_needed(docs: DataFrame, possible: DataFrame) -> DataFrame:
    """pattern and uses of each possible pattern (pattern, n: the mass of its instances at most). A pattern whose uses in some of the texts already keep its score below
    MIN_SCORE gives no instance more than that, so they are counted no further: uses are all uses, or more than n / MIN_SCORE."""
    settled = None
    for share in SHARES:
        uses = possible.join(_uses(docs, possible, share), "pattern", "left").select("pattern", "n", F.coalesce("uses", F.lit(0)).alias("uses"))
        uses = written(uses, "uses")
        done = uses if share == SHARES[-1] else uses.filter(MIN_SCORE * F.col("uses") > F.col("n"))
        settled = done if settled is None else settled.unionByName(done)
        possible = uses.filter(MIN_SCORE * F.col("uses") <= F.col("n")).select("pattern", "n")
    return settled.select("pattern", "uses")


def accepted_instances(docs: DataFrame, edges: DataFrame) -> DataFrame | None:
    """kind, value and score of the accepted instances, seeds in the graph among them; None if none can be found."""
    accepted = "coalesce(score, 0) >= " + str(MIN_SCORE)
    # patterns that may be induced in some round: enough instances that do not fail, one of them no seed
    chance = edges.groupBy("kind", "pattern").agg(F.count_if(F.expr("fixed IS NULL OR fixed > 0")).alias("v"), F.count_if(F.expr("fixed IS NULL")).alias("free"), F.sum("n").alias("n"))
    possible = written(chance.filter((F.col("v") >= MIN_SEEDS) & (F.col("free") > 0)).select("kind", "pattern", "n"), "possible")
    if possible.isEmpty():
        return None
    words = possible.filter("pattern NOT LIKE 'sign %'").groupBy("pattern").agg(F.max("n").alias("n"))
    uses = possible.join(_uses_as_needed(docs, words), "pattern", "left").select("kind", "pattern", F.greatest("n", F.coalesce("uses", F.lit(0))).alias("uses"))
    graph = written(edges.join(uses, ["kind", "pattern"]).select("kind", "value", "pattern", "fixed", "n", "uses"), "graph")
    scores = graph.groupBy("kind", "value").agg(F.max("fixed").alias("score"))
    for _ in range(ROUNDS):
        known = graph.join(scores, ["kind", "value"])
        induced = known.groupBy("kind", "pattern").agg(
            F.count_if(F.expr(accepted)).alias("support"), (F.sum(F.expr(f"CASE WHEN {accepted} THEN score * n ELSE 0 END")) / F.max("uses")).alias("strength")
        )
        induced = induced.filter(F.col("support") >= MIN_SEEDS).select("kind", "pattern", "strength")
        best = graph.join(induced, ["kind", "pattern"], "left").groupBy("kind", "value").agg(F.max("fixed").alias("fixed"), F.max("strength").alias("strength"))
        scores = written(best.select("kind", "value", F.coalesce("fixed", "strength").alias("score")), "scores")
    return scores.filter(accepted)


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, seeds, added (start, rank, end, kind) and n_discovered of every row of docs. Added are the candidates whose
    value was accepted, of two kinds the better one, and secrets that are seeds; n_discovered counts those that are no seeds."""
    extracted = _extracted(docs)
    found = accepted_instances(docs, written(_edges(extracted), "edges"))
    each = extracted.select("row", F.explode("candidates").alias("c")).select("row", "c.start", "c.end", F.lower("c.hit").alias("value"), F.explode(_kinds_of(F.col("c.hit"), F.col("c.assigned"))).alias("k"))
    each = each.select("row", "start", "end", "value", "k.kind", "k.fixed")
    if found is None:
        best = each.filter("fixed = 1").withColumn("score", F.lit(1.0))
    else:
        best = each.join(found, ["kind", "value"], "left").withColumn("score", F.coalesce("fixed", "score")).filter("score > 0")
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("best.kind")).cast("int") - 1
    own = F.max(F.coalesce(F.col("fixed") == 1, F.lit(False))).alias("own")
    best = best.groupBy("row", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"), own)
    best = best.select("row", "own", F.struct("start", rank.alias("rank"), "end", "best.kind").alias("span"))
    # at most the candidates of one text
    added = best.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("added"), F.count_if(~F.col("own")).alias("n_discovered"))
    return extracted.join(added, "row", "left").select("doc_id", "key", "seeds", F.coalesce("added", F.array().cast(SPAN)).alias("added"), F.coalesce("n_discovered", F.lit(0)).alias("n_discovered"))


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of added spans, of those among them that the rounds discovered (the others are seeds of the kind secret), and of
    base spans of each kind, the digest of all base spans, and all spans."""
    found = find_spans(docs)
    base = F.transform("seeds", lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))
    kinds = F.transform("seeds", lambda s: s["kind"])
    counts = [F.size("added").cast("long").alias("n_added"), F.col("n_discovered").cast("long")] + [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_named(base), 256).alias("base_sha256"), _named(F.array_sort(F.concat(base, "added"))).alias("spans"))


def _overlap(spans: Column) -> Column:
    """Whether two of the sorted spans overlap: then two neighbours do."""
    n = F.greatest(F.size(spans) - 1, F.lit(0))
    return F.exists(F.zip_with(F.slice(spans, F.lit(1), n), F.slice(spans, F.lit(2), n), lambda a, b: b["start"] < a["end"]), lambda x: x)


def _union(placed: DataFrame) -> DataFrame:
    """of, of_key and the union of the spans of placed (of, key, spans) as a sorted array; spans that overlap become one, of the kind of
    the longest (the first of equally long)."""
    each = placed.select("of", F.col("key").alias("of_key"), F.explode("spans").alias("s")).select("of", "of_key", "s.*")
    order = Window.partitionBy("of", "of_key").orderBy("start", "rank", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = each.withColumn("opens", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    grouped = opened.withColumn("g", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("early"), (-F.col("rank")).alias("first"))
    one = grouped.groupBy("of", "of_key", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("kind", size).alias("kind"))
    return one.groupBy("of", "of_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("union"))


def _cut(text: Column, union: Column) -> Column:
    """text with sorted spans that are apart replaced by their kinds. The pieces between are taken from the text in four bytes a code
    point, where a place costs nothing to find, and joined once: linear in text and spans."""

    def built(code: Column) -> Column:
        begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(union, lambda s: s["end"]))
        ends = F.concat(F.transform(union, lambda s: s["start"]), F.array((F.octet_length(code) / 4).cast("long")))
        pieces = F.zip_with(begins, ends, lambda a, b: F.decode(F.substring(code, (4 * a + 1).cast("int"), (4 * (b - a)).cast("int")), "UTF-32"))
        marks = F.concat(F.transform(union, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))), F.array(F.lit("")))
        return F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(p, m)), "")

    return _let(F.encode(text, "UTF-32"), built)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span of text replaced by its kind in brackets, overlapping ones as one, and what then
    matches a base pattern as well."""
    columns = [F.col(f"row.{_quoted(c)}").alias(c) for c in docs.columns]
    base = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))
    found = find_spans(docs).select("doc_id", "key", F.array_sort(F.concat(base(F.col("seeds")), "added")).alias("spans"), (F.size("added") > 0).alias("more"))
    # spans of the base patterns that are apart are replaced kind by kind, all others by position
    placed = found.filter(F.col("more") | _overlap(F.col("spans"))).select(F.col("doc_id").alias("of"), "key", "spans").distinct()
    placed = written(_union(placed), "placed")
    rows = docs.select(F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("new"))
    if not placed.isEmpty():
        rows = rows.withColumn("key", F.unhex(F.md5("new"))).join(placed, F.col("row.doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
        rows = rows.select("row", F.when(F.size("union") > 0, _cut(F.col("new"), F.col("union"))).otherwise(F.col("new")).alias("new"))
    text = F.col("new")
    for kind in KINDS:
        text = _let(text, lambda t: _replaced(t, kind, lambda h: F.lit(f"[{kind.upper()}]")))
    text = F.when(F.rlike("new", F.lit(ANY)), text).otherwise(F.col("new"))
    return rows.select("row", F.when(F.col("row.text").isNotNull(), text).alias("new")).select(*(F.col("new").alias(c) if c == "text" else x for c, x in zip(docs.columns, columns, strict=True)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

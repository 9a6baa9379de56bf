"""Toxicity by a weighted finite-state pattern grammar.

Lexical transducers rewrite the words of a clause to symbols with weights: insult, threat, target, negation, reported
speech, phrase (words that labelled documents show beside insults), any other word. Sequential transducers are
composed behind them: each passes symbols on and flags insults and threats within its reach of a negation, a
report, a target or a phrase. Reach before a word is a composition run from the left; reach after it one run from the
right over its output. The grammar, a weighted acceptor, ends the cascade: a path through a
clause takes one insult or threat, whose flags choose the pattern, and must also pass ``FRAME`` other words (a target or
a phrase counts as that many), before or after. A pattern's weight in a clause is the sum over its accepting paths: a word alone,
or repeated alone, has no path and no weight. A document's score is a logistic function of the patterns' weights.

The insult transducer starts from a fixed word list and learns stems from labelled documents: prefixes that
occur in many different contexts (neighbouring words, so copies of one document count once) of toxic
documents and hardly elsewhere. Phrases are learned likewise: words beside insults more often than elsewhere. Pattern weights
are fitted to the same documents around fixed prior values.
At most ``SAMPLE`` labelled documents, half of either label, are used: the least by a hash of doc_id.
Scoring is one pass without shuffles, linear in a text; the model (stems, phrases and nine weights) goes along with the tasks.

Null or empty text: the score of a document that matches nothing. Labels other than 0 and 1 or null are not
used; of repeated labels of a document the largest counts, of rows that repeat a doc_id one is used. Without labels the prior values stand.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.store import written

SAMPLE, STEMS = 8000, 5000
THRESHOLD = 0.7
#: Stem lengths; toxic documents and different contexts that a stem needs, and its log odds by documents; the log
#: odds of its contexts among all words that it needs (phrases too), and those of full weight.
PREFIXES, MIN_DOCS, MIN_CONTEXTS, MIN_DOC_ODDS, MIN_ODDS, FULL_ODDS = range(4, 10), 3, 12, 1.5, 3.3, 6.0
#: Different insults that a phrase word stands beside.
PHRASE_INSULTS = 6

# Seeds of the transducers, by language: fixed values.
INSULTS = "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown imbecile dummkopf trottel abschaum connard imbécile ordure cretino estúpido imbécil basura".split()
THREATS = "kill murder hurt destroy strangle töten umbringen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours he him she her they them we us i me du dich dir ihr euch sie er ihn uns tu te toi vous il elle ils nous je tú usted ustedes él ella ellos nosotros yo".split()
NEGATIONS = "not no never neither nor without hardly isn't aren't don't nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás sin".split()
REPORTS = "said says say told wrote quoted called claimed sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split()

#: Labels that may be learned from.
TRAINING = "toxic IN (0, 1) AND doc_id IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 3 != 1"

PATTERNS = ("aimed_insult", "phrase_insult", "bare_insult", "negated_insult", "aimed_threat", "bare_threat", "reported")
#: Weights of the patterns and of the length.
PRIOR_BIAS, PRIOR = -4.0, np.array([4.0, 4.0, 3.5, 1.0, 4.0, 1.0, 1.0, 0.0])
#: Words over which a target, a negation, a report and a phrase reach, and the other words of an accepting path.
TARGET_REACH, NEGATION_REACH, REPORT_REACH, PHRASE_REACH, FRAME = 6, 3, 8, 1, 2
#: Words from which a stretch between signs is a clause.
SHORT = 3

WORD, CLAUSE = re.compile(r"[^\W_]+(?:'[^\W_]+)*"), re.compile(r"[^.!?;:\n]+")
#: Symbols of words; flags are added behind the first two.
INSULT, THREAT, TARGET, NEGATION, REPORT, PHRASE, OTHER = "ITPNRFo"


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: step(state, symbol) gives the next state and the symbol written."""

    start: object
    step: Callable[[object, str], tuple[object, str]]

    def __matmul__(self, then: Transducer) -> Transducer:
        """The composition: what this one writes, ``then`` reads. Its arcs are found once and kept."""

        @cache
        def step(state, symbol: str):
            a, between = self.step(state[0], symbol)
            b, out = then.step(state[1], between)
            return (a, b), out

        return Transducer((self.start, then.start), step)

    def run(self, symbols: list[str]) -> list[str]:
        state, step, out = self.start, self.step, []
        for x in symbols:
            state, y = step(state, x)
            out.append(y)
        return out


def flagging(trigger: str, reach: int, flag: str) -> Transducer:
    """Adds flag to insults and threats at most reach words after a trigger; the state counts down."""

    def step(left: int, symbol: str) -> tuple[int, str]:
        marked = symbol + flag if left and symbol[0] in (INSULT, THREAT) else symbol
        return (reach if symbol == trigger else max(0, left - 1)), marked

    return Transducer(0, step)


FORWARD = flagging(NEGATION, NEGATION_REACH, "n") @ flagging(REPORT, REPORT_REACH, "r") @ flagging(TARGET, TARGET_REACH, "a") @ flagging(PHRASE, PHRASE_REACH, "f")
BACKWARD = flagging(TARGET, TARGET_REACH, "a") @ flagging(PHRASE, PHRASE_REACH, "f")


@cache
def pattern_of(symbol: str) -> int:
    """The pattern that a flagged insult or threat makes."""
    kind, flags = symbol[0], symbol[1:]
    if "r" in flags or (kind == THREAT and "n" in flags):
        return 6
    if kind == THREAT:
        return 4 if "a" in flags else 5
    return 3 if "n" in flags else 0 if "a" in flags else 1 if "f" in flags else 2


def clause_weights(symbols: list[str], weights: dict[int, float]) -> list[tuple[int, float]]:
    """(pattern, weight) of the accepting paths of a clause; weights has those of insults and threats by position.
    All paths pass the same other words, so they are accepted or refused together."""
    frames = 0
    for x in symbols:
        frames += FRAME if x in (TARGET, PHRASE) else x not in (INSULT, THREAT)
        if frames >= FRAME:
            break
    else:
        return []
    flagged = BACKWARD.run(FORWARD.run(symbols)[::-1])[::-1]
    return [(pattern_of(flagged[k]), w) for k, w in weights.items()]


@dataclass(frozen=True)
class Model:
    """Insult stems with their weights (log odds), phrase words, and the weights of the bias, the patterns and the length."""

    stems: tuple[tuple[str, float], ...]
    weights: tuple[float, ...] = (PRIOR_BIAS, *PRIOR)
    phrases: tuple[str, ...] = ()

    def score(self, text: str | None) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], features(text, self.stems, self.phrases)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


@cache
def _lexicon(stems: tuple[tuple[str, float], ...], phrases: tuple[str, ...]):
    """The lexical transducers: an automaton over all insult and threat stems, and the symbols of other words."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for w in THREATS:
        auto.add_word(w, (len(w), THREAT, 1.0))
    for w, weight in stems:
        auto.add_word(w, (len(w), INSULT, min(1.0, weight / FULL_ODDS)))
    auto.make_automaton()
    symbols = dict.fromkeys(phrases, PHRASE)
    for kind, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)):
        symbols |= dict.fromkeys(words, kind)
    return auto, symbols


def _marks(low: str, auto) -> dict[int, tuple[str, float]]:
    """Where insults (at the start of a word) and threats (a whole word) begin, with their weights."""
    hits: dict[int, tuple[str, float]] = {}
    for end, (n, kind, weight) in auto.iter(low):
        start = end - n + 1
        if (not start or not low[start - 1].isalnum()) and (kind == INSULT or end + 1 == len(low) or not low[end + 1].isalnum()):
            hits[start] = max(hits.get(start, (kind, 0.0)), (kind, weight), key=lambda x: x[1])
    return hits


def marked_clauses(text: str | None, stems: tuple[tuple[str, float], ...], phrases: tuple[str, ...] = ()) -> Iterator[tuple[list[str], list[str], dict[int, float]]]:
    """Words, symbols and weights by position of the clauses that hold an insult or a threat. A stretch of fewer than
    SHORT words between signs is no clause of its own: it belongs to the clause before, at the start to the one after."""
    auto, symbols = _lexicon(stems, phrases)
    low = (text or "").lower()
    hits = _marks(low, auto)
    places, k = sorted(hits), 0
    words, found, weights = [], [], {}
    for stretch in CLAUSE.finditer(low) if hits else ():
        here = list(WORD.finditer(low, stretch.start(), stretch.end()))
        if len(here) >= SHORT and len(words) >= SHORT:
            if weights:
                yield words, found, weights
            words, found, weights = [], [], {}
        for w in here:
            symbol = None
            while k < len(places) and places[k] < w.end():
                if symbol is None and places[k] >= w.start():
                    symbol, weights[len(words)] = hits[places[k]]
                k += 1
            words.append(w.group())
            found.append(symbol or symbols.get(words[-1], OTHER))
    if weights:
        yield words, found, weights


def features(text: str | None, stems: tuple[tuple[str, float], ...], phrases: tuple[str, ...] = ()) -> np.ndarray:
    """log(1 + the weight of each pattern), and log(1 + the thousands of characters): the longer a text, the more it matches by chance."""
    total = [0.0] * len(PATTERNS) + [len(text or "") / 1000]
    for _, symbols, weights in marked_clauses(text, stems, phrases):
        for pattern, weight in clause_weights(symbols, weights):
            total[pattern] += weight
    return np.log1p(total)


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and toxic of the training documents: at most sample, half of either label."""
    known = labels.filter(TRAINING)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    ids = known.filter("toxic = 1").orderBy(*order).limit(sample // 2).unionByName(known.filter("toxic = 0").orderBy(*order).limit(sample // 2))
    ids = written(ids, "sample_ids")  # at most sample rows: may be broadcast
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    once = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return written(once.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")), "sample")  # copies count once


def _stems(sample: DataFrame, n: dict[int, int]) -> tuple[tuple[str, float], ...]:
    """Seeds and learned stems with their log odds."""

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                every = WORD.findall(text.lower())
                words = {w for w in every if len(w) >= PREFIXES[0]}
                counts.update((p, toxic) for p in {w[:k] for w in words for k in PREFIXES if k <= len(w)})
                counts["", toxic] += len(every)  # under the empty stem: all words
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([counts[k] * k[1] for k in keys], pa.int64()), pa.array([counts[k] * (1 - k[1]) for k in keys], pa.int64())],
            ["stem", "toxic", "clean"],
        )

    def odds(toxic: int, clean: int) -> Column:
        return F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))

    counted = sample.select("text", "toxic").mapInArrow(by_document, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = written(counted.filter(f"stem = '' OR toxic >= {MIN_DOCS}"), "prefixes")
    words = counted.filter("stem = ''").first()
    likely = counted.filter((F.col("stem") != "") & (odds(n[1], n[0]) >= MIN_DOC_ODDS)).orderBy(odds(n[1], n[0]).desc(), "stem").limit(20 * STEMS)
    stems = frozenset(r.stem for r in likely.select("stem").collect())  # at most 20 * STEMS

    def by_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = WORD.findall(text.lower())
                for k, w in enumerate(words):
                    for size in PREFIXES:
                        if size <= len(w) and w[:size] in stems:
                            found.add((w[:size], " ".join(words[max(0, k - 1) : k] + words[k + 1 : k + 2]), toxic))
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], ["stem", "context", "toxic"])

    contexts = sample.select("text", "toxic").mapInArrow(by_context, "stem string, context string, toxic int").distinct()
    counted = contexts.groupBy("stem").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    weight = odds(words.toxic, words.clean)
    good = counted.filter((F.col("toxic") >= MIN_CONTEXTS) & (weight >= MIN_ODDS)).select("stem", weight.alias("weight"), (weight * F.sqrt("toxic")).alias("gain"))
    rows = good.orderBy(F.desc("gain"), F.length("stem").desc(), "stem").limit(STEMS).collect()
    kept = {w: FULL_ODDS for w in INSULTS}
    for r in rows:  # of stems that begin alike only the best
        if not any(w.startswith(r.stem) or r.stem.startswith(w) for w in kept):
            kept[r.stem] = r.weight
    return tuple(sorted(kept.items()))


def _phrases(sample: DataFrame, stems: tuple[tuple[str, float], ...]) -> tuple[str, ...]:
    """Words that stand beside insults of toxic documents much more often than elsewhere."""

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside, everywhere = Counter(), Counter()
        for b in batches:
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                everywhere.update(WORD.findall(text.lower()))
                for words, symbols, weights in marked_clauses(text, stems) if toxic else ():
                    beside.update((words[j], words[k]) for k in weights for j in (k - 1, k + 1) if 0 <= j < len(words) and symbols[j] == OTHER)
        yield pa.RecordBatch.from_arrays([pa.array(list(everywhere), pa.string()), pa.nulls(len(everywhere), pa.string()), pa.array(list(everywhere.values()), pa.int64())], ["word", "insult", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in beside], pa.string()), pa.array([x for _, x in beside], pa.string()), pa.array(list(beside.values()), pa.int64())], ["word", "insult", "n"])

    pairs = sample.select("text", "toxic").mapInArrow(by_word, "word string, insult string, n long")
    is_beside = F.col("insult").isNotNull()
    counted = pairs.groupBy("word").agg(F.sum(F.when(is_beside, F.col("n"))).alias("beside"), F.count_distinct("insult").alias("insults"), F.sum(F.when(~is_beside, F.col("n"))).alias("n"))
    counted = written(counted, "words")
    total = counted.agg(F.sum("beside").alias("beside"), F.sum("n").alias("n")).first()
    if not total.beside:
        return ()
    odds = F.log(F.col("beside") / total.beside) - F.log(F.col("n") / total.n)
    return tuple(sorted(r.word for r in counted.filter((F.col("insults") >= PHRASE_INSULTS) & (odds >= MIN_ODDS)).orderBy(odds.desc(), "word").limit(STEMS).select("word").collect()))


def _weights(sample: DataFrame, stems: tuple[tuple[str, float], ...], phrases: tuple[str, ...], prior_odds: float) -> tuple[float, ...]:
    """Logistic weights by Newton's method, with a normal prior around PRIOR."""

    @F.pandas_udf("array<double>")
    def matched(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t, stems, phrases).tolist())

    rows = sample.select(matched("text").alias("x"), "toxic").collect()  # at most SAMPLE rows of eight numbers
    x = np.array([[1.0, *r.x] for r in rows])
    y = np.array([r.toxic for r in rows], float)
    mean, spread = np.concatenate([[PRIOR_BIAS - prior_odds], PRIOR]), np.array([6.0] * len(PRIOR) + [1.0])
    w = mean.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - (w - mean) / spread**2
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(1 / spread**2)
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    w[0] += prior_odds  # the sample is balanced, the documents are not
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents whose crc32(doc_id) mod 3 is not 1."""
    rows = _sample(docs, labels, sample)
    n = {0: 0, 1: 0} | {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n[0] or not n[1]:  # nothing to tell apart
        return Model(tuple((w, FULL_ODDS) for w in INSULTS))
    share = labels.filter(TRAINING).agg(F.avg("toxic")).first()[0]
    stems = _stems(rows, n)
    odds = math.log(max(share, 1e-4) / max(1 - share, 1e-4)) - math.log(n[1] / n[0])
    phrases = _phrases(rows, stems)
    return Model(stems, _weights(rows, stems, phrases, odds), phrases)


def score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype("float64")

    return scored(text.cast("string"))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))

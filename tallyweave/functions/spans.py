"""Matches with their places: Column builders that find, keep and rewrite what a pattern hits, without Python.

Places are code points from 0, ends exclusive. A text is marked around each match and split at the marks, so all matches of
one pattern are found in one pass; the two mark characters themselves count as spaces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.functions.ids import compact, iban_valid
from tallyweave.functions.text import let

# Signs and names of currencies, letters that scans take for digits, spaces between thousands.
CURRENCY = r"(?:rs\.?|inr|usd|eur|aed|gbp|[€$£₹])"
SPACED = r"\d{1,3}(?:[   ]\d{3})+[.,]\d{2}(?!\d)"
BEHIND = r"\s*(?:€|eur\b|zł|kr\b)"
FIGURE = r"-?\d(?:[\d.,]*\d)?"
SCANNED, MEANT = "OoIl|SBZ", "00111582"

_OPEN, _SHUT = "\u0001", "\u0002"


def _parts(c: Column, pattern: str) -> Column:
    marked = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _OPEN + _SHUT, "  "), pattern, f"{_OPEN}$0{_SHUT}")
    return F.split(marked, _OPEN)


def spans(c: Column, pattern: str) -> Column:
    """Every match, in order, as array<struct<begin, stop>>."""

    def step(done: Column, part: Column) -> Column:
        stop = done["at"] + F.instr(part, _SHUT) - 1
        found = F.array(F.struct(done["at"].alias("begin"), stop.alias("stop")))
        return F.struct((done["at"] + F.length(part) - 1).alias("at"), F.concat(done["found"], found).alias("found"))

    def walk(parts: Column) -> Column:
        none = F.array().cast("array<struct<begin:int,stop:int>>")
        start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), none.alias("found"))
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda done: done["found"])

    return let(_parts(c, pattern), walk)


def rewrite(c: Column, pattern: str, how: Callable[[Column], Column]) -> Column:
    """The text with every match replaced by what `how` makes of it."""

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(how(F.substring_index(p, _SHUT, 1)), F.substr(p, F.instr(p, _SHUT) + 1)))
        return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))

    return let(_parts(c, pattern), joined)


def cut(c: Column, begin: Column, stop: Column) -> Column:
    """The text from begin to before stop; empty if there is none."""
    return F.when(stop > begin, F.substr(c, begin + 1, stop - begin)).otherwise("")


def join_thousands(c: Column) -> Column:
    """Thousands written with a space are joined, but only beside a currency: elsewhere '1 278.61' is as often a
    quantity followed by a price."""
    closed = lambda m: F.regexp_replace(m, r"(?<=\d)[   ](?=\d{3})", "")
    ahead = rewrite(c, f"(?iu){CURRENCY}\\s*{SPACED}", closed)
    both = rewrite(ahead, f"(?iu)(?<![\\d.,]){SPACED}{BEHIND}", closed)
    return F.when(F.rlike(c, F.lit(r"\d[   ]\d{3}")), both).otherwise(F.coalesce(c, F.lit("")))  # few texts have any


def figures(c: Column) -> Column:
    """Figures of a text that stand before no percent sign: array<struct<begin, stop, token, value, money>>, places in the text with its
    thousands joined. Money is what has cents or stands beside a currency."""

    def each(t: Column) -> Column:
        def figure(s: Column) -> Column:
            token, ahead, behind = cut(t, s["begin"], s["stop"]), F.lower(cut(t, F.greatest(s["begin"] - 4, F.lit(0)), s["begin"])), cut(t, s["stop"], s["stop"] + 2)
            cents = F.rlike(token, F.lit(r"[.,]\d{2}$"))
            beside = F.rlike(ahead, F.lit(CURRENCY + r"\s*-?$")) | F.startswith(F.ltrim(behind), F.lit("€"))
            share = F.startswith(behind, F.lit("%")) | (behind == " %")
            return F.struct(s["begin"].alias("begin"), s["stop"].alias("stop"), token.alias("token"), text.parse_amount(token).alias("value"), (cents | beside).alias("money"), share.alias("share"))

        return F.filter(F.transform(spans(t, FIGURE), figure), lambda f: ~f["share"] & f["value"].isNotNull())

    return let(join_thousands(c), each)


def find_money(c: Column) -> Column:
    """The amounts of money of a text, in order: figures with cents or beside a currency, no percentages."""
    found = F.transform(F.filter(figures(c), lambda f: f["money"]), lambda f: f["value"])
    return F.when(F.rlike(c, F.lit("[0-9]")), found).otherwise(F.array().cast("array<double>"))


def _plain(pattern: str) -> str:
    """A pattern for Python's re whose digits and white space are those of Spark's."""
    return pattern.replace(r"[\d.,]", "[0-9.,]").replace(r"\d", "[0-9]").replace(r"\s", r"[ \t-\r]")


_AHEAD, _BEHIND = re.compile(f"(?i){_plain(CURRENCY)}[ \\t-\\r]*{_plain(SPACED)}"), re.compile(f"(?i)(?<![0-9.,]){_plain(SPACED)}{_plain(BEHIND)}")
_SPACE = SPACED[SPACED.index("[") : SPACED.index("]") + 1]
_SPLIT, _INNER = re.compile(f"[0-9]{_SPACE}[0-9]{{3}}"), re.compile(f"(?<=[0-9]){_SPACE}(?=[0-9]{{3}})")
_FIGURE, _BESIDE = re.compile(_plain(FIGURE)), re.compile(f"{_plain(CURRENCY)}[ \\t-\\r]*-?$")


def money_of(line: str) -> list[float]:
    """find_money of one line, for tasks that ask for it of few lines only."""
    if _SPLIT.search(line):
        closed = lambda m: _INNER.sub("", m[0])
        line = _BEHIND.sub(closed, _AHEAD.sub(closed, line.translate({1: " ", 2: " "})))
    out = []
    for m in _FIGURE.finditer(line):
        token, behind = m[0], line[m.end() : m.end() + 2]
        if behind.startswith("%") or behind == " %":
            continue
        bare = token.lstrip("-")
        cut_at = max(bare.rfind("."), bare.rfind(","))
        after, digits = len(bare) - 1 - cut_at if cut_at >= 0 else 0, bare.replace(".", "").replace(",", "")
        cents = after == 2
        if not (cents or _BESIDE.search(line[max(0, m.start() - 4) : m.start()].lower()) or behind.lstrip(" ").startswith("€")):
            continue
        if after in (0, 3):
            value = float(digits)
        elif after in (1, 2):
            value = float(f"{digits[:-after]}.{digits[-after:]}")
        else:
            continue
        out.append(-value if token.startswith("-") else value)
    return out


#: What every line with an amount of money holds: cents, or a currency's sign or name.
MAY_BE_MONEY = r"(?i)[.,]\d\d|[€$£₹]|rs|inr|usd|eur|aed|gbp"


def all_dates(c: Column) -> Column:
    """Every date that a text may mean, once each, in order; a numeric one both ways round."""
    low = F.lower(c)
    found = lambda t, p: F.arrays_zip(*(F.regexp_extract_all(t, F.lit(p), F.lit(k)).alias(f"g{k}") for k in (1, 2, 3)))
    month = F.create_map(*(F.lit(x) for pair in text.MONTHS.items() for x in pair))
    year = lambda y: F.when(y.try_cast("int") < 100, y.try_cast("int") + 2000).otherwise(y.try_cast("int"))
    number = lambda s: s.try_cast("int")
    day = lambda y, m, d: text._date(y, m, d)
    readings = [
        F.transform(found(c, text.ISO_DATE), lambda g: day(number(g["g1"]), number(g["g2"]), number(g["g3"]))),
        F.transform(found(c, text.NUMERIC_DATE), lambda g: day(year(g["g3"]), number(g["g2"]), number(g["g1"]))),
        F.transform(found(c, text.NUMERIC_DATE), lambda g: day(year(g["g3"]), number(g["g1"]), number(g["g2"]))),
        F.transform(found(low, text.DAY_MONTH_YEAR), lambda g: day(number(g["g3"]), month[g["g2"]], number(g["g1"]))),
        F.transform(found(low, text.MONTH_DAY_YEAR), lambda g: day(number(g["g3"]), month[g["g1"]], number(g["g2"]))),
    ]
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.concat(*readings)))), F.array().cast("array<date>"))


def fix_scanned_numbers(c: Column) -> Column:
    """In what looks like a number, letters that scans take for digits become these: half of it, and two at least, must be digits."""

    def fixed(token: Column) -> Column:
        digits = F.length(F.regexp_replace(token, r"\D", ""))
        return F.when(digits >= F.greatest(F.lit(2), F.floor(F.length(token) / 2)), F.translate(token, SCANNED, MEANT)).otherwise(token)

    one = f"[0-9{SCANNED}]"
    return rewrite(c, f"{one}[0-9{SCANNED}.,]*{one}", fixed)


def repair_iban(c: Column) -> Column:
    """An IBAN whose third and fourth characters are letters that stand for digits, if its checksum is right with these."""
    s = compact(c)
    fixed = F.concat(F.left(s, F.lit(2)), F.translate(F.substr(s, F.lit(3), F.lit(2)), "OoIlSBZ", "0011582"), F.substr(s, F.lit(5)))
    return F.when((F.length(s) > 4) & ~F.rlike(F.substr(s, F.lit(3), F.lit(2)), F.lit(r"^\d\d$")) & iban_valid(fixed), fixed).otherwise(s)

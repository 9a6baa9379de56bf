"""Fields of a printed document, read by rules from its lines: labels with what stands beside or below, money by arithmetic.

One pass over the lines makes rows of evidence (field, tier, line, place, value): labelled values, amounts, companies, tax ids, accounts. One
grouping by document then takes the best evidence for each field in the stated order. Only the choice among a document's amounts, which
depends on their order, is a small Arrow function over arrays of candidates; everything else is native.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from re import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import ids, text
from tallyweave.functions.spans import MAY_BE_MONEY, cut, find_money, let, money_of, repair_iban, spans
from tallyweave.operators.layout import holds_low, label_hits, lowered, under, with_neighbours

# The labels of an invoice's fields in the order in which they are tried, and what must not stand around them.
NUMBER_LABELS = (
    r"invoice\s*(?:(?:no|number|num|nr)\b|#)\.?", r"\binv\.?\s*(?:(?:no|number)\b|#)\.?", r"factuur\s*(?:nummer|nr)\.?", r"facture\s*n\s*[°º]", r"n\s*[°º]\s*de\s*facture",
    r"rechnungs?\s*(?:nr|nummer|-nr)\.?", r"bill\s*(?:no|number)\.?", r"\bfactuur\b(?!\s*(?:datum|totaal|adres))", r"\bbooking\s*id\b",
)
DATE_LABELS = (
    r"invoice\s*date", r"date\s*of\s*(?:issue|invoice)", r"factuur\s*datum", r"rechnungs\s*datum", r"date\s*(?:de|d['’])\s*facture", r"date\s*(?:de|d['’])\s*[ée]mission",
    r"facture\s*n\s*[°º]\s*\S+\s*du", r"\bissued?\b", r"\bdatum\b", r"\bdate\b",
)
OTHER_DATE = r"(due|order|check|payment|delivery|ship|expiry|valid|limite|échéance|verval)\s*-?\s*$"
TOTAL = (
    "total amount due|amount due|total due|balance due|grand total|factuur totaal|montant total|total ttc|montant ttc|somme à payer|gesamtbetrag|rechnungsbetrag|"
    "invoice total|total invoice|total for this invoice|total payable|net payable|amount payable|total facture"
).replace(" ", r"\s*")
ANY_TOTAL = r"(?<![\w-])totaa?l(?![\w-])"
NOT_TOTAL = r"^\s*[:.]?\s*(ht|excl|before|tax|vat|btw|net|untaxed|gst|hors|exkl)"
SUBTOTAL = r"exclusief\s*btw|total\s*ht|montant\s*ht|total\s*excl\w*|excl\.?\s*(?:vat|tax)|net\s*worth|untaxed|total\s*before\s*tax|taxable\s*(?:value|amount)|montant\s*eur\s*ht|grondslag"
ANY_SUBTOTAL = r"sub\s*-?\s*total|subtotaa?l|zwischensumme"
TAX = r"(?<![\w/])(?:(?:vat|tva|btw|tax)\s*(?:amount|bedrag)|vat|tva|btw|mwst|tax|gst|igst|sgst|cgst|sales\s*tax)(?![\w/])"
NOT_TAX = r"(exclusief|excl\.?|inclusief|incl\.?|before|total|sub|ex)\s*-?\s*$"
RATE_NEXT = r"^\s*\[?%"
GST_PARTS = r"(?<![\w/])(cgst|sgst|utgst|igst)(?![\w/])"
SELLER = r"(?:sold\s*by|seller|vendor|supplier|issued\s*by|service\s*provider)\s*:"
BUYER = r"bill\s*to|ship\s*to|attn|client|customer|factuuradres|afleveradres|invoice\s*to|sold\s*to|t\.a\.v"
ORDER_LABELS = (r"\bP\.?O\.?\s*(?:number|no\.?|#|ref\.?)?\s*[:#]", r"purchase\s*order(?:\s*(?:no|number|#))?\s*[:.#]?", r"\bbestelnummer\b")
COMPANY_FORMS = r"Inc|Ltd|LLC|GmbH|AG|B\.?V\.?|Pvt|Private|Limited|S\.?A\.?S?|SARL|Corp|Co|LLP|PLC|Pty|S\.?R\.?L\.?|N\.?V\.?"
DOCUMENT_WORDS = r"\b(invoice|factuur|rechnung|facture|receipt|bill|tax invoice|retail invoices?/bill)\b\.?"
HEADING = r"(?i)^(?:tax\s+)?(?:invoice|factuur|facture|rechnung|bill)\b[\s.:#-]+"
ACCOUNT = r"(bank\s*account(?:\s*(?:no|number))?|account\s*(?:no|number)|a/c\s*(?:no|number)?|acct\.?\s*no|rekening(?:nummer)?|kontonummer|n[°º]\s*de\s*compte)\s*[.:#]?\s*"
BANK_WORDS = r"bank|ifsc|iban|swift|bic\b|beneficiary|rekening|konto|banque|virement|neft|rtgs"
IBAN_LABEL = r"\bIBAN\b\s*[:.]?\s*"
IFSC = r"\b([A-Z]{4}0[A-Z0-9]{6})\b"
GSTIN = r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b"
TRN = r"\b100\d{12}\b"
VAT_LABEL = r"VAT|TVA|BTW|MwSt|USt-?Id|UStId|Tax\s*ID"
BUYERS = r"(uw|your|customer|klant|client|buyer|bill\s*to|votre)\s*$"
VAT_NUMBER_WORD = r"(?i)^[^A-Za-z0-9]{0,6}(?:No\.?|Nr\.?|number|nummer)?[^A-Za-z0-9]{0,6}"
#: What amounts may differ by, and the share of tax that a row of net, tax and gross may have.
CENTS, SAME, RATES = 0.02, 0.005, (0.003, 0.35)

#: Words of which one stands in whatever a pattern matches: most lines hold none, which is seen without it.
NEEDS = {
    **{p: (w,) for p, w in zip(NUMBER_LABELS, ("invoice", "inv", "factuur", "facture", "facture", "rechnung", "bill", "factuur", "booking"), strict=True)},
    **{p: (w,) for p, w in zip(DATE_LABELS, ("invoice", "date", "factuur", "rechnung", "facture", "mission", "facture", "issue", "datum", "date"), strict=True)},
    **dict(zip(ORDER_LABELS, (("po", "p.o"), ("purchase",), ("bestelnummer",)), strict=True)),
    TOTAL: ("total", "totaal", "due", "montant", "payer", "betrag", "payable"), ANY_TOTAL: ("total", "totaal"), SUBTOTAL: ("exclusief", "total", "montant", "excl", "net", "untaxed", "taxable", "grondslag"), ANY_SUBTOTAL: ("tota", "zwischensumme"),
    TAX: ("vat", "tva", "btw", "tax", "mwst", "gst"), SELLER: (":",), GST_PARTS: ("gst",), VAT_LABEL: ("vat", "tva", "btw", "mwst", "ust", "tax"), IBAN_LABEL: ("iban",), ACCOUNT: ("account", "a/c", "acct", "rekening", "kontonummer", "compte"),
    BUYER: ("to", "attn", "client", "customer", "adres", "t.a.v"), BANK_WORDS: ("bank", "ifsc", "iban", "swift", "bic", "beneficiary", "rekening", "konto", "banque", "virement", "neft", "rtgs"), DOCUMENT_WORDS: ("invoice", "factu", "rechnung", "receipt", "bill"),
}

_ANY_CASE = "(?iuU)"
_WORD = r"(?:[A-Z]|[a-z]-[A-Z])[\w&'’.\-]*,?\s+"
COMPANY = f"(?U)((?:{_WORD}){{0,4}}[A-Z][\\w&'’.\\-]*,?\\s+(?:{COMPANY_FORMS})\\b\\.?)"
#: The tier of what stands behind a hash, which counts only on a page that names an invoice.
HASHED = 51
EVIDENCE = "array<struct<field:string,tier:int,place:int,value:string,amount:double>>"


def identifier(c: Column) -> Column:
    """The id that a text begins with: 3 to 30 characters with a digit, no date; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(F.trim(c), r"^[\s:.#\-–]*([A-Za-z0-9][A-Za-z0-9/\-_.]{2,29})", 1), r"[./\-]+$", "")
    good = F.rlike(found, F.lit("[0-9]")) & ~F.rlike(found, F.lit(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$")) & (F.length(found) >= 3)
    return F.when(good, found)


def _some(evidence: list[Column]) -> Column:
    return F.flatten(F.array(*evidence)) if len(evidence) > 1 else evidence[0]


def _row(field: str | Column, tier: int | Column, place: Column | int, value: Column | None = None, amount: Column | None = None) -> Column:
    c = lambda x: F.lit(x) if isinstance(x, (int, str)) else x
    value, amount = F.lit(None).cast("string") if value is None else value, F.lit(None).cast("double") if amount is None else amount
    return F.struct(c(field).alias("field"), c(tier).alias("tier"), c(place).cast("int").alias("place"), value.alias("value"), amount.alias("amount"))


def _given(rows: Column) -> Column:
    return F.filter(rows, lambda r: r["value"].isNotNull() | r["amount"].isNotNull())


def _none() -> Column:
    return F.array().cast(EVIDENCE)


def _where(may: Column, rows: Column) -> Column:
    return F.when(may, rows).otherwise(_none())


#: The column of the line as lowered makes it.
LOW = "low"


def _labelled(patterns: Iterable[str]) -> Column:
    """Whether a line holds a word that one of these patterns needs: most lines are settled by this."""
    return F.rlike(LOW, F.lit("|".join(sorted({escape(w) for p in patterns for w in NEEDS[p]}))))


def _hits(labels: list[tuple[str, int, str]], left: float = 25, right: float = 70) -> Column:
    """Hits of labels (field, tier, pattern), whatever their case."""
    return label_hits([(f, t, _ANY_CASE + p) for f, t, p in labels], left, right, {_ANY_CASE + p: NEEDS[p] for _, _, p in labels}, F.col(LOW))


def _tiers(field: str, patterns: tuple[str, ...]) -> list[tuple[str, int, str]]:
    return [(field, tier, p) for tier, p in enumerate(patterns)]


def number_evidence(line: Column) -> Column:
    """Values beside and below the labels of an invoice's number, and in its heading, in the order of preference."""

    def values(h: Column) -> Column:
        below = identifier(h["below1"])
        return F.array(_row("number", h["tier"], 2 * h["begin"], identifier(h["after"])), _row("number", h["tier"], 2 * h["begin"] + 1, F.when(F.length(below) >= 6, below)))

    found = _given(F.flatten(F.transform(_hits(_tiers("number", NUMBER_LABELS)), values)))
    heading = F.regexp_extract(F.trim("text"), r"(?iu)^(?:tax\s+)?invoice\s+([A-Z0-9][A-Z0-9/\-_.]{3,})$", 1)
    hashed = F.regexp_extract("text", r"(?:^|\s)#\s*([A-Za-z0-9][A-Za-z0-9/\-_.]{3,})\s*$", 1)
    digit = lambda c: F.when(F.rlike(c, F.lit(r"\d")), c)
    top = _given(F.array(_row("number", 50, 0, digit(heading)), _row("number", HASHED, 0, digit(hashed))))
    return _some([_where(_labelled(NUMBER_LABELS), found), _where(line < 15, top)])


def date_evidence() -> Column:
    """What stands beside and below the labels of a date, where these don't name another date."""

    def values(h: Column) -> Column:
        other = F.rlike(F.right(h["before"], F.lit(14)), F.lit(_ANY_CASE + OTHER_DATE))
        return F.when(other, _none()).otherwise(F.array(_row("date", h["tier"], 2 * h["begin"], h["after"]), _row("date", h["tier"], 2 * h["begin"] + 1, h["below1"])))

    return _where(_labelled(DATE_LABELS), _given(F.flatten(F.transform(_hits(_tiers("date", DATE_LABELS)), values))))


def money_evidence() -> Column:
    """Amounts beside the labels of totals, subtotals and taxes, or else below them; tier tells them apart. What else is printed is read
    only of documents whose labelled amounts don't add up, see choose."""

    def values(h: Column) -> Column:
        ahead, tax, any_total = F.lower(F.right(h["before"], F.lit(12))), h["field"] == "tax", (h["field"] == "total") & (h["tier"] == 1)
        bad = F.endswith(ahead, F.lit("sub-")) | F.endswith(ahead, F.lit("sub ")) | (tax & (F.rlike(ahead, F.lit(_ANY_CASE + NOT_TAX)) | F.rlike(h["after"], F.lit(_ANY_CASE + RATE_NEXT))))
        bad = bad | (any_total & F.rlike(h["after"], F.lit(_ANY_CASE + NOT_TOTAL)))

        def rows(found: Column) -> Column:
            # of a tax's amounts the last one
            kept = F.when(tax & (F.size(found) > 0), F.slice(found, F.greatest(F.size(found), F.lit(1)), F.lit(1))).otherwise(found)
            return F.transform(kept, lambda v, k: _row(h["field"], h["tier"], h["begin"] * 1000 + k, amount=v))

        beside, first, second = find_money(h["after"]), find_money(h["below1"]), find_money(h["below2"])
        chosen = let(beside, lambda b: F.when(F.size(b) > 0, b).otherwise(let(first, lambda a: F.when(F.size(a) > 0, a).otherwise(second))))
        return F.when(bad, _none()).otherwise(let(chosen, rows))

    labels = [("total", 2, TOTAL), ("total", 1, ANY_TOTAL), ("subtotal", 2, SUBTOTAL), ("subtotal", 1, ANY_SUBTOTAL), ("tax", 0, TAX)]
    amounts = F.flatten(F.transform(_hits(labels, 12, 12), values))
    gst = F.regexp_extract("text", _ANY_CASE + GST_PARTS, 1)
    behind = F.get(spans(F.col("text"), _ANY_CASE + GST_PARTS), F.lit(0))["stop"]
    parts = F.filter(find_money(cut(F.col("text"), behind, F.length("text"))), lambda v: v > 0)
    part = F.array(_row("gst", 0, F.regexp_count("text", F.lit(_ANY_CASE + GST_PARTS)), F.lower(gst), F.get(parts, F.size(parts) - 1)))
    part = _where(holds_low(F.col(LOW), NEEDS[GST_PARTS]) & (gst != ""), part)
    return _where(_labelled([p for *_, p in labels] + [GST_PARTS]), _some([amounts, part]))


def vendor_evidence(line: Column) -> Column:
    """A seller behind a label, a company's name, which counts outside the buyer's lines, or the topmost words."""
    words = F.col("words")
    fine = lambda v: (F.length(v) >= 3) & ~F.rlike(v, F.lit(r"^[(*†]|\d{5,}|:\s*$"))
    strip = lambda v: F.regexp_replace(v, r"^[ ,;:]+|[ ,;:]+$", "")
    join = lambda ws: F.array_join(F.transform(ws, lambda w: w["text"]), " ")

    def labelled(h: Column) -> Column:
        last = F.get(F.filter(words, lambda w: w["begin"] + F.length(w["text"]) >= h["stop"]), F.lit(0))["begin"]
        rest = F.filter(words, lambda w: w["begin"] > last)
        label = F.get(F.filter(rest, lambda w: F.endswith(w["text"], F.lit(":"))), F.lit(0))
        beside = strip(join(F.filter(rest, lambda w: label.isNull() | (w["begin"] < label["begin"]))))
        right = F.coalesce(label["x0"] - 4, h["x1"] + 150)
        below = strip(F.coalesce(under(F.col("below1"), h["x0"], right, 25, 0), F.lit("")))
        return F.array(_row("vendor", 0, 2 * h["begin"], F.when(fine(beside), beside)), _row("vendor", 0, 2 * h["begin"] + 1, F.when(fine(below), F.left(below, F.lit(60)))))

    seller = _given(F.flatten(F.transform(_hits([("vendor", 0, SELLER)]), labelled)))
    company = F.nullif(F.regexp_replace(F.regexp_extract("text", COMPANY, 1), "^[ ,]+|[ ,]+$", ""), F.lit(""))
    top = F.regexp_replace(F.regexp_replace("text", _ANY_CASE + DOCUMENT_WORDS, ""), r"^[ .:#-]+|[ .:#-]+$", "")
    top = F.when((F.length(top) >= 3) & F.rlike(top, F.lit("[A-Za-z]{3}")) & ~F.contains(top, F.lit("@")), F.left(top, F.lit(60)))
    return _some([seller, _where(F.rlike("text", F.lit(COMPANY)), _given(F.array(_row("company", 1, 0, company)))), _where(line < 6, _given(F.array(_row("vendor", 2, 0, top))))])


def order_evidence() -> Column:
    return _where(_labelled(ORDER_LABELS), _given(F.transform(_hits(_tiers("po", ORDER_LABELS)), lambda h: _row("po", h["tier"], h["begin"], identifier(h["after"])))))


def tax_id_evidence() -> Column:
    """Indian and Emirati ids anywhere, European ones behind a label that isn't the buyer's."""
    line, high = F.col("text"), F.upper("text")
    gstin = _where(F.rlike(high, F.lit(f"(?U){GSTIN}")), F.transform(spans(high, f"(?U){GSTIN}"), lambda s: _row("tax_id", 0, s["begin"], cut(high, s["begin"], s["stop"]))))
    trn = _where(F.contains(line, F.lit("100")), F.transform(spans(line, f"(?U){TRN}"), lambda s: _row("tax_id", 1, s["begin"], cut(line, s["begin"], s["stop"]))))

    def labelled(s: Column) -> Column:
        buyers = F.rlike(cut(line, F.greatest(s["begin"] - 14, F.lit(0)), s["begin"]), F.lit(_ANY_CASE + BUYERS))
        tail = F.regexp_replace(F.substr(line, s["stop"] + 1, F.lit(40)), VAT_NUMBER_WORD, "")
        given = F.upper(F.regexp_replace(F.left(tail, F.lit(26)), r"(?U)[\s.\-]", ""))
        value = F.lit(None).cast("string")
        for country, pattern in ids.VAT.items():
            exact = F.regexp_extract(given, f"^({pattern})", 0)
            value = F.when(F.startswith(given, F.lit(country)), F.when(exact != "", exact).otherwise(F.left(given, F.lit(13)))).otherwise(value)
        return _row("tax_id", 2, s["begin"], F.when(~buyers, value))

    return _some([gstin, trn, _where(holds_low(F.col(LOW), NEEDS[VAT_LABEL]), _given(F.transform(spans(line, f"(?iu)(?:{VAT_LABEL})"), labelled)))])


def bank_evidence() -> Column:
    """IBANs behind a label, whatever their checksum, other valid ones; labelled accounts, which count where the lines around speak of a bank."""
    line, words = F.col("text"), F.col("words")

    def behind(s: Column) -> Column:
        # as many letters and digits as the country's IBANs have, over spaces
        near = F.regexp_extract(F.substr(line, s["stop"] + 1, F.lit(60)), r"^([A-Z]{2}[\p{L}\p{N} \t]*)", 1)
        packed, size = F.upper(F.regexp_replace(near, "[ \t]", "")), ids._length_of(F.left(near, F.lit(2)))
        return _row("iban", 0, s["begin"], F.when(F.length(packed) >= size, repair_iban(F.substr(packed, F.lit(1), size))))

    labelled = _where(holds_low(F.col(LOW), NEEDS[IBAN_LABEL]), F.transform(spans(line, _ANY_CASE + IBAN_LABEL), behind))
    iban = r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
    free = F.transform(spans(line, iban), lambda s: let(cut(line, s["begin"], s["stop"]), lambda v: _row("iban", 1, s["begin"], F.when(ids.looks_like_iban(v) & ids.iban_valid(v), v))))

    def account(c: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(F.trim(c), r"(?i)^\s*([A-Z]{0,4}\d[\d\s]{5,24}\d)\b", 1), r"\s", "")
        return F.when(F.length(F.regexp_replace(value, r"\D", "")) >= 6, value)

    def numbered(s: Column) -> Column:
        x0 = F.get(F.filter(words, lambda w: w["begin"] >= s["begin"]), F.lit(0))["x0"]
        below = F.array_join(F.transform(F.filter(F.coalesce(F.col("below1"), F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,text:string,begin:int>>")), lambda w: w["x1"] >= x0 - 4), lambda w: w["text"]), " ")
        return _row("account", 0, s["begin"], F.coalesce(account(cut(line, s["stop"], F.length(line))), account(below)))

    free = _where(F.rlike(line, F.lit(iban)), free)
    accounts = _where(holds_low(F.col(LOW), NEEDS[ACCOUNT]), F.transform(spans(line, _ANY_CASE + ACCOUNT), numbered))
    code = _where(F.rlike(line, F.lit(IFSC)), F.array(_row("ifsc", 0, 0, F.regexp_extract(line, IFSC, 1))))
    return _given(_some([labelled, free, accounts, code]))


def names_invoice() -> Column:
    """Whether a line is one of the first ten and names an invoice."""
    return (F.col("line") < 10) & F.rlike("text", F.lit(_ANY_CASE + r"\binvoice\b|\bfactuur\b|\brechnung\b|\bfacture\b"))


def context_evidence() -> Column:
    """Rows for lines that tell which evidence counts: a buyer's cue, words of a bank, and one of the first ten that names an invoice."""
    cue = holds_low(F.col(LOW), NEEDS[BUYER]) & F.rlike("text", F.lit(_ANY_CASE + BUYER))
    bank = holds_low(F.col(LOW), NEEDS[BANK_WORDS]) & F.rlike("text", F.lit(_ANY_CASE + BANK_WORDS))
    mark = lambda field, holds: _where(holds, F.array(_row(field, 0, 0)))
    return _some([_where(_labelled((BUYER, BANK_WORDS)), _some([mark("cue", cue), mark("bank", bank)])), mark("word", names_invoice())])


def evidence(found: DataFrame) -> DataFrame:
    """A row (doc_id, line, field, tier, place, value, amount) for every piece of evidence in the lines of documents, and for every line. What depends on
    other lines is told by rows of its own (context_evidence), so that no line is shuffled for it."""
    line = F.col("line")
    each = _some([number_evidence(line), date_evidence(), money_evidence(), vendor_evidence(line), order_evidence(), tax_id_evidence(), bank_evidence(), context_evidence(), F.array(_row("line", 0, 0, F.col("text")))])
    return with_neighbours(found).withColumn(LOW, lowered(F.col("text"))).select("doc_id", "line", F.inline(each))


# ---- money


def confirmed(totals: list[tuple[int, float]], subtotals: list[float], taxes: list[float]) -> tuple[float, float, float] | None:
    """The total, subtotal and tax that add up, of the strongest total: by its tier, then by how many totals say the same, then the first.

    Sorted taxes answer each pair of total and subtotal by binary search, all subtotals at once, so lists of n figures take
    n * n * log(n) steps at worst and mostly one total's.
    """
    if not (totals and subtotals and taxes):
        return None
    value = np.array([v for _, v in totals])
    ordered = np.sort(value)
    near = ordered[np.clip(np.searchsorted(ordered, value), 0, len(value) - 1)]
    support = np.array([int((np.abs(ordered[a:b] - v) < SAME).sum()) for v, a, b in zip(near, np.searchsorted(ordered, value - 2 * SAME), np.searchsorted(ordered, value + 2 * SAME), strict=True)])
    rank = sorted(range(len(totals)), key=lambda k: (-totals[k][0], -support[k], k))
    subs, tax = np.array(subtotals), np.array(taxes)
    order = np.argsort(tax, kind="stable")
    tax_sorted = tax[order]
    tried = set()
    for k in rank:
        total = value[k]
        if total <= 0 or total in tried:
            continue
        tried.add(total)
        low, high = np.searchsorted(tax_sorted, total - subs - 2 * CENTS), np.searchsorted(tax_sorted, total - subs + 2 * CENTS)
        for s in np.flatnonzero((subs > 0) & (high > low)):
            here = order[low[s] : high[s]]
            fits = here[(np.abs(subs[s] + tax[here] - total) <= CENTS) & (tax[here] < total)]
            if len(fits):
                return float(total), float(subs[s]), float(tax[fits.min()])
    return None


def choose(totals: list, subtotals: list, taxes: list, gst: list, lines: list) -> tuple[float | None, float | None, float | None, str | None]:
    """total, subtotal, tax and how they were found, from a document's candidates: totals and subtotals as (tier, line, amount) in
    order, taxes (line, amount), gst (line, part, amount, labels), lines (line, text), at least those with amounts; these are read only if the labelled
    amounts don't add up.

    What adds up is taken. Else a row of net, tax and gross; else the commonest of the best totals, of several the one that the page
    prints most, of these the lowest. The subtotal nearest above and the tax just below it are then reported as printed, even
    where they disagree: finding that out is another check's work.
    """
    if sum(n for *_, n in gst) >= 2 and any(v is not None for _, _, v, _ in gst):
        latest = {part: (line, v) for line, part, v, _ in sorted(gst, key=lambda g: g[0]) if v is not None}
        taxes = [(max(line for line, _ in latest.values()), round(sum(v for _, v in latest.values()), 2)), *taxes]
    if found := confirmed([(tier, v) for tier, _, v in totals], [v for _, _, v in subtotals], [v for _, v in taxes]):
        return *found, "confirmed"
    printed = [(line, v) for line, t in lines for v in money_of(t)]
    rows: dict[int, list[float]] = {}
    for line, v in printed:
        rows.setdefault(line, []).append(v)
    sums = [(a, b, c) for line in sorted(rows) for a, b, c in zip(rows[line], rows[line][1:], rows[line][2:], strict=False) if a > 0 and b > 0 and abs(a + b - c) <= CENTS and RATES[0] <= b / a <= RATES[1]]
    if sums:
        stated = [s for s in sums if any(abs(s[2] - v) < SAME for _, _, v in totals)]
        net, tax, gross = (stated or sums)[-1]
        return gross, net, tax, "row"
    best = max((tier for tier, _, _ in totals), default=0)
    pool = [(line, v) for tier, line, v in totals if tier == best and v > 0]
    if not pool:
        return None, None, None, None
    times = Counter(round(v, 2) for _, v in pool)
    left = [(line, v) for line, v in pool if times[round(v, 2)] == max(times.values())]
    if len({round(v, 2) for _, v in left}) > 1:
        page = Counter(round(v, 2) for _, v in printed)
        left = [(line, v) for line, v in left if page[round(v, 2)] == max(page[round(w, 2)] for _, w in left)]
    at = max(line for line, _ in left)
    total = next(v for line, v in left if line == at)
    beside = [v for line, v in pool if line == at]
    total = max(beside) if len(beside) > 1 else total
    net = [(line, v) for tier, line, v in subtotals if v > 0 and (tier == 2 or abs(v - total) > SAME)]
    if not net:
        return total, None, None, "label"
    above = [x for x in net if x[0] <= at] or net
    base = max(line for line, _ in above)
    subtotal = next(v for line, v in above if line == base)
    tax = next((v for line, v in taxes if v > 0 and 0 <= line - base <= 4 and v < max(total, subtotal)), None)
    return total, subtotal, tax, "label"


def _chosen(totals: pd.Series, subtotals: pd.Series, taxes: pd.Series, gst: pd.Series, lines: pd.Series) -> pd.DataFrame:
    def listed(rows, *names) -> list[tuple]:
        return [tuple(r[n] for n in names) for r in rows]

    out = [
        choose(listed(t, "tier", "line", "amount"), listed(s, "tier", "line", "amount"), listed(x, "line", "amount"), [(r["line"], r["value"], r["amount"], r["place"]) for r in g], listed(p, "line", "value"))
        for t, s, x, g, p in zip(totals, subtotals, taxes, gst, lines, strict=True)
    ]
    return pd.DataFrame(out, columns=["total", "subtotal", "tax", "rule"]).astype({"total": "float64", "subtotal": "float64", "tax": "float64"})


def choose_money(*candidates: Column | str) -> Column:
    """choose() over arrays of evidence: totals, subtotals, taxes, gst, lines."""
    return F.pandas_udf(_chosen, "total double, subtotal double, tax double, rule string")(*candidates)


def _money(found: DataFrame) -> dict[str, Column]:
    """The candidates of a document's amounts as sorted arrays, by name of their field."""
    row = F.struct(F.when(F.col("field").isin("total", "subtotal"), -F.col("tier")).otherwise(0).alias("first"), "line", "place", "tier", "amount", "value")
    return {f: F.array_sort(F.collect_list(F.when(F.col("field") == f, row))) for f in ("total", "subtotal", "tax", "gst")}


def _listed(field: str, *by: str) -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct(*by, "value"))))


def read_money(found: DataFrame) -> DataFrame:
    """doc_id, total, subtotal, tax and rule of documents, from their lines."""
    here = _where(F.rlike("text", F.lit(MAY_BE_MONEY)), F.array(_row("line", 0, 0, F.col("text"))))
    money = with_neighbours(found).withColumn(LOW, lowered(F.col("text"))).select("doc_id", "line", F.inline(_some([money_evidence(), here])))
    lists = money.groupBy("doc_id").agg(*(c.alias(f) for f, c in _money(money).items()), _listed("line", "line").alias("lines"))
    return lists.select("doc_id", choose_money("total", "subtotal", "tax", "gst", "lines").alias("m")).select("doc_id", "m.*")


def read_fields(found: DataFrame) -> DataFrame:
    """A row of fields for every document: vendor, number, inv_date, currency, subtotal, tax_amount, total, tax_id, po_number, bank_account,
    and rule, how the money was found. found: lines of documents."""
    every = evidence(found)
    order = F.struct("tier", "line", "place")

    def first(field: str, by: Column = order, only: Column | None = None) -> Column:
        of = F.when(F.col("field") == field if only is None else (F.col("field") == field) & only, F.col("value"))
        return F.min_by(of, F.when(of.isNotNull(), by)).alias(field)

    valid = F.when((F.col("field") == "tax_id") & ids.tax_id(F.col("value"))["valid"], F.col("value"))
    where = lambda field: F.collect_set(F.when(F.col("field") == field, F.col("line")))
    down, tier = F.struct("line", "place"), F.col("tier")
    read = every.groupBy("doc_id").agg(
        first("vendor", only=tier == 0).alias("seller"), first("vendor", only=tier == 2).alias("top"), _listed("company", "line").alias("companies"), where("cue").alias("cues"), where("bank").alias("banks"),
        first("number", only=tier != HASHED), first("number", only=tier == HASHED).alias("hashed"), F.max(F.col("field") == "word").alias("named"), first("po"), first("tax_id"), first("iban"), _listed("account", "line", "place").alias("accounts"), first("ifsc", down), F.min_by(valid, F.when(valid.isNotNull(), order)).alias("valid"),
        _listed("date", "tier", "line", "place").alias("dates"), _listed("line", "line").alias("lines"), *(c.alias(f"m_{f}") for f, c in _money(every).items()),
    )
    # a company in the buyer's zone, which begins with a cue and takes in the next two lines, is not the vendor; an account counts within two lines of a bank's words
    company = F.get(F.filter("companies", lambda c: ~F.exists("cues", lambda q: (q <= c["line"]) & (q >= c["line"] - 2))), F.lit(0))["value"]
    account = F.get(F.filter("accounts", lambda a: F.exists("banks", lambda q: F.abs(q - a["line"]) <= 2)), F.lit(0))["value"]
    read = read.withColumns({"vendor": F.coalesce("seller", company, "top"), "number": F.coalesce("number", F.when(F.col("named"), F.col("hashed"))), "account": account})
    read = read.withColumn("currency", text.detect_currency(F.array_join(F.transform("lines", lambda x: x["value"]), "\n")))
    # dollars put the month first
    days = F.array_compact(F.transform("dates", lambda x: text.parse_date(F.trim(x["value"]), F.coalesce(F.col("currency") == "USD", F.lit(False)))))
    bare = F.nullif(F.trim(F.regexp_replace(F.trim("vendor"), HEADING, "")), F.lit(""))
    account = F.when(F.col("ifsc").isNotNull() & F.col("account").isNotNull(), F.concat_ws(" / ", "account", "ifsc")).otherwise(F.col("account"))
    return read.withColumn("m", choose_money("m_total", "m_subtotal", "m_tax", "m_gst", "lines")).select(
        "doc_id", F.coalesce(bare, "vendor").alias("vendor"), "number", F.get(days, F.lit(0)).alias("inv_date"), "currency", F.col("m.subtotal").alias("subtotal"), F.col("m.tax").alias("tax_amount"),
        F.col("m.total").alias("total"), F.coalesce("valid", "tax_id").alias("tax_id"), F.col("po").alias("po_number"), F.coalesce("iban", account).alias("bank_account"), F.col("m.rule").alias("rule"),
    )


def number_candidates(found: DataFrame) -> DataFrame:
    """doc_id, rank and value of every value that may be an invoice's number, the best first."""
    # whether the page names an invoice is told by its rows of evidence, so that no line is shuffled for it
    word = F.when(names_invoice(), F.array(_row("word", 0, 0))).otherwise(_none())
    each = with_neighbours(found).withColumn(LOW, lowered(F.col("text"))).select("doc_id", "line", F.inline(F.concat(number_evidence(F.col("line")), word)))
    known = each.withColumn("named", F.max(F.col("field") == "word").over(Window.partitionBy("doc_id")))
    rows = known.filter((F.col("field") == "number") & ((F.col("tier") != HASHED) | F.col("named")))
    order = Window.partitionBy("doc_id").orderBy("tier", "line", "place")
    return rows.select("doc_id", F.row_number().over(order).alias("rank"), "value", F.col("tier").alias("label"), "line")

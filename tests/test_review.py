"""The checks in full and the recommendation against plain loops over a history, and known cases."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from tallyweave.functions.fuzzy import indel, partial, token_set
from tallyweave.operators import review

INVOICE = """id long, vendor string, number string, inv_date date, currency string, subtotal double, tax_amount double, total double, tax_id string, po_number string, bank_account string, status string,
    file_hash string, doc_text string, ocr boolean, line_sum double, waived array<string>, receipt boolean"""
FIELDS = [f.strip().split()[0] for f in INVOICE.split(",")]
VENDOR = "name string, tax_id string, status string, bank_account string"
ORDER = "po_number string, vendor string, currency string, amount double, invoiced double"
IBAN, OTHER, WRONG = "NL50INGB0683251309", "NL91ABNA0417164300", "NL50INGB0683251300"


def norm_number(s):
    return re.sub(r"(?<![0-9])0+(?=[0-9])", "", re.sub(r"[^a-z0-9]", "", (s or "").lower())) or "0"


def norm_vendor(s):
    return re.sub(r"[^a-z0-9 ]", " ", re.sub(r"\b(inc|ltd|llc|gmbh|ag|b\.?v|pvt|private|limited|s\.?a\.?s?|sarl|corp|co|llp|plc|pty)\b\.?", " ", (s or "").lower())).strip()


def same_vendor(a, b, cutoff):
    x, y = norm_vendor(a), norm_vendor(b)
    return bool(a and b and x and y) and token_set(x, y) >= cutoff


def parts(s):
    a, _, b = (s or "").partition("/")
    return tuple(re.sub(r"[\s.\-]", "", x).upper() for x in (a, b))


def same_account(a, b):
    (x, i), (y, j) = parts(a), parts(b)
    return bool(x and y) and x == y and not (i and j and i != j)


def on_document(name, document):
    n, flat = norm_vendor(name), re.sub(r"[^a-z0-9 ]", " ", (document or "").lower())
    if len(n) < 3 or not document:
        return False
    return bool(re.search(rf"\b{n}\b", flat)) if len(n) < 5 else partial(n, flat) >= 90


def duplicate(f, history):
    if f["file_hash"]:
        for h in history:
            if h["file_hash"] == f["file_hash"]:
                return "fail", "same_file", h["id"]
    close = lambda h, share: f["total"] is not None and h["total"] is not None and abs(f["total"] - h["total"]) <= max(0.02, share * abs(h["total"]))
    day = lambda h: f["inv_date"] and f["inv_date"] == h["inv_date"]
    if not f["number"]:
        for h in history:
            if same_vendor(f["vendor"], h["vendor"], 80) and close(h, 0) and day(h):
                return "warn", "same_amount_date", h["id"]
        return "skip", None, None
    me = norm_number(f["number"])
    for h in history:
        if h["number"] and same_vendor(f["vendor"], h["vendor"], 80) and me == norm_number(h["number"]):
            differs = f["total"] is not None and h["total"] is not None and abs(f["total"] - h["total"]) > 0.02
            return "fail", "same_number_different_amount" if differs else "same_number", h["id"]
    for h in history:
        on = norm_number(h["number"])
        if same_vendor(f["vendor"], h["vendor"], 80) and me != on and close(h, 0.005):
            if h["number"] and indel(me, on) >= 85:
                return "warn", "near_duplicate", h["id"]
            if day(h):
                return "warn", "same_amount_date", h["id"]
    for h in history:
        if h["number"] and len(me) >= 6 and indel(me, norm_number(h["number"])) >= 90 and close(h, 0) and day(h):
            return "warn", "number_amount_date", h["id"]
    return "pass", None, None


def bank(f, history, vendors):
    acct = f["bank_account"]
    if not acct:
        return "skip", None
    n = parts(acct)[0]
    if n == WRONG:
        return ("warn" if f["ocr"] else "fail"), "iban_invalid"
    rec = next((v for v in vendors if same_vendor(f["vendor"], v[0], 85)), None)
    if rec and rec[3]:
        return ("pass", None) if re.search(r"\d", rec[3]) and same_account(acct, rec[3]) else ("fail", "changed")
    earlier = [h for h in history if h["status"] == "approved" and h["bank_account"] and same_vendor(f["vendor"], h["vendor"], 80)]
    if earlier and not any(same_account(acct, h["bank_account"]) for h in earlier):
        return "fail", "changed"
    if any(v[3] and same_account(acct, v[3]) and not same_vendor(f["vendor"], v[0], 85) for v in vendors):
        return "warn", "shared"
    if earlier:
        return "pass", None
    return ("warn", "new") if rec else ("pass", None)


def order(f, orders):
    if not f["po_number"]:
        return "skip", None
    o = next((orders[k] for k in (f["po_number"], f["po_number"].upper(), f["po_number"].lower()) if k in orders), None)
    if not o:
        return "warn", "po_unknown"
    left, t = o[2] - (o[3] or 0.0), f["total"]
    if t is not None and t > left * 1.02 + 0.02:
        return "fail", "remaining"
    if not (same_vendor(f["vendor"], o[0], 70) or on_document(o[0], f["doc_text"])):
        return "warn", "other_vendor"
    if f["receipt"] is False:
        return "fail", "receipt_problem"
    if (t is not None and t > left + 0.02) or (o[1] and f["currency"] and o[1] != f["currency"]):
        return "warn", "issues"
    return "pass", "received" if f["receipt"] else None


def vendor(f, vendors):
    if not f["vendor"]:
        return "skip", None
    rec = next((v for v in vendors if same_vendor(f["vendor"], v[0], 85)), None)
    if not rec:
        return "warn", "new"
    a, b = (re.sub(r"[^A-Z0-9]", "", (x or "").upper()) for x in (rec[1], f["tax_id"]))
    if a and b and a != b and re.sub(r"^[A-Z]{1,2}", "", a) != re.sub(r"^[A-Z]{1,2}", "", b):
        return "fail", "tax_id"
    return {"rejected": ("fail", "rejected"), "pending": ("warn", "pending"), "verified": ("warn", "awaiting_approval")}.get(rec[2] or "approved", ("pass", None))


def arithmetic(f):
    t, s, x, items = f["total"], f["subtotal"], f["tax_amount"], f["line_sum"]
    if t is not None and t <= 0:
        return "fail", "not_payable"
    problems, verified = False, False
    if None not in (t, s, x):
        gap = t - s - x
        shipping = 12.5 if "Shipping" in (f["doc_text"] or "") else None
        fits = abs(gap) <= 0.02 or (shipping is not None and abs(gap - shipping) <= 0.02)
        verified, problems = verified or fits, problems or not fits
    if items is not None and (s is not None or t is not None):
        fits = any(v is not None and abs(items - v) <= 0.02 for v in (s, t))
        verified, problems = verified or fits, problems or not fits
    return ("warn", "scanned") if problems and f["ocr"] else ("fail", None) if problems else ("pass", None) if verified else ("skip", None)


def complete(f):
    excused = [n for n in (f["waived"] or []) if n in ("number", "inv_date") and f[n] in (None, "")]
    if any(f[n] in (None, "") and n not in excused for n in ("number", "total")):
        return "fail", None
    if any(f[n] in (None, "") and n not in excused for n in ("vendor", "inv_date", "currency")):
        return "warn", None
    return ("warn", "waived") if excused else ("pass", None)


def samples(n, seed):
    rng = random.Random(seed)
    names = ["Coolblue B.V.", "COOLBLUE", "Cool Blue", "Coolbleu", "Oravel Stays Pvt. Ltd.", "Oravel Stays", "Hema", "Hema Services Ltd", "Northern Services Inc", "Northern Service", "Zeta", None, ""]
    vendors = sorted([("Coolblue", "NL810433941B01", "approved", IBAN), ("Hema", None, None, None), ("Northern Services", "DE232446240", "pending", "Direct debit"), ("Oravel Stays", "06AABCO6063D1ZQ", rng.choice(["rejected", "verified", "approved"]), "12345678 / HDFC0000003")], key=lambda v: v[0])
    orders = {"PO-1": ("Coolblue", "EUR", 1000.0, 100.0), "po-2": ("Oravel", None, 300.0, None), "PO-3": ("Somebody Else", "USD", 5000.0, 0.0), "PO-4": (None, "EUR", 500.0, 0.0)}
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.35:
            f = dict(rng.choice(rows), id=k, status=rng.choice(["approved", "pending"]))
            for name, values in (("number", ["X"]), ("total", [0.3]), ("vendor", names), ("inv_date", [date(2024, 1, 1 + rng.randrange(4))])):
                if rng.random() < 0.3:
                    f[name] = (f["number"] or "INV") + "7" if name == "number" else (f["total"] or 10.0) * rng.choice([1.0, 1.003, 1.02]) if name == "total" else rng.choice(values)
            f["file_hash"] = f["file_hash"] if rng.random() < 0.2 else f"h{k}"
        else:
            sub = rng.choice([100.0, 100.0, 250.0, 999.99, None, 60000.0])
            f = {
                "id": k, "vendor": rng.choice(names), "number": rng.choice([None, "", f"INV-{rng.randrange(40):04d}", f"inv {rng.randrange(40)}", f"2024/{rng.randrange(99999):05d}"]), "inv_date": rng.choice([None, date(2024, 1, 1) + timedelta(rng.randrange(4))]),
                "currency": rng.choice([None, "", "EUR", "EUR", "USD"]), "subtotal": sub, "tax_amount": rng.choice([None, 21.0, 0.0]), "total": rng.choice([None, -1.0, (sub or 50.0) + 21.0, (sub or 50.0) + 21.0, (sub or 50.0) + 33.5, sub]),
                "tax_id": rng.choice([None, "", "NL810433941B01", "810433941B01", "06AABCO6063D1ZP", "DE1"]), "po_number": rng.choice([None, "", "PO-1", "po-1", "PO-2", "PO-3", "PO-4", "PO-9"]),
                "bank_account": rng.choice([None, "", IBAN, "NL50 INGB 0683 2513 09", OTHER, WRONG, "12345678/HDFC0000003", "12345678", "12345678 / ICIC0000003"]), "status": rng.choice(["approved", "approved", "pending"]), "file_hash": rng.choice([None, "", f"h{k}"]),
                "doc_text": rng.choice([None, "", "Shipping 12.50\nthank you", "from somebody else ltd", "Invoice of Oravel"]), "ocr": rng.choice([None, True, False]), "line_sum": rng.choice([None, sub, 7.0]),
                "waived": rng.choice([None, [], ["number"], ["number", "inv_date"], ["total"]]), "receipt": rng.choice([None, True, False]),
            }
        rows.append(f)
    return rows, vendors, orders


def test_checks_equal_plain_loops(spark):
    for seed in (1, 2):
        rows, vendors, orders = samples(220, seed)
        invoices = spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], INVOICE).repartition(3)
        full = review.review(invoices, spark.createDataFrame(vendors, VENDOR), spark.createDataFrame([(k, *v) for k, v in orders.items()], ORDER))
        got = {r.id: r for r in full.collect()}
        assert len(got) == len(rows)
        for k, f in enumerate(rows):
            r, history = got[k], rows[:k]
            assert tuple(r.duplicate) == duplicate(f, history), (seed, f)
            for name, want in (("completeness", complete(f)), ("math", arithmetic(f)), ("vendor", vendor(f, vendors)), ("po_match", order(f, orders)), ("bank", bank(f, history, vendors))):
                assert (r[name].status, r[name].kind) == want, (seed, name, f)
        kinds = {(n, r[n].status, r[n].kind) for r in got.values() for n in review.CHECKS}
        assert len(kinds) >= 35
        long = review.checks(full)
        assert long.count() == 7 * len(rows)


def test_crowded_bands_and_numbers_equal_pairs(spark, monkeypatch):
    """Crowded bands and numbers of very many names are met by other ways than pairs, with the same results; what was reviewed is not planned again."""
    rows, vendors, orders = samples(120, 3)
    history = [f | {"file_hash": None} for f in rows]
    monkeypatch.setattr(review, "FEW", 1)
    monkeypatch.setattr(review, "CROWDED", 1)
    full = review.review(spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in history], INVOICE), spark.createDataFrame(vendors, VENDOR), spark.createDataFrame([(k, *v) for k, v in orders.items()], ORDER))
    got = {r.id: tuple(r.duplicate) for r in full.collect()}
    assert got == {k: duplicate(f, history[:k]) for k, f in enumerate(history)}
    assert "Join" not in full._jdf.queryExecution().toString()


def test_recommendations(spark):
    base = {"id": 1, "vendor": "Coolblue B.V.", "number": "993548900", "inv_date": date(2024, 1, 1), "currency": "EUR", "subtotal": 100.0, "tax_amount": 21.0, "total": 121.0, "tax_id": "NL810433941B01", "po_number": None, "bank_account": IBAN, "status": "pending", "file_hash": "a", "doc_text": None, "ocr": False, "line_sum": None, "waived": None, "receipt": None}
    cases = [{}, {"number": "1001", "total": 60021.0, "subtotal": 60000.0}, {"number": "1002", "bank_account": OTHER}, {"number": "1003", "bank_account": OTHER, "total": 120.0}, {"number": None}, {"number": "1004", "vendor": "Unknown Traders", "bank_account": None}, {"number": "1005", "tax_id": "DE232446240"}, {}]
    rows = [dict(base, id=k, file_hash=f"h{k}", **{"inv_date": date(2024, 1, k + 1)} | c) for k, c in enumerate(cases)]
    vendors = spark.createDataFrame([("Coolblue", "NL810433941B01", "approved", IBAN)], VENDOR)
    full = review.review(spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], INVOICE), vendors, spark.createDataFrame([], ORDER))
    got = {r.id: (r.outcome, r.confidence, list(r.reasons)) for r in review.decide(full).collect()}
    assert got[0][:2] == ("auto_approve", "high") and "bank" in got[0][2]
    assert got[1] == ("needs_review", "medium", ["amount"])
    assert got[2] == ("reject", "high", ["bank:changed"])
    assert got[3][:2] == ("reject", "high") and got[3][2] == ["bank:changed", "math"]
    assert got[4][:2] == ("needs_review", "low") and got[4][2] == ["completeness", "duplicate"]
    assert got[5] == ("needs_review", "low", ["vendor:new"])
    assert got[6] == ("reject", "medium", ["vendor:tax_id"])
    assert got[7] == ("reject", "high", ["duplicate:same_number"])
    assert review.decide(full.limit(0)).count() == 0
    assert full.select(F.count(F.lit(1))).first()[0] == len(cases)


def test_only_invoices_beside_a_crowded_band_are_taken_apart(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(review, "near_numbers", lambda left, right, on, cutoff, whole=review.near_numbers: (asked.append(left), whole(left, right, on, cutoff))[1])
    day = [f"2024-01-{1 + k % 28:02d}" for k in range(60)]
    crowd = [(k, "acme", f"X{k * k:05d}", day[k], 100.0) for k in range(60)] + [(100, "acme", "Y77", day[0], 900.0), (101, "acme", "Z5", day[1], 900.1), (102, "acme", "W123456", day[2], 100.2), (103, "acme", "X00049", day[3], 100.1)]
    rows = spark.createDataFrame([(*r, None) for r in crowd], "id long, name string, number string, day string, total double, file_hash string").withColumn("inv_date", F.col("day").cast("date"))
    alike = spark.createDataFrame([("acme", "acme")], "a string, b string")
    shown = lambda: sorted((r.id, r.tier, r.kind, r.match_id) for r in review.duplicates(rows, alike).collect())
    paired = shown()
    assert asked.pop().isEmpty()
    monkeypatch.setattr(review, "CROWDED", 20)
    assert shown() == paired and {r.id for r in asked.pop().select(F.regexp_extract("n", "([0-9]+)", 1).cast("int").alias("id")).distinct().collect()}.isdisjoint({77, 5}) and paired

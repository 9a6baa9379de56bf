"""Names on documents against all pairs, and the three tiers of the approved vendor."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from tallyweave.functions.fuzzy import partial
from tallyweave.operators import printed_names


def on_document(name, document, cutoff=90):
    if len(name) < 3 or not document:
        return False
    return bool(re.search(rf"\b{name}\b", document)) if len(name) < 5 else partial(name, document) >= cutoff


def test_names_equal_all_pairs():
    rng = random.Random(3)
    letters = "abcdeo rs"
    names = sorted({" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 25))).split()) for _ in range(150)})

    def spoilt(name):
        out = list(name)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(out) + 1)
            if rng.random() < 0.5 and at < len(out):
                del out[at]
            else:
                out.insert(at, rng.choice(letters))
        return "".join(out)

    index, found = printed_names.Index(names), 0
    for _ in range(250):
        document = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 10, 60]))) + "".join(spoilt(rng.choice(names)) + rng.choice(["", " "]) for _ in range(rng.randrange(4)))
        want = [n for n in names if on_document(n, document)]
        assert sorted(index.printed(document)) == want, document
        found += len(want)
    assert found > 200


def test_a_frequent_word_brings_few_names():
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(12)) + " traders" for _ in range(5000)})
    index, asked = printed_names.Index(names), 0
    near = index.near

    def counted(*given):
        nonlocal asked
        asked += 1
        return near(*given)

    index.near = counted
    began = time.time()
    for k in range(100):
        spoilt = names[k][:3] + names[k][4:9] + "z" + names[k][9:]
        assert names[k] in index.printed(f"tax invoice from {spoilt} to a buyer of some goods")
        assert index.printed("wholesale traders of the north and all of their goods") == []
    assert asked < 100 * 200 and time.time() - began < 20


def test_a_long_text_takes_linear_time():
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefghij") for _ in range(14)) + " traders" for _ in range(300)]
    index = printed_names.Index(names)
    document = "".join(rng.choice("abcdefghij ") for _ in range(400_000)) + names[7]
    began = time.time()
    assert names[7] in index.printed(document)
    assert time.time() - began < 20


def test_three_tiers(spark):
    vendors = spark.createDataFrame([("Coolblue B.V.", "NL810433941B01"), ("Coolblue Nederland", None), ("Oravel Stays Pvt. Ltd.", "06AABCO6063D1ZQ"), ("Hema", "X1"), (None, "Z9"), ("", None)], "name string, tax_id string")
    rows = [
        (1, "COOLBLUE", None, "Oravel Stays"), (2, "Oyo Rooms", "06aabco 6063D1ZQ", "Coolblue Nederland"), (3, None, None, "thank you\nOravel  Stays! pvt"), (4, "", "", "from coolblue and to oravel stays"),
        (5, "Somebody", "unknown", "the hema store"), (6, "Somebody", None, "themata"), (7, None, None, None), (None, "Hema", None, None),
    ]
    documents = spark.createDataFrame(rows, "doc_id long, vendor string, tax_id string, text string")
    got = printed_names.approved_vendor(documents, documents, vendors).collect()
    tiers = {r.doc_id: (r.vendor, r.tier) for r in got if r.doc_id}
    assert tiers == {1: ("Coolblue B.V.", 1), 2: ("Oravel Stays Pvt. Ltd.", 2), 3: ("Oravel Stays Pvt. Ltd.", 3), 4: (None, None), 5: ("Hema", 3), 6: (None, None), 7: (None, None)}
    some = printed_names.names_on_documents(documents, vendors, at_once=1)
    assert {(r.doc_id, r.name) for r in some.collect()} >= {(3, "oravel stays"), (5, "hema")}


def test_alike_names_of_a_large_list_count_as_one_vendor(spark):
    # of the generated names of 6000 suppliers these are alike at 85, and on a page at 90: the first by name is the vendor, and two on a page are no answer
    vendors = spark.createDataFrame([("Daeytkottamn Commerce B.V.", None), ("Daeytuttamnr Commerce B.V.", None), ("Faiysuymrubo Supplies Inc", None)], "name string, tax_id string")
    rows = [(1, "Daeytuttamnr Commerce B.V.", None, ""), (2, None, None, "Daeytuttamnr Commerce B.V.\nInvoice"), (3, None, None, "Faiysuymrubo Supplies Inc\nInvoice")]
    documents = spark.createDataFrame(rows, "doc_id long, vendor string, tax_id string, text string")
    got = {r.doc_id: (r.vendor, r.tier) for r in printed_names.approved_vendor(documents, documents, vendors).collect()}
    assert got == {1: ("Daeytkottamn Commerce B.V.", 1), 2: (None, None), 3: ("Faiysuymrubo Supplies Inc", 3)}


def test_a_proposed_vendor_is_the_first_alike(spark):
    from tallyweave.operators import matching

    listed = spark.createDataFrame([("Ravuekuotrmo Traders Pvt Ltd",), ("Ravekuotrmor Traders Pvt Ltd",), ("Kauvvaueunll Supplies Inc",)], "name string")
    asked = spark.createDataFrame([(2272, "RAVUEKUOTRMO TRADERS PVT LTD"), (6630, "KAUVOVAUEULL SUPPLIES INC"), (1, "DAETVIKEOTEE HANDEL GMBH")], "id long, vendor string")
    got = {r.id: r.match for r in matching.first_vendor(asked, listed, 92).collect()}
    assert got == {2272: "Ravekuotrmor Traders Pvt Ltd", 6630: "Kauvvaueunll Supplies Inc", 1: None}


def test_texts_are_made_of_open_documents_only(spark):
    vendors = spark.createDataFrame([("Hema", "X1"), ("Coolblue B.V.", None)], "name string, tax_id string")
    documents = spark.createDataFrame([(1, "Hema", None), (2, None, "x1"), (3, None, None)], "doc_id long, vendor string, tax_id string")
    asked = []

    def texts(open_):
        asked.extend(r.doc_id for r in open_.collect())
        return open_.withColumn("text", F.lit("coolblue"))

    got = {r.doc_id: (r.vendor, r.tier) for r in printed_names.approved_vendor(documents, texts, vendors).collect()}
    assert asked == [3] and got == {1: ("Hema", 1), 2: ("Hema", 2), 3: ("Coolblue B.V.", 3)}

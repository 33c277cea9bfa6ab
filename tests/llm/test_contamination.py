import random
import re
import unicodedata

import numpy as np
import pytest

from lexiweave.llm import contamination as ct

DOCS = "doc_id long, text string, item_id string, pos string, t string"
ITEMS = "item_id long, text string, doc_id string"


def plain(text):
    t = unicodedata.normalize("NFKD", text or "")
    t = "".join(c for c in t if not 0x300 <= ord(c) <= 0x36F).lower()
    return re.findall(r"[^\W_]+", t)


def brute(docs, items, n):
    def grams(t):
        w = plain(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    own = {i: grams(t) for i, t, *_ in items}
    return {(d, i) for d, t, *_ in docs for i, g in own.items() if d is not None and i is not None and g & grams(t)}


def data():
    rng = random.Random(6)
    words = [f"wörd{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 25))), "c") for i in range(60)]
    items += [(61, None, ""), (62, "", ""), (63, "short text", ""), items[3], (64, items[3][1], "")]
    docs = []
    for d in range(300):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(60)))
        if d % 4 == 0:
            w = (items[rng.randrange(60)][1] or "").split()
            a = rng.randrange(max(1, len(w) - 6))
            t += " " + rng.choice([", ", " - ", "\n"]).join(w[a : a + 12]).upper() + " end"
        docs.append((d, t, "i", "p", "t"))
    docs += [(900, None, "", "", ""), (901, "", "", "", ""), docs[0], (902, "filler " * 30_000 + items[0][1], "", "", ""), (None, items[0][1], "", "", "")]
    return docs, items


@pytest.mark.parametrize("limit", [10_000, 0])
def test_against_brute_force(spark, limit):
    docs, items = data()
    got = ct.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), n=6, max_broadcast=limit)
    rows = [(r.doc_id, r.item_id) for r in got.collect()]
    assert set(rows) == brute(docs, items, 6) and len(rows) == len(set(rows)) > 20


def test_windows_do_not_cross_texts():
    grams = ct.NgramSet([(1, "a b c d".split())], 4)
    assert grams.find(["a b".split(), "c d".split()]) == []
    assert grams.find([["x"], "z a b c d a b c d".split()]) == [(1, 1, (1,)), (1, 5, (1,))]


def test_filter_keeps_every_hash_and_few_others():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2)
    f = ct.BitFilter.of(h)
    assert len(f.has(h)) == len(h)
    assert len(f.has(rng.integers(0, 2**63, 100_000, dtype=np.uint64))) < 1000


def test_parts_of_the_filter_make_the_whole(spark, monkeypatch):
    monkeypatch.setattr(ct, "FILTER_PART", 1 << 10)
    grams = [" ".join(f"w{i * 7 + j}" for j in range(4)) for i in range(500)]
    made = ct._bit_filter(spark.createDataFrame([(g, 1) for g in grams], "gram string, item long"), 4)
    want = ct.BitFilter.of(ct.window_hashes([g.split() for g in grams], 4)[2])
    assert len(made.packed) > (1 << 10) // 8 and (made.packed == want.packed).all()


def test_word_spans_follow_the_text():
    t = "Café  ﬁne-№5 “Ünder_score”"
    assert [ct.normal_form(t[a:b]) for a, b in ct.word_spans(t)] == ct.words(t)


def test_removal(spark):
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Start. ONE, two; thrée four five six. End", 5), (2, "nothing here", 6), (3, None, 7)], "doc_id long, text string, removed int")
    got = {r.doc_id: r for r in ct.remove_leaks(docs, items, n=4).collect()}
    assert got[1].text == "Start.  six. End" and got[1].removed_chars == len("ONE, two; thrée four five")
    assert got[2].text == "nothing here" and got[2].removed_chars == 0 and got[3].text is None
    assert {r.doc_id for r in ct.remove_leaks(docs, items, mode="documents", n=4).collect()} == {2, 3}


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert ct.leaks(docs, items).collect() == []
    full = data()
    assert ct.leaks(spark.createDataFrame(full[0], DOCS), items).collect() == []
    assert ct.leaks(docs, spark.createDataFrame(full[1], ITEMS)).collect() == []

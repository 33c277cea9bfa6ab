import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexiweave.core import sizing
from lexiweave.llm import cooccur

SCHEMA = "b long, items array<string>, item string, count int"


def brute(rows, together, lift):
    baskets = {}
    for b, items, *_ in rows:
        if b is not None and items:
            baskets.setdefault(b, set()).update(x for x in items if x is not None)
    baskets = {b: s for b, s in baskets.items() if s}
    n, one, two = len(baskets), Counter(), Counter()
    for s in baskets.values():
        one.update(s)
        two.update(combinations(sorted(s), 2))
    return {
        (a, b): (t, one[a], one[b], n, t * n / (one[a] * one[b]))
        for (a, b), t in two.items()
        if t >= together and t * n >= lift * one[a] * one[b]
    }


def data(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        items = [rng.choice(["the", "a", None, *[f"w{rng.randrange(60)}" for _ in range(4)]]) for _ in range(rng.randrange(6))]
        rows.append((i, items + (["the"] if rng.random() < 0.5 else []) + (["é", "É"] if i % 40 == 0 else []), "x", 3))
    return [*rows, *rows[:40], (None, ["a", "b"], "", 0), (9999, None, "", 0), (9998, [], "", 0), (9997, ["alone", "alone"], "", 0)]


@pytest.mark.parametrize("together, lift, bound", [(1, 0.0, None), (3, 2.0, None), (3, 10.0, None), (2, 1.5, 0)])
def test_against_brute_force(spark, monkeypatch, together, lift, bound):
    if bound is not None:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", bound)
    rows = data()
    got = cooccur.cooccurrence(spark.createDataFrame(rows, SCHEMA), "b", F.col("items"), together, lift).collect()
    want = brute(rows, together, lift)
    assert {(r.item_a, r.item_b): (r.together, r.count_a, r.count_b, r.baskets) for r in got} == {k: v[:4] for k, v in want.items()}
    for r in got:
        assert r.lift == pytest.approx(want[r.item_a, r.item_b][4]) and r.pmi == pytest.approx(math.log(r.lift))


@pytest.mark.parametrize("together, lift, bound", [(1, 0.0, None), (2, 1.5, 0)])
def test_baskets_cut_into_blocks(spark, monkeypatch, together, lift, bound):
    if bound is not None:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(cooccur, "ONE_ROW", 4)
    monkeypatch.setattr(cooccur, "PAIR_BLOCK", 2)
    rows = [*data(), (50, [f"w{i}" for i in range(60)], "", 0)]
    got = cooccur.cooccurrence(spark.createDataFrame(rows, SCHEMA), "b", F.col("items"), together, lift).collect()
    assert {(r.item_a, r.item_b): (r.together, r.count_a, r.count_b, r.baskets) for r in got} == {k: v[:4] for k, v in brute(rows, together, lift).items()}


def test_large_basket(spark):
    rows = [(1, [f"w{i}" for i in range(400)], "", 0)]
    assert cooccur.cooccurrence(spark.createDataFrame(rows, SCHEMA), "b", F.col("items")).count() == 400 * 399 // 2


def test_empty(spark):
    assert cooccur.cooccurrence(spark.createDataFrame([], SCHEMA), "b", F.col("items")).collect() == []

import random

import pytest
from pyspark.sql import functions as F

from lexiweave.core import sizing
from lexiweave.llm import topn

SCHEMA = "g long, word string, s double, side string, rank int"


def brute(rows, n):
    out = set()
    groups = {}
    for g, w, s, *_ in set(rows):
        if s is not None and s == s and abs(s) != float("inf"):
            groups.setdefault(g, set()).add((w, s))
    for g, items in groups.items():
        last = [(w is None, w or "", s) for w, s in items]
        for side, sign in (("top", -1), ("bottom", 1)):
            for k, (nul, w, s) in enumerate(sorted(last, key=lambda x: (sign * x[2], x[0], x[1]))[:n]):
                out.add((g, side, None if nul else w, s + 0.0, k + 1))
    return out


def random_rows(seed, n=4000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = 1 if rng.random() < 0.4 else rng.choice([None, *range(2, 40)])
        s = rng.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 0.5, 0.5, rng.gauss(0, 1), rng.gauss(0, 1e-300), rng.gauss(0, 1e200)])
        rows.append((g, rng.choice([None, f"w{rng.randrange(4000)}"]) if i % 50 == 0 else f"w{i}", s, "x", 7))
    return rows + rows[:400]


@pytest.mark.parametrize("n, bound", [(5, None), (40, None), (5, 0)])
def test_against_brute_force(spark, monkeypatch, n, bound):
    if bound is not None:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", bound)
    rows = random_rows(n)
    got = topn.top_n_per_group(spark.createDataFrame(rows, SCHEMA), ["g"], "s", ["word"], n)
    assert {(r.g, r.side, r.word, r.s + 0.0, r["rank"]) for r in got.collect()} == brute(rows, n)
    assert got.count() == len(brute(rows, n))


def test_repeated_rows_do_not_lift_the_threshold(spark):
    rows = [(1, "best", 9.0, "", 0)] * 50 + [(1, f"w{i}", float(i) / 10, "", 0) for i in range(20)]
    got = topn.top_n_per_group(spark.createDataFrame(rows, SCHEMA), ["g"], "s", ["word"], 3, ("top",))
    assert [(r.word, r["rank"]) for r in got.orderBy("rank").collect()] == [("best", 1), ("w19", 2), ("w18", 3)]


def test_bins_never_fall(spark):
    xs = sorted([0.0, 1e-320, -1e-320, 1.0, -1.0, 1e308, -1e308, 0.999999999999, 1.0000000001, *[random.Random(2).gauss(0, 10) for _ in range(500)]])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", topn.score_bin(F.col("x")).alias("b"))
    bins = [r.b for r in df.orderBy("i").collect()]
    assert bins == sorted(bins)


def test_empty(spark):
    assert topn.top_n_per_group(spark.createDataFrame([], SCHEMA), ["g"], "s", ["word"], 5).collect() == []
    with pytest.raises(ValueError):
        topn.top_n_per_group(spark.createDataFrame([], SCHEMA), ["g"], "s", ["word"], 0)

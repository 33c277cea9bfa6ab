import random
from statistics import median

import pytest

from lexiweave.operators import graph, stats
from lexiweave.plans import anchors


@pytest.mark.parametrize("bins", [3, 4096])
def test_medians(spark, monkeypatch, bins):
    monkeypatch.setattr(stats, "BINS", bins)
    rng = random.Random(4)
    groups = {
        0: [rng.random() for _ in range(501)], 1: [rng.choice([1.0, 2.0, 2.0, 9.5]) for _ in range(400)], 2: [5.0], 3: [1.0, 2.0], 4: [0.0] * 300 + [1e9],
        5: [rng.lognormvariate(0, 4) for _ in range(200)],
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [(0, None), (6, None), (0, float("nan"))]
    got = {r.k: r["median"] for r in stats.medians(spark.createDataFrame(rows, "k int, v double"), "k", "v").collect()}
    assert got == {k: pytest.approx(median(xs)) for k, xs in groups.items()}


def test_closure_of_a_long_chain_and_a_cycle(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("a", "b"), ("b", "a")]
    got = {(r.descendant, r.ancestor): r.depth for r in graph.closure(spark.createDataFrame(chain, "c string, p string"), "c", "p").collect()}
    assert got["n00", "n30"] == 30 and got["a", "b"] == 1 and got["a", "a"] == 0 and len(got) == 31 * 32 // 2 + 4


@pytest.mark.parametrize("seed", range(3))
def test_stars_are_those_of_one_pass_in_order(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample([f"p{i:02}" for i in range(25)], 2))): rng.randrange(1, 9) for _ in range(40)}
    near: dict = {}
    for (a, b), n in pairs.items():
        near.setdefault(a, {})[b] = n
    used, want = set(), set()
    for a in sorted(near):
        if a in used:
            continue
        for b in sorted(near[a]):
            if b not in used:
                want.add((a, b, near[a][b]))
        used |= {a, *near[a]}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a string, b string, n long")
    assert {tuple(r) for r in anchors._stars(df).collect()} == want

import numpy as np
import pytest

from lexiweave.core import sizing
from lexiweave.llm import knn

SCHEMA = "word_id long, embeddings array<float>, id string, bucket string"


def data(n=1500, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 15, dims))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, dims))
    x *= rng.lognormal(0, 1, (n, 1))
    x = x.astype(np.float32)
    x[100:160] = x[100]  # more copies than heads
    x[200:203] = x[200]
    x[300] = x[301] * 2
    return x


def brute(ids, x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, -s[a]))[:k]] for a, i in enumerate(ids)}


@pytest.mark.parametrize("bound, block", [(None, 20_000), (0, 40)])
def test_recall_and_exact_order(spark, monkeypatch, bound, block):
    if bound is not None:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", bound)
    x = data()
    ids = np.random.default_rng(0).permutation(len(x)) + 10
    rows = [(int(i), v.tolist(), "c", "c") for i, v in zip(ids, x)]
    nan = float("nan")
    bad = [(1, None), (2, [0.0] * 16), (3, [1.0] * 15), (4, [nan] + [1.0] * 15), (5, [None] + [1.0] * 15), (6, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + rows[:30] + [(i, v, "c", "c") for i, v in bad], SCHEMA)
    h = knn.Hashing(16, 6, block=block)
    got = {}
    for r in knn.similar_vectors(df, "word_id", "embeddings", 16, 5, h).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbour
    want = brute(ids, x, 5)
    assert set(got) <= set(want)
    hits = sum(len(set(got.get(i, {}).values()) & set(w)) for i, w in want.items())
    assert hits / (5 * len(want)) >= 0.97
    copies = sorted(int(i) for i in ids[100:160])
    for i in copies:  # ties of exact copies go to the smallest ids
        assert [got[i][k] for k in range(1, 6)] == [c for c in copies if c != i][:5]


def test_perturbations_are_in_order_and_consistent():
    sets = knn.perturbations(6, 20)
    assert sets[0] == (0,) and len(sets) == len(set(sets)) == 20
    assert not any(11 - m in s for s in sets for m in s)


def test_fewer_vectors_than_asked(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "", ""), (2, [1.0, 0.1], "", ""), (3, [1.0, 0.0], "", "")], SCHEMA)
    got = {(r.id, r.neighbour) for r in knn.similar_vectors(df, "word_id", "embeddings", 2).collect()}
    assert {(1, 3), (3, 1), (2, 1), (2, 3), (1, 2), (3, 2)} == got


def test_empty(spark):
    assert knn.similar_vectors(spark.createDataFrame([], SCHEMA), "word_id", "embeddings", 2).collect() == []


def spread_data(kind, n=3000, dims=64):
    rng = np.random.default_rng(9)
    if kind == "gauss":
        return rng.standard_normal((n, dims)).astype(np.float32)
    noise, mean = kind
    centres = rng.standard_normal((n // 15, dims))
    return (centres[rng.integers(0, len(centres), n)] + noise * rng.standard_normal((n, dims)) + mean).astype(np.float32)


@pytest.mark.parametrize("kind, most", [((0.25, 0.0), 0.2), ((0.6, 0.0), 0.5), ((1.0, 0.0), 0.5), ((0.25, 5.0), 0.2), ("gauss", 0.5)])
def test_recall_on_other_data(spark, kind, most):
    x = spread_data(kind)
    df = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(x)], SCHEMA)
    chosen = knn.measured(df, "word_id", "embeddings", 64).first()
    assert chosen.recall >= 0.95 and chosen.compared_share <= most
    got = {}
    for r in knn.similar_vectors(df, "word_id", "embeddings", 64).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = brute(np.arange(len(x)), x, 5)
    assert sum(len(got.get(i, set()) & set(w)) for i, w in want.items()) / (5 * len(x)) >= 0.95


def test_a_bucket_of_any_size_is_ranked_exactly(spark):
    x = spread_data("gauss", 400, 8)
    df = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in knn.similar_vectors(df, "word_id", "embeddings", 8, 5, knn.Hashing.whole(8, block=30)).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbour
    want = brute(np.arange(400), x, 5)
    assert {i: [g[k] for k in range(1, 6)] for i, g in got.items()} == want

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiweave.functions import text, vec
from lexiweave.operators import cluster, graph, parse_op, train


def test_components_of_a_random_graph(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_vocabulary_is_dense_and_sorted(spark):
    words = [f"w{i:03d}" for i in range(300)]
    random.Random(1).shuffle(words)
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "word string")
    assert {r.word: r.word_id for r in graph.vocabulary(df).collect()} == {w: i for i, w in enumerate(sorted(words))}
    assert graph.vocabulary(df.limit(0)).collect() == []


def test_closure_depths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")], "c string, p string")
    up = graph.closure(e, "c", "p")
    assert {(r.descendant, r.ancestor): r.depth for r in up.collect() if r.depth} == {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 1, ("d", "c"): 1}
    pairs = spark.createDataFrame([("a", "d")], "x string, y string")
    assert graph.path_similarity(up, pairs, "x", "y").first().similarity == pytest.approx(1 / 3)


def test_vector_algebra(spark):
    df = spark.createDataFrame([([1.0, -2.0, 0.0], [3.0, 2.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(
        vec.cosine(a, b).alias("c"), vec.vec_or(a, a).alias("oo"), vec.vec_and(a, a, "min").alias("aa"), vec.vec_not(vec.vec_not(a, [1]), [1]).alias("nn"),
        vec.vec_or(a, b).alias("o"), vec.vec_and(a, b, "min").alias("m"), vec.vec_and(a, b, "weighted").alias("w"), a, vec.cosine(b, a).alias("c2"),
    ).collect()
    for x in r:
        assert x.oo == x.aa == x.nn == x.a and x.c == x.c2
    assert r[0].o == [3.0, 2.0, 0.0] and r[0].m == [1.0, 2.0, 0.0]
    assert r[1].c == 0.0
    vec.register(spark)
    assert spark.sql("SELECT vec_cos(array(1D, 0D), array(2D, 0D)) AS c").first().c == 1.0
    assert spark.sql("SELECT vec_not(array(1D, 2D), array(1)) AS v").first().v == [1.0, -2.0]


def test_markup(spark):
    t = "{{x}}[[File:a.png]]'''Bold''' [[link|shown]] and [http://x.y name] <b>tag</b><!-- c\nd --> == Head ==\n* item"
    assert spark.createDataFrame([(t,)], "t string").select(text.clean_markup(F.col("t"))).first()[0] == "Bold shown and name tag item"


def test_window_pairs(spark):
    got = spark.createDataFrame([(["a", "b", "c"],)], "w array<string>").select(F.explode(text.window_pairs(F.col("w"), 1)).alias("p")).select("p.*").collect()
    assert [(r.source, r.target, r.distance) for r in got] == [("a", "b", 1), ("b", "c", 1)]


def brute_linkage(d, method):
    groups, heights = [[i] for i in range(len(d))], []
    while len(groups) > 1:
        f = max if method == "complete" else (lambda x: sum(x) / len(x))
        h, i, j = min((f([d[a][b] for a in g for b in q]), i, j) for i, g in enumerate(groups) for j, q in enumerate(groups) if i < j)
        heights.append(h)
        groups[i] += groups.pop(j)
    return sorted(heights)


@pytest.mark.parametrize("method", ["complete", "average"])
def test_linkage_heights(method):
    x = np.random.default_rng(2).random((25, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    merges = cluster.linkage(d, method)
    assert [m[2] for m in merges] == pytest.approx(brute_linkage(d.tolist(), method))
    assert len(set(cluster.cut(25, merges, np.inf))) == 1 and len(set(cluster.cut(25, merges, -1))) == 25


def test_silhouette_and_best_height():
    x = np.concatenate([np.zeros((5, 1)), np.ones((5, 1)) * 0.9]) + np.random.default_rng(0).random((10, 1)) * 0.01
    d = abs(x - x.T)
    labels = cluster.cut(10, cluster.linkage(d), 0.5)
    assert sorted(np.bincount(labels)) == [5, 5]
    assert cluster.silhouette(d, labels) > 0.95
    assert cluster.best_height(d, cluster.linkage(d), 2, 5)[1] > 0.95
    assert cluster.best_height(d, cluster.linkage(d), 50, 60) == (0.5, -1.0)


def test_communities_of_two_cliques():
    edges = [(i, j, 1.0) for g in (range(5), range(5, 10)) for i in g for j in g if i < j] + [(0, 5, 0.1)]
    assert cluster.communities(edges, 10) == [0] * 5 + [1] * 5
    assert cluster.communities([], 3) == [0, 1, 2]


def test_kmeans_split():
    x = np.concatenate([np.zeros((6, 2)), np.ones((6, 2))]) + np.random.default_rng(0).random((12, 2)) * 0.1
    labels, s = cluster.kmeans_split(x)
    assert len(set(labels[:6])) == len(set(labels[6:])) == 1 and labels[0] != labels[6] and s > 0.8


def test_gradient_matches_finite_differences(spark):
    e = spark.createDataFrame([("a", "b", 0.5, 1.0), ("b", "c", 0.2, 0.5)], "source string, target string, distance double, confidence double")
    v = {"a": [0.1, 0.9], "b": [0.4, -0.3], "c": [0.0, 0.2]}
    vectors = spark.createDataFrame(list(v.items()), "word string, v array<double>")
    moved = {r.word: r.v for r in train.step(e, vectors, 1.0, 0).collect()}

    def loss(x, w):
        mine = [(s, t, d, c) for s, t, d, c in (("a", "b", 0.5, 1.0), ("b", "c", 0.2, 0.5)) if w in (s, t)]
        return sum(c * (math.dist(x[s], x[t]) - d) ** 2 for s, t, d, c in mine) / len(mine)

    for w in v:
        for i in range(2):
            up, down = ({**v, w: [x + (s if j == i else 0) for j, x in enumerate(v[w])]} for s in (1e-6, -1e-6))
            assert v[w][i] - moved[w][i] == pytest.approx((loss(up, w) - loss(down, w)) / 2e-6, abs=1e-5)


def test_training_lowers_the_loss(spark):
    e = spark.createDataFrame([("a", "describes", "b", 1.0), ("b", "antonym", "c", 1.0), ("a", "unknown", "x", 1.0)], "source string, relation string, target string, confidence double")
    t = train.training_edges(e)
    assert t.count() == 2
    vectors, losses = train.train(t, train.initial_vectors(spark.createDataFrame([("a",), ("b",), ("c",)], "word string"), 8), epochs=4, anchors=2)
    assert losses[-1] < losses[0]
    first = {r.word: r.v[:2] for r in train.initial_vectors(spark.createDataFrame([("a",)], "word string"), 8).collect()}
    assert {r.word: r.v[:2] for r in vectors.collect()}["a"] == first["a"]  # anchors keep still


def test_parse_errors_are_rows(spark):
    df = spark.createDataFrame([(1, "the dog sees a cat"), (2, None), (3, ""), (4, "a " * 200)], "sentence_id long, sentence string")
    got = {r.sentence_id: r for r in parse_op.parse_sentences(df).collect()}
    assert got[1].success and got[1].num_triples == len(got[1].triples) > 0
    assert [bool(got[i].error) for i in (2, 3, 4)] == [True] * 3 and not any(got[i].success for i in (2, 3, 4))


def test_tag_rule_twins(spark):
    from lexiweave.operators.parser import tag_token

    tokens = ["the", "The", "Quickly", "running", "ended", "I", "A", ",", "—", "dog", "Paris", "to", "cantando", "hablar", "según", "Él", "“", "der"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", text.tag(F.col("t")).alias("en"), text.tag(F.col("t"), "es").alias("es"))
    for r in df.collect():
        assert (r.en, r.es) == (tag_token(r.t), tag_token(r.t, "es")), r.t

"""Queries against brute force on small tables that a cut would make smaller."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lexiweave.operators import cluster
from lexiweave.plans import anchors, axes, catalog
from lexiweave.plans.vectors import vectors

ENTRIES = catalog.entries()


def run(spark, folder, name):
    return [tuple(r) for r in ENTRIES[name].run(spark, str(folder)).collect()]


@pytest.fixture(scope="module")
def opposites():
    """A hub with 20 opposites, four more with 15 of them, two opposites among its own, and a pair apart."""
    pairs = [(f"h{k}", f"w{i:02}") for k in range(5) for i in range(5 if k else 0, 20)] + [("w00", "w01"), ("yin", "yang")]
    return {tuple(sorted(p)) for p in pairs}


@pytest.fixture(scope="module")
def triples(spark, opposites, tmp_path_factory):
    folder = tmp_path_factory.mktemp("opposites")
    rows = [(i, a, "compared-to", b, 1.0, "parse") for i, (a, b) in enumerate(sorted(opposites))]
    schema = "triple_id long, subject string, relation string, object string, confidence double, source_type string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/semantic_triple.parquet")
    return folder


def linked(opposites):
    near = {}
    for a, b in opposites:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {(a, b): len(near[a] & near[b]) for a, b in combinations(sorted(near), 2) if (a, b) not in opposites}
    return {p: n for p, n in found.items() if n}


def parts(links):
    links = list(links)
    name = {w: w for p in links for w in p}
    while any(name[a] != name[b] for a, b in links):
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    return name


@pytest.mark.parametrize("block", [3, 256])
def test_links_of_hubs(spark, opposites, triples, monkeypatch, block):
    monkeypatch.setattr(axes, "PAIR_BLOCK", block)
    want = linked(opposites)
    assert max(Counter(w for p in opposites for w in p).values()) > 12
    assert sorted(run(spark, triples, "shared_neighbor_pole_edges")) == sorted((a, b, n) for (a, b), n in want.items())


def test_poles_of_hubs(spark, opposites, triples):
    pole = parts(linked(opposites))
    assert dict(run(spark, triples, "pole_components")) == pole
    axis = run(spark, triples, "axis_assembly")
    between = sum(pole[a] != pole[b] for a, b in opposites if a in pole and b in pole)
    assert [(sorted(r[1]), r[2]) for r in axis] == [(sorted(set(pole.values())), between)]


def opposites_table(spark, folder, pairs):
    rows = [(i, a, "compared-to", b, 1.0, "parse") for i, (a, b) in enumerate(sorted(pairs))]
    schema = "triple_id long, subject string, relation string, object string, confidence double, source_type string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/semantic_triple.parquet")


def test_poles_without_all_links(spark, tmp_path, monkeypatch):
    """Graphs of every density, each apart from the others, and a hub: the same poles as by all links, from far fewer pairs."""
    rng = np.random.default_rng(5)
    pairs = {(f"hub{i:03}", "hub") for i in range(300)}
    for g in range(60):
        n, share = int(rng.integers(3, 9)), rng.choice([0.3, 0.6, 0.8, 0.95])
        pairs |= {(f"g{g:02}{i}", f"g{g:02}{j}") for i, j in combinations(range(n), 2) if rng.random() < share}
        kind = rng.integers(0, 3, 6)  # complete between the kinds, nothing within one
        pairs |= {(f"k{g:02}{i}", f"k{g:02}{j}") for i, j in combinations(range(6), 2) if kind[i] != kind[j]}
    pairs = {tuple(sorted(p)) for p in pairs}
    opposites_table(spark, tmp_path, pairs)
    triangles = len(run(spark, tmp_path, "triads"))
    made = axes._connecting(axes.opposites(spark, str(tmp_path))).collect()
    assert len(made) <= 2 * len(pairs) + 6 * triangles < len(linked(pairs))

    def all_links(p):
        raise AssertionError("poles need no table of all links")

    monkeypatch.setattr(axes, "_links", all_links)
    assert dict(run(spark, tmp_path, "pole_components")) == parts(linked(pairs))


def test_axes_without_all_links(spark, opposites, triples, monkeypatch):
    def all_links(p):
        raise AssertionError("axes need no table of all links")

    want = run(spark, triples, "axis_assembly")
    monkeypatch.setattr(anchors, "_links", all_links)
    monkeypatch.setattr(axes, "_links", all_links)
    assert want and run(spark, triples, "axis_assembly") == want


def test_close_poles_of_hubs(spark, opposites, triples):
    links = linked(opposites)
    pole = parts(p for p, n in links.items() if n >= 4)
    known = [(a, b) for a, b in links if a in pole and b in pole]
    inside = sum(pole[a] == pole[b] for a, b in known)
    assert run(spark, triples, "graph_confidence") == [(len(known), inside, round(0.5 + 0.5 * inside / len(known), 6))]
    size = Counter(pole.values())
    shared = Counter((w, pole[x]) for a, b in links for w, x in ((a, b), (b, a)) if x in pole and pole.get(w) != pole[x])
    want = sorted((w, p, n, round(n / size[p], 6)) for (w, p), n in shared.items() if n >= 0.7 * size[p])
    assert want and sorted(run(spark, triples, "axis_expansion")) == want


def test_senses_of_one_word(spark, tmp_path):
    """Seven senses of one word, of which five are compared, and words that only begin alike."""
    names = [f"bank_wn.{i:02}_n" for i in range(7)] + ["bat", "bat_wn.01_v", "banker", "ba"]
    rows = [(i, w, [float(i + 1)] * 32 + [1.0] * 32, "ck") for i, w in enumerate(names)]
    spark.createDataFrame(rows, "word_id long, word string, embeddings array<float>, checkpoint string").write.parquet(f"{tmp_path}/word_vector.parquet")
    got = sorted((r[2], r[0], r[1]) for r in run(spark, tmp_path, "sense_separation"))
    assert got == [("bank", i, j) for i, j in combinations(range(5), 2)] + [("bat", 7, 8)]
    assert [r[:3] for r in run(spark, tmp_path, "checkpoint_compare")] == [("ck", len(names), 4)]


def test_components_of_all_relations(spark, tmp_path):
    rows = [("a", "has-time", "b"), ("b", "is-agent-of", "c"), ("d", "has-place", "e"), ("f", "compared-to", "f")]
    rows = [(i, *r, 1.0, "parse") for i, r in enumerate(rows)]
    schema = "triple_id long, subject string, relation string, object string, confidence double, source_type string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/semantic_triple.parquet")
    assert dict(run(spark, tmp_path, "components")) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_paths_of_all_lines(spark, tmp_path):
    """Supplier 2 stands on a second line only."""
    tables = {
        "region": ("r_regionkey int", [(0,)]), "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 0)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(1, 0), (2, 1)]), "customer": ("c_custkey long, c_nationkey int", [(5, 0)]),
        "orders": ("o_orderkey long, o_custkey long", [(9, 5)]), "lineitem": ("l_orderkey long, l_suppkey long, l_linenumber int", [(9, 1, 1), (9, 2, 2)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(run(spark, tmp_path, "path_similarity")) == [("s1", "c5", 1 / 3), ("s2", "c5", 1 / 5)]


def test_linkage_tries_all_heights(spark, data):
    """The cut of a whole group is the best of the reference's 100 heights."""
    rows = sorted(vectors(spark, data).where("label = 0").select("vec_id", "v").collect())
    x = np.array([r.v for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.clip(1 - x @ x.T, 0, None)
    height, silhouette = cluster.best_height(d, cluster.linkage(d), 2, len(rows) // 2, 100)
    got = ENTRIES["linkage_clusters"].run(spark, data).where("label = 0").select("height", "silhouette").distinct().collect()
    assert [tuple(r) for r in got] == [(pytest.approx(height), pytest.approx(silhouette))]

"""Distance-constrained training of word vectors as an iterative DataFrame job.

One step joins the edges with the vectors at both ends, takes the analytic gradient of the
confidence-weighted squared distance error and sums it by word. Vectors stay distributed;
every step is written to the shared folder, which cuts lineage. Anchor dimensions keep still.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core.session import materialise
from ..core.sizing import bounded_join
from ..functions import vec
from ..functions.features import DISTANCES

RELATION_DISTANCE = DISTANCES["graph"]


def relation_distance(relation: Column, table: dict[str, float] | None = None) -> Column:
    """One look-up in a literal map, so that an expression for ``relation`` stands in the plan once."""
    pairs = [F.lit(x) for name, d in (table or RELATION_DISTANCE).items() for x in (name, float(d))]
    return F.try_element_at(F.create_map(*pairs), relation)


def training_edges(edges: DataFrame, table: dict[str, float] | None = None) -> DataFrame:
    """(source, target, distance, confidence) with one row for each pair; unknown relations drop out."""
    e = edges.withColumn("distance", relation_distance(F.col("relation"), table)).where("distance IS NOT NULL AND source <> target")
    return e.groupBy("source", "target").agg(F.avg("distance").alias("distance"), F.avg("confidence").alias("confidence"))


def initial_vectors(words: DataFrame, dims: int, seed: int = 7) -> DataFrame:
    """Seeded pseudo-normal vectors of scale 0.01 that depend on the word alone, so any lost partition comes back the same."""

    def uniform(i: Column, salt: int) -> Column:
        h = F.xxhash64(F.col("word"), i, F.lit(seed), F.lit(salt))
        return (F.pmod(h, F.lit(1 << 30)) + 1) / float((1 << 30) + 1)

    values = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: 0.01 * F.sqrt(-2.0 * F.log(uniform(i, 1))) * F.cos(6.283185307179586 * uniform(i, 2))
    )
    return words.select("word").distinct().withColumn("v", values)


def _joined(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    a = vectors.select(F.col("word").alias("source"), F.col("v").alias("a"))
    b = vectors.select(F.col("word").alias("target"), F.col("v").alias("b"))
    j = bounded_join(bounded_join(edges, a, "source", spread=["target"]), b, "target", spread=["source"])
    return j.withColumn("d", vec.euclid(F.col("a"), F.col("b"))).withColumn("miss", F.col("d") - F.col("distance"))


def loss(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: number of edges and weighted mean squared distance error."""
    j = _joined(edges, vectors)
    return j.agg(F.count(F.lit(1)).alias("edges"), F.try_divide(F.sum(F.col("confidence") * F.col("miss") * F.col("miss")), F.sum("confidence")).alias("loss"))


def step(edges: DataFrame, vectors: DataFrame, rate: float, anchors: int, sparsity: float = 0.0) -> DataFrame:
    """One gradient step; a word's gradient is the mean over its edges, so hubs do not diverge.

    The gradient is summed dimension by dimension from exploded rows, map-side first: a hub's
    edges are never gathered in one place.
    """
    j = _joined(edges, vectors)
    f = 2 * F.col("confidence") * F.col("miss") / F.greatest(F.col("d"), F.lit(vec.EPS))
    z = j.select("source", "target", f.alias("f"), F.posexplode(F.arrays_zip(F.col("a").alias("x"), F.col("b").alias("y"))).alias("dim", "z"))
    one = F.col("f") * (F.col("z.x") - F.col("z.y"))
    ends = F.array(F.struct(F.col("source").alias("word"), one.alias("x")), F.struct(F.col("target").alias("word"), (-one).alias("x")))
    g = z.select("dim", F.explode(ends).alias("e")).select("e.word", "dim", "e.x")
    mean = g.where(F.col("dim") >= anchors).groupBy("word", "dim").agg(F.avg("x").alias("x"))
    grad = mean.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("g"))
    moved = F.transform(
        "v", lambda x, i: x - rate * (F.coalesce(F.try_element_at("g", i), F.lit(0.0)) + F.when(i >= anchors, sparsity * F.sign(x)).otherwise(F.lit(0.0)))
    )
    return vectors.join(grad, "word", "left").select("word", F.when(F.col("g").isNull(), F.col("v")).otherwise(moved).alias("v"))


def train(edges: DataFrame, vectors: DataFrame, epochs: int = 3, rate: float = 0.2, anchors: int = 0, sparsity: float = 0.0) -> tuple[DataFrame, list[float]]:
    """Trained vectors and the loss before each epoch and at the end."""
    losses = []
    edges = materialise(edges, "train-edges")
    now = materialise(vectors, "train-vectors")
    for _ in range(epochs):
        losses.append(loss(edges, now).first()["loss"])
        now = materialise(step(edges, now, rate, anchors, sparsity), "train-vectors")
    losses.append(loss(edges, now).first()["loss"])
    return now, losses


def validated(edges: DataFrame, vectors: DataFrame, epochs: int = 3, rate: float = 0.2, held_out: int = 10, anchors: int = 0, patience: int = 3) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """The vectors of the best epoch, and (epoch, training loss, validation loss) of each.

    One in ``held_out`` edges, by the hash of its words, is kept for validation. Training stops when the
    validation loss has not fallen for ``patience`` epochs; epoch 0 stands before the first step.
    """
    kept = F.pmod(F.xxhash64("source", "target"), F.lit(held_out)) == 0
    edges = materialise(edges, "train-edges")
    fit, check = edges.where(~kept), edges.where(kept)
    now = best = materialise(vectors, "train-vectors")
    history: list[tuple[int, float, float]] = []
    least, at = float("inf"), 0
    for epoch in range(epochs + 1):
        if epoch:
            now = materialise(step(fit, now, rate, anchors), "train-vectors")
        here = (epoch, loss(fit, now).first()["loss"], loss(check, now).first()["loss"])
        history.append(here)
        if here[2] is not None and here[2] < least:
            least, at, best = here[2], epoch, now
        elif epoch - at >= patience:
            break
    return best, history


def _trees(parsed: DataFrame, vectors: DataFrame) -> DataFrame:
    """(sentence_id, edges, words): the vectors of each sentence's nodes in one row, which a sentence's length bounds."""
    rows = parsed.where("success").select("sentence_id", "nodes", "edges")
    nodes = rows.select("sentence_id", F.posexplode("nodes").alias("i", "n")).select("sentence_id", "i", F.lower("n.text").alias("word"))
    found = bounded_join(nodes, vectors.select("word", "v"), "word", "left", spread=["sentence_id", "i"])
    words = found.groupBy("sentence_id").agg(F.collect_list(F.struct("i", "v")).alias("words"))
    return rows.select("sentence_id", "edges").join(words, "sentence_id")


def _folded(edges: list | None, words: list, dims: int) -> tuple[list, dict, int]:
    """Vector of every node of a tree with all below it, the nodes below each, and the root."""
    import numpy as np

    n = max(w["i"] for w in words) + 1
    x = np.zeros((n, dims))
    for w in words:
        if w["v"] is not None:
            x[w["i"]] = w["v"]
    below: dict[int, list[tuple[str, int]]] = {}
    child = set()
    for e in edges or []:
        below.setdefault(e["parent"], []).append((e["type"], e["child"]))
        child.add(e["child"])
    done: list = [None] * n

    def down(i: int, path: frozenset) -> np.ndarray:
        out = x[i].copy()
        for kind, c in below.get(i, ()):
            if c in path:
                continue
            v = down(c, path | {i})
            if kind == "DESCRIPTION":
                out = out * v
            elif kind == "SPECIFICATION":
                out = out * (1 + 0.2 * v.mean())
            elif kind == "COORDINATION":
                out = (out + v) / 2
            else:
                out = out + vec.ADDED.get(kind, 0.5) * v
        done[i] = out
        return out

    root = next((i for i in range(n) if i not in child), 0)
    for i in [root, *(j for j in range(n) if j not in child)]:
        if done[i] is None:
            down(i, frozenset())
    return done, below, root


def tree_vectors(parsed: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(sentence_id, v): each parse tree folded bottom-up into its root by ``compose``, words without vectors are zero.

    The words' vectors are joined to the tree nodes by key; trees are folded batch by batch.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, edges, words = (c.to_pylist() for c in b.columns)
            if ids:
                folded = [_folded(e, w, dims) for e, w in zip(edges, words)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([d[r].tolist() for d, _, r in folded], pa.list_(pa.float64()))], names=["sentence_id", "v"])

    return _trees(parsed, vectors).mapInArrow(run, "sentence_id long, v array<double>")


def composition_tests(parsed: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(sentence_id, kind, x): the tests of a composition. ``whole``: the cosine of each node that has nodes below it with
    its root. Other kinds are edge types: the difference of the unit vectors of parent and child."""
    import numpy as np
    import pyarrow as pa

    def unit(v):
        n = np.linalg.norm(v)
        return v / n if n > 1e-8 else None

    def run(batches):
        for b in batches:
            out: list[tuple[int, str, list[float]]] = []
            for s, edges, words in zip(*(c.to_pylist() for c in b.columns)):
                done, below, root = _folded(edges, words, dims)
                whole = unit(done[root])
                for p, kids in below.items():
                    u = unit(done[p]) if done[p] is not None else None
                    if p != root and whole is not None and u is not None:
                        out.append((s, "whole", [float(whole @ u)]))
                    for kind, c in kids:
                        w = unit(done[c]) if done[c] is not None else None
                        if u is not None and w is not None:
                            out.append((s, kind, (u - w).tolist()))
            if out:
                ids, kinds, xs = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds), pa.array(xs, pa.list_(pa.float64()))], names=["sentence_id", "kind", "x"])

    return _trees(parsed, vectors).mapInArrow(run, "sentence_id long, kind string, x array<double>")


def composition_loss(tests: DataFrame) -> DataFrame:
    """(kind, tests, loss): squared shortfall of ``whole`` below 0.3; a tenth of the mean variance of an edge type's differences.

    Variances come from sums by dimension, so all instances of a type count.
    """
    whole = tests.where("kind = 'whole'").select(F.greatest(F.lit(0.0), 0.3 - F.col("x")[0]).alias("d"))
    first = whole.agg(F.lit("whole").alias("kind"), F.count(F.lit(1)).alias("tests"), F.sum(F.col("d") * F.col("d")).alias("loss"))
    dims = tests.where("kind <> 'whole'").select("kind", F.posexplode("x").alias("dim", "x")).groupBy("kind", "dim").agg(F.count(F.lit(1)).alias("tests"), F.var_pop("x").alias("v"))
    kinds = dims.groupBy("kind").agg(F.max("tests").alias("tests"), (0.1 * F.avg("v")).alias("loss")).where("tests > 1")
    return first.unionByName(kinds)


#: Target distance of parent and child by edge type; others 0.5.
TREE_DISTANCE = {"DESCRIPTION": 0.3, "SPECIFICATION": 0.3, "MODIFICATION": 0.4, "SUBJECT": 0.4, "OBJECT": 0.4, "COORDINATION": 0.2}


def tree_loss(parsed: DataFrame, vectors: DataFrame) -> DataFrame:
    """(type, edges, loss): mean squared error of the distance of two words that an edge joins against the type's target."""
    p = parsed.where("success").select("nodes", F.explode("edges").alias("e"))
    ends = p.select("e.type", F.lower(F.col("nodes")[F.col("e.parent")]["text"]).alias("source"), F.lower(F.col("nodes")[F.col("e.child")]["text"]).alias("target"))
    want = F.lit(0.5)
    for name, d in TREE_DISTANCE.items():
        want = F.when(F.col("type") == name, F.lit(d)).otherwise(want)
    rows = ends.where("source IS NOT NULL AND target IS NOT NULL").groupBy("type", "source", "target").agg(F.count(F.lit(1)).alias("n"))
    j = _joined(rows.withColumn("distance", want), vectors)
    return j.groupBy("type").agg(F.sum("n").alias("edges"), F.try_divide(F.sum(F.col("n") * F.col("miss") * F.col("miss")), F.sum("n")).alias("loss"))

"""The typed, weighted word graph: nodes and edges as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core.session import materialise
from ..core.sizing import bounded_join


def build_edges(triples: DataFrame) -> DataFrame:
    """Edges (source, relation, target, confidence, source_type); missing confidence is 1.0, missing source ``parse``."""
    score = F.when(F.col("confidence").isNull() | F.isnan("confidence"), F.lit(1.0)).otherwise(F.col("confidence"))
    return triples.select(
        F.col("subject").alias("source"), "relation", F.col("object").alias("target"), score.alias("confidence"),
        F.coalesce("source_type", F.lit("parse")).alias("source_type"),
    )


def build_nodes(edges: DataFrame) -> DataFrame:
    """Nodes with their number of mentions as an endpoint."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("word"))
    return ends.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))


def outgoing(edges: DataFrame, word: str, relation: str | None = None) -> DataFrame:
    e = edges.where(F.col("source") == word)
    return e if relation is None else e.where(F.col("relation") == relation)


def incoming(edges: DataFrame, word: str, relation: str | None = None) -> DataFrame:
    e = edges.where(F.col("target") == word)
    return e if relation is None else e.where(F.col("relation") == relation)


def neighbours(edges: DataFrame, word: str, relation: str | None = None) -> DataFrame:
    """Distinct words at the other end of any edge of ``word``, in one scan."""
    e = edges.where((F.col("source") == word) | (F.col("target") == word))
    e = e if relation is None else e.where(F.col("relation") == relation)
    other = F.array_compact(F.array(F.when(F.col("source") == word, F.col("target")), F.when(F.col("target") == word, F.col("source"))))
    return e.select(F.explode(other).alias("neighbour")).distinct()


def related(edges: DataFrame, word: str, relation: str | None = None) -> DataFrame:
    return outgoing(edges, word, relation).select("relation", "target").distinct()


def statistics(edges: DataFrame) -> DataFrame:
    """One row: edges, nodes, average degree (2·edges/nodes)."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("word")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    n = edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("relation").alias("relations"))
    return n.crossJoin(nodes).withColumn("average_degree", F.try_divide(2.0 * F.col("edges"), F.col("nodes")))


def vocabulary(words: DataFrame, column: str = "word") -> DataFrame:
    """Dense ids by sorted order, without a single sorting task.

    Words are range-partitioned and sorted; each partition numbers its own rows, moved by the
    sizes of the partitions before (one number for each comes to the driver).
    """
    spark = words.sparkSession
    ordered = words.select(F.col(column).alias("word")).where(F.col(column).isNotNull()).distinct()
    ordered = ordered.repartitionByRange("word").sortWithinPartitions("word").withColumn("__part", F.spark_partition_id())
    numbered = materialise(ordered.withColumn("__mid", F.monotonically_increasing_id()), "vocabulary")
    sizes = sorted((r["__part"], r["n"]) for r in numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    offsets = spark.createDataFrame(starts, "__part int, __start long")
    row = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(offsets), "__part").select("word", (F.col("__start") + row).alias("word_id"))


def encode(edges: DataFrame, vocab: DataFrame) -> DataFrame:
    """Edges with ids at both ends; edges with an end outside the vocabulary drop out."""
    ids = vocab.select("word", "word_id")
    a = bounded_join(edges, ids.withColumnsRenamed({"word": "source", "word_id": "source_id"}), "source", spread=["relation", "target"])
    return bounded_join(a, ids.withColumnsRenamed({"word": "target", "word_id": "target_id"}), "target", spread=["relation", "source"])


def frequent_ends(edges: DataFrame, least: int) -> DataFrame:
    """Edges whose two words occur at least ``least`` times as an end."""
    keep = materialise(build_nodes(edges).where(F.col("frequency") >= least).select("word"), "frequent-words")
    a = bounded_join(edges, keep.withColumnRenamed("word", "source"), "source", "left_semi", spread=["relation", "target"])
    return bounded_join(a, keep.withColumnRenamed("word", "target"), "target", "left_semi", spread=["relation", "source"])


def mean(c: Column | str, digits: int = 6) -> Column:
    """Mean over a rounded sum, so that the order of addition cannot show in the result."""
    return F.try_divide(F.round(F.sum(c), digits), F.count(c))


def aggregate_edges(edges: DataFrame) -> DataFrame:
    """Mean confidence and number of each (source, relation, target)."""
    return edges.groupBy("source", "relation", "target").agg(mean("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))


def _signature(links: DataFrame) -> tuple:
    """Number and hash sum of a set of links, equal for equal sets; one small job over the written table."""
    h = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
    return tuple(links.agg(F.count(F.lit(1)), h, F.sum(F.pmod(F.xxhash64("v", "u", F.lit(1)), F.lit(1 << 40)))).first())


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, component), the component named by its smallest node.

    Alternating large-star and small-star rounds; the number of rounds grows with the
    logarithm of the component size. Each round is written to the shared folder, which cuts
    lineage and survives lost executors. A hub's neighbours are never gathered in one row:
    only the minimum of each neighbourhood is aggregated, map-side first, and both joins have one row for each
    node on the right, so that Spark's adaptive skew join can split a hub's partition on the left.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now = materialise(now.distinct(), "component-edges")  # whatever made the edges runs once
    nodes = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = now.where("u <> v")
    before = _signature(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "components")
        after = _signature(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    root = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, nodes["node"] == root["u"], "left").select("node", F.coalesce("component", "node").alias("component"))


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(descendant, ancestor, depth) of an is-a relation of any depth, shortest depth, each node its own ancestor at 0.

    A pair is followed from its first round on and never again, so that cycles end as well."""
    e = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL AND p IS NOT NULL").distinct()
    e = materialise(e, "closure-edges")
    nodes = e.select(F.explode(F.array("c", "p")).alias("n")).distinct()
    frontier = nodes.select(F.col("n").alias("descendant"), F.col("n").alias("ancestor"), F.lit(0).alias("depth"))
    levels = frontier
    d = 0
    while True:
        d += 1
        step = frontier.join(e, F.col("ancestor") == F.col("c")).select("descendant", F.col("p").alias("ancestor"), F.lit(d).alias("depth"))
        frontier = materialise(step.distinct().join(levels, ["descendant", "ancestor"], "left_anti"), "closure")
        if frontier.isEmpty():
            return levels
        levels = levels.unionByName(frontier)


def path_similarity(up: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """1 / (1 + shortest path over a common ancestor) of each pair; pairs without one drop out."""
    left = up.select(F.col("descendant").alias(a), F.col("ancestor").alias("__x"), F.col("depth").alias("__d1"))
    right = up.select(F.col("descendant").alias(b), F.col("ancestor").alias("__x"), F.col("depth").alias("__d2"))
    met = pairs.select(a, b).join(left, a).join(right, [b, "__x"])
    return met.groupBy(a, b).agg((1.0 / (1 + F.min(F.col("__d1") + F.col("__d2")))).alias("similarity"))


def confidence_by_distance(distance: Column) -> Column:
    """max(0.3, 1 − 0.1·distance)."""
    return F.greatest(F.lit(0.3), F.round(1.0 - 0.1 * distance, 6))

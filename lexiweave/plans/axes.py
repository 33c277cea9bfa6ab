"""Poles, axes, dimension allocation, clustering, and the beam as relations."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..core.session import materialise, task_count
from ..core.sizing import bounded_join
from ..operators import cluster, graph
from . import Registry, table
from .graph import EDGES, edges_of
from .vectors import vectors

registry = Registry()

# An undirected graph of opposites between words stands in for antonym pairs.
PAIRS = f"(SELECT DISTINCT least(source, target) AS w1, greatest(source, target) AS w2 FROM ({EDGES}) WHERE relation = 'compared-to' AND source <> target)"


def opposites(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges_of(spark, sf_dir).where("relation = 'compared-to' AND source <> target")
    return e.select(F.least("source", "target").alias("w1"), F.greatest("source", "target").alias("w2")).distinct()


def written_opposites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once for the queries that read it several times."""
    return materialise(opposites(spark, sf_dir), "opposites")


_BOTH = f"b AS (SELECT w1 AS w, w2 AS x FROM {PAIRS} UNION ALL SELECT w2, w1 FROM {PAIRS})"
#: Shared opposites that put two words into one pole, as in the reference; ``anchors.poles`` asks for more. ``shared_poles`` holds for 1.
MIN_SHARED = 1
#: Opposites of one word in a block; pairs are made between blocks, so that a hub's pairs are spread over tasks.
PAIR_BLOCK = 256


def _links(p: DataFrame) -> DataFrame:
    """Pairs of words that share an opposite and are no opposites, with the exact number of shared opposites.

    A self-join on the shared word. The opposites of a hub are cut into blocks and every pair of
    blocks is a join key of its own; a pair of words meets in one of them only. Counts add up map-side.
    """
    both = p.unionByName(p.select(F.col("w2").alias("w1"), F.col("w1").alias("w2")))
    blocks = both.groupBy("w2").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("w1"), F.col("blocks")).cast("int")
    cut = bounded_join(both, blocks, "w2").select("w2", "w1", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = task_count(p.sparkSession)
    a = cut.select("w2", F.col("own").alias("i"), F.col("other").alias("j"), F.col("w1").alias("a")).repartition(tasks, "w2", "i", "j")
    b = cut.select("w2", F.col("other").alias("i"), F.col("own").alias("j"), F.col("w1").alias("b")).repartition(tasks, "w2", "i", "j")
    shared = a.join(b.hint("shuffle_hash"), ["w2", "i", "j"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(p, (F.col("a") == p["w1"]) & (F.col("b") == p["w2"]), "left_anti")


_LINKS = f"""{_BOTH}, s AS (SELECT p.w AS a, q.w AS b, count(*) AS shared FROM b p JOIN b q ON p.x = q.x AND p.w < q.w GROUP BY 1, 2),
l AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM {PAIRS} z WHERE z.w1 = s.a AND z.w2 = s.b))"""


@registry.query("shared_neighbor_pole_edges", f"WITH {_LINKS} SELECT a, b, shared FROM l")
def shared_neighbor_pole_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(written_opposites(spark, sf_dir))


def _triangles(p: DataFrame) -> DataFrame:
    """Triangles a < b < c: wedges from ordered edges, closed by an equi-join."""
    # edges point from the word of fewer opposites to that of more, so that no word has many that point away
    n = p.select(F.explode(F.array("w1", "w2")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    d = bounded_join(bounded_join(p, n.toDF("w1", "n1"), "w1", spread=["w2"]), n.toDF("w2", "n2"), "w2", spread=["w1"])
    up = F.struct("n1", "w1") < F.struct("n2", "w2")
    e = materialise(d.select(F.when(up, F.col("w1")).otherwise(F.col("w2")).alias("u"), F.when(up, F.col("w2")).otherwise(F.col("w1")).alias("v")), "ordered-opposites")
    wedges = bounded_join(e.toDF("u", "x"), e.toDF("u", "y"), "u", spread=["x"]).where("x < y").select("u", F.col("x").alias("w1"), F.col("y").alias("w2"))
    t = F.array_sort(F.array("u", "w1", "w2"))
    return wedges.join(p, ["w1", "w2"], "left_semi").select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def _connecting(p: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the same words as all links of at least one shared opposite, without making the links.

    The opposites of a word x are all linked but for those that are opposites of each other, of which every pair is a
    triangle with x. The centre is the opposite of x in the fewest triangles: what is no opposite of the centre is linked to
    it. What is one is reached over any of the former that it is linked to; only if it is linked to none of them are its
    pairs with the others beside the centre made. Those are at most twice the triangles of x, all else is one row for each opposite.
    """
    t = materialise(_triangles(p), "triangles")
    corners = F.array(*[F.struct(F.col(i).alias("x"), F.col(j).alias("w"), F.col(k).alias("u")) for i, j, k in permutations("abc")])
    t = materialise(t.select(F.explode(corners).alias("t")).select("t.*"), "corners")
    both = p.select(F.col("w1").alias("x"), F.col("w2").alias("w")).unionByName(p.select(F.col("w2").alias("x"), F.col("w1").alias("w")))
    inside = t.groupBy("x", "w").agg(F.count(F.lit(1)).alias("d"))
    d = materialise(bounded_join(both, inside, ["x", "w"], "left").select("x", "w", F.coalesce("d", F.lit(0)).alias("d")), "opposites-inside")
    centre = d.groupBy("x").agg(F.min(F.struct("d", "w")).alias("m"), F.count(F.lit(1)).alias("n"))
    centre = materialise(centre.select("x", F.col("m.w").alias("centre"), (F.col("n") - 1 - F.col("m.d")).alias("free")), "centres-of-opposites")
    # opposites of x that are opposites of its centre, with the number of ``free`` ones that they are opposites of
    beside = materialise(bounded_join(t, centre, "x", spread=["u"]).where("w = centre").select("x", F.col("u").alias("w")), "beside-centres")
    among = bounded_join(bounded_join(t, beside, ["x", "w"], "left_semi"), beside.withColumnRenamed("w", "u"), ["x", "u"], "left_semi")
    among = among.groupBy("x", "w").agg(F.count(F.lit(1)).alias("among"))
    beside = bounded_join(bounded_join(beside, inside, ["x", "w"]), among, ["x", "w"], "left")
    beside = materialise(beside.select("x", "w", (F.col("d") - 1 - F.coalesce("among", F.lit(0))).alias("met")), "beside")
    star = bounded_join(bounded_join(d.select("x", "w"), centre, "x", spread=["w"]).where("w <> centre"), beside, ["x", "w"], "left")
    near = star.where("met IS NULL OR met < free").select(F.col("centre").alias("a"), F.col("w").alias("b"))
    apart = bounded_join(beside, centre, "x").where("met = free").select("x", F.col("w").alias("v"))
    others = bounded_join(beside.select("x", "w"), apart, "x", spread=["w"]).where("v <> w")
    others = others.select(F.least("v", "w").alias("w1"), F.greatest("v", "w").alias("w2")).distinct().join(p, ["w1", "w2"], "left_anti")
    return near.unionByName(others.toDF("a", "b"))


def shared_poles(p: DataFrame) -> DataFrame:
    """(node, component) of words joined by a shared opposite."""
    return graph.components(_connecting(p), "a", "b")


@registry.query(
    "pole_components",
    f"""WITH RECURSIVE {_LINKS}, k AS (SELECT a, b FROM l WHERE shared >= {MIN_SHARED}), e AS (SELECT a AS u, b AS v FROM k UNION SELECT b, a FROM k),
r AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u) SELECT node, min(seen) AS component FROM r GROUP BY node""",
)
def pole_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_poles(written_opposites(spark, sf_dir))


@registry.query(
    "triads",
    f"WITH p AS {PAIRS} SELECT x.w1 AS a, x.w2 AS b, y.w2 AS c FROM p x JOIN p y ON x.w2 = y.w1 JOIN p z ON z.w1 = x.w1 AND z.w2 = y.w2",
)
def triads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triangles(written_opposites(spark, sf_dir))


@registry.query(
    "freq_binary_split",
    f"""WITH e AS (SELECT source, target FROM ({EDGES}) WHERE relation = 'compared-to'), l AS (SELECT source AS w, count(*) AS n1 FROM e GROUP BY 1), r AS (SELECT target AS w, count(*) AS n2 FROM e GROUP BY 1)
SELECT w, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, CASE WHEN coalesce(n1, 0) > coalesce(n2, 0) THEN 'pole1' ELSE 'pole2' END AS pole FROM l FULL JOIN r USING (w)""",
)
def freq_binary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side on which a word stands more often, ties to the second; one aggregation instead of a full join."""
    e = edges_of(spark, sf_dir).where("relation = 'compared-to'")
    ends = e.select(F.explode(F.array(F.struct(F.col("source").alias("w"), F.lit(1).alias("s")), F.struct(F.col("target").alias("w"), F.lit(2).alias("s")))).alias("x"))
    n = ends.groupBy(F.col("x.w").alias("w")).agg(F.count_if(F.col("x.s") == 1).alias("n1"), F.count_if(F.col("x.s") == 2).alias("n2"))
    return n.withColumn("pole", F.when(F.col("n1") > F.col("n2"), F.lit("pole1")).otherwise(F.lit("pole2")))


@registry.query(
    "cluster_antonym_counts",
    """WITH e AS (SELECT a.label AS l1, b.label AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT least(l1, l2) AS c1, greatest(l1, l2) AS c2, count(*) AS n FROM e WHERE l1 <> l2 GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def cluster_antonym_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opposite pairs between two clusters."""
    e = vectors(spark, sf_dir).select("vec_id", "label")
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("l2")), "vec_id").where("label <> l2")
    return p.groupBy(F.least("label", "l2").alias("c1"), F.greatest("label", "l2").alias("c2")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


_AXES = f"(SELECT relation AS axis, count(*) AS size, count(DISTINCT source_type) + 1 AS poles, round(sum(confidence), 6) / count(*) AS coherence FROM ({EDGES}) GROUP BY relation)"


@registry.query(
    "axis_alloc",
    f"""SELECT axis, size, poles, coherence, (51 + coalesce(sum(poles - 1) OVER (ORDER BY size DESC, coherence DESC, axis ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_dim,
  CASE WHEN size < 3 THEN 'size' WHEN coherence < 0.3 THEN 'coherence' ELSE 'valid' END AS reason FROM {_AXES}""",
)
def axis_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of each axis (poles − 1 of them) from number 51 on, larger axes first, and why an axis would be refused.

    The window runs over one row for each axis, of which there are few.
    """
    axes = edges_of(spark, sf_dir).groupBy(F.col("relation").alias("axis")).agg(
        F.count(F.lit(1)).alias("size"), (F.countDistinct("source_type") + 1).alias("poles"), graph.mean("confidence").alias("coherence")
    )
    w = Window.orderBy(F.desc("size"), F.desc("coherence"), "axis").rowsBetween(Window.unboundedPreceding, -1)
    first = F.lit(51) + F.coalesce(F.sum(F.col("poles") - 1).over(w), F.lit(0))
    reason = F.when(F.col("size") < 3, F.lit("size")).when(F.col("coherence") < 0.3, F.lit("coherence")).otherwise(F.lit("valid"))
    return axes.select("axis", "size", "poles", "coherence", first.cast("long").alias("first_dim"), reason.alias("reason"))


_MEMBERS = f"(SELECT DISTINCT relation AS axis, target AS w FROM ({EDGES}) WHERE relation LIKE 'has-%')"


@registry.query(
    "overlap_merge_pairs",
    f"""WITH m AS {_MEMBERS}, n AS (SELECT axis, count(*) AS n FROM m GROUP BY axis)
SELECT a.axis AS axis_a, b.axis AS axis_b, count(*) AS shared, round(count(*)::DOUBLE / least(any_value(na.n), any_value(nb.n)), 6) AS overlap
FROM m a JOIN m b ON a.w = b.w AND a.axis < b.axis JOIN n na ON na.axis = a.axis JOIN n nb ON nb.axis = b.axis GROUP BY 1, 2""",
)
def overlap_merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap coefficient |A∩B| / min(|A|, |B|) of two axes' word sets."""
    m = edges_of(spark, sf_dir).where("relation LIKE 'has-%'").select(F.col("relation").alias("axis"), F.col("target").alias("w")).distinct()
    n = m.groupBy("axis").agg(F.count(F.lit(1)).alias("n"))
    # a word has at most as many axes as there are relations: pairs are made within its sorted list
    lists = m.groupBy("w").agg(F.array_sort(F.collect_list("axis")).alias("l")).select(F.posexplode("l").alias("i", "axis_a"), "l")
    p = lists.select("axis_a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("axis_b")).groupBy("axis_a", "axis_b").agg(F.count(F.lit(1)).alias("shared"))
    a, b = n.toDF("axis_a", "na"), n.toDF("axis_b", "nb")
    return p.join(a, "axis_a").join(b, "axis_b").select("axis_a", "axis_b", "shared", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("overlap"))


@registry.query(
    "pole_names",
    f"""WITH c AS (SELECT relation AS axis, source AS w, count(*) AS n FROM ({EDGES}) GROUP BY 1, 2), t AS (SELECT axis, sum(n) AS total FROM c GROUP BY axis)
SELECT axis, w AS name, n FROM (SELECT axis, w, n, row_number() OVER (PARTITION BY axis ORDER BY n DESC, w) AS k FROM c JOIN t USING (axis) WHERE n * 2 <= total) WHERE k = 1""",
)
def pole_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent word of each axis that does not make up more than half of it, alphabetical among equals."""
    c = edges_of(spark, sf_dir).groupBy(F.col("relation").alias("axis"), F.col("source").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("total", F.sum("n").over(Window.partitionBy("axis")))
    w = Window.partitionBy("axis").orderBy(F.desc("n"), "w")
    return c.where("n * 2 <= total").withColumn("k", F.row_number().over(w)).where("k = 1").select("axis", F.col("w").alias("name"), "n")


@registry.query(
    "word_axis_index",
    f"SELECT w, list_sort(list(axis)) AS axes FROM {_MEMBERS} GROUP BY w",
)
def word_axis_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = edges_of(spark, sf_dir).where("relation LIKE 'has-%'")
    return m.groupBy(F.col("target").alias("w")).agg(F.array_sort(F.collect_set("relation")).alias("axes"))


@registry.query("cluster_statistics", "SELECT label, count(*) AS n, count(*) = 1 AS singleton FROM embeddings GROUP BY label")
def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("singleton", F.col("n") == 1)


#: Members of one group that are clustered at once; larger groups are cut by a hash into parts of about this size.
GROUP_ROWS = 800


def _grouped(spark: SparkSession, sf_dir: str, f, schema: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    parts = v.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("parts"))
    placed = bounded_join(v, parts, "label").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    return placed.groupBy("label", "part").applyInArrow(f, schema)


def _unit_rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = t.sort_by("vec_id")
    x = np.array(t.column("v").to_pylist(), float)
    return t.column("vec_id").to_numpy(), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


@registry.query("linkage_clusters")
def linkage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete linkage of each group's vectors by cosine distance, cut where the silhouette is best."""

    def run(t: pa.Table) -> pa.Table:
        ids, x = _unit_rows(t)
        d = np.clip(1 - x @ x.T, 0, None)
        merges = cluster.linkage(d)
        h, s = cluster.best_height(d, merges, 2, max(2, len(ids) // 2))
        n = len(ids)
        return pa.table(
            {"label": t.column("label").combine_chunks()[:n], "vec_id": ids, "cluster": cluster.cut(n, merges, h).astype(np.int32), "height": np.full(n, h), "silhouette": np.full(n, s)}
        )

    return _grouped(spark, sf_dir, run, "label int, vec_id long, cluster int, height double, silhouette double")


@registry.query("louvain")
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Louvain communities of each group's graph of cosines above 0.2."""

    def run(t: pa.Table) -> pa.Table:
        ids, x = _unit_rows(t)
        s = x @ x.T
        i, j = np.nonzero(np.triu(s, 1) > 0.2)
        found = cluster.communities([(int(a), int(b), float(s[a, b])) for a, b in zip(i, j)], len(ids))
        return pa.table({"label": t.column("label").combine_chunks(), "vec_id": ids, "community": np.array(found, np.int32)})

    return _grouped(spark, sf_dir, run, "label int, vec_id long, community int")


@registry.query("sense_split")
def sense_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose vectors fall into two clusters with a silhouette above 0.1, and the split."""

    def run(t: pa.Table) -> pa.Table:
        ids, x = _unit_rows(t)
        labels, s = cluster.kmeans_split(x)
        n = len(ids)
        return pa.table({"label": t.column("label").combine_chunks(), "vec_id": ids, "sense": labels.astype(np.int32), "silhouette": np.full(n, s), "split": np.full(n, s > 0.1)})

    return _grouped(spark, sf_dir, run, "label int, vec_id long, sense int, silhouette double, split boolean")

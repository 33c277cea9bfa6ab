"""Anchor dimensions, senses in the vector table, axis assembly and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..core.session import materialise
from ..core.sizing import bounded_join, rows_at_most
from ..core.terms import term, term_sql
from ..functions import anchors, vec
from ..operators import graph
from . import Registry, table
from .axes import _LINKS, _AXES, PAIRS, _links, opposites, shared_poles, written_opposites
from .graph import EDGES, edges_of
from .vectors import E, LONG, PAIR_DIMS, PAIRS as VEC_PAIRS, POLARITY_DIMS, _NOT_A, long_form, pair_dims, r6, vectors

registry = Registry()
__all__ = ["registry", "HUB"]


@registry.query("anchor_table", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate(anchors.ANCHORS)) + ") t(idx, name, type)")
def anchor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.table(spark)


_POS = "upper(regexp_replace(trim(pos_tag, ' ' || chr(9)), '^Tag\\.', ''))"


@registry.query(
    "anchor_vectors",
    f"""SELECT word, list_transform(range(51), lambda i: CASE WHEN i = {anchors.INDEX['determinatory']} THEN d WHEN i = {anchors.INDEX['nominal']} THEN n ELSE 0.0::DOUBLE END) AS v
FROM (SELECT {term_sql('word')} AS word, max(CASE WHEN {_POS} = 'DET' THEN 1.0 ELSE 0.0 END)::DOUBLE AS d, max(CASE WHEN {_POS} IN ('NOUN', 'PRON') THEN 1.0 ELSE 0.0 END)::DOUBLE AS n
      FROM word_context GROUP BY 1) WHERE word IS NOT NULL""",
)
def anchor_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor cells of each word over all its occurrences (the larger value wins)."""
    pos = F.upper(F.regexp_replace(F.btrim("pos_tag", F.lit(" \t")), r"^Tag\.", ""))
    c = table(spark, sf_dir, "word_context").select(term("word").alias("word"), pos.alias("pos")).where("word IS NOT NULL").distinct()
    v = c.select("word", anchors.vector(F.coalesce("pos", F.lit("X")), F.array().cast("array<string>")).alias("v"))
    return v.groupBy("word").agg(*[F.max(F.get("v", F.lit(i))).alias(f"c{i}") for i in (0, 26)]).select(
        "word", F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: F.when(i == 0, F.col("c0")).when(i == 26, F.col("c26")).otherwise(F.lit(0.0))).alias("v")
    )


@registry.query(
    "metadata_features",
    """SELECT e.key AS feature, e.value AS value, count(*) AS n FROM (SELECT unnest(map_entries(metadata)) AS e FROM (SELECT DISTINCT node_id, metadata FROM graph_node) WHERE metadata IS NOT NULL) GROUP BY 1, 2""",
)
def metadata_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every metadata feature of the nodes; repeated rows count once."""
    n = table(spark, sf_dir, "graph_node").select("node_id", F.array_sort(F.map_entries("metadata")).alias("m")).where("m IS NOT NULL").distinct()
    return n.select(F.explode("m").alias("e")).groupBy(F.col("e.key").alias("feature"), F.col("e.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


_WORDS = """(SELECT DISTINCT word_id, word, regexp_replace(word, '_wn\\..*$', '') AS base, embeddings::DOUBLE[] AS v, checkpoint FROM word_vector
WHERE embeddings IS NOT NULL AND word IS NOT NULL AND len(embeddings) = 64 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x))) = 0)"""


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "word_vector").select(
        "word_id", "word", F.regexp_replace("word", r"_wn\..*$", "").alias("base"), F.col("embeddings").cast("array<double>").alias("v"), "checkpoint"
    )
    good = F.col("word").isNotNull() & (F.size("v") == 64) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    return w.where(good).distinct()


@registry.query(
    "sense_separation",
    f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY word, word_id) AS k FROM {_WORDS})
SELECT a.word_id AS id1, b.word_id AS id2, a.base, round(CASE WHEN list_sum(list_transform(a.v, lambda x: x * x)) = 0 OR list_sum(list_transform(b.v, lambda x: x * x)) = 0 THEN 0 ELSE list_cosine_similarity(a.v, b.v) END, 6) + 0.0 AS cosine,
  round(list_distance(a.v, b.v), 6) AS distance FROM w a JOIN w b ON a.base = b.base AND a.k < b.k WHERE a.k <= 5 AND b.k <= 5""",
)
def sense_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and distance among the first five senses of a word."""
    w = word_vectors(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("word", "word_id"))).where("k <= 5")
    b = w.select("base", F.col("word_id").alias("id2"), F.col("k").alias("k2"), F.col("v").alias("v2"))
    p = w.select("base", F.col("word_id").alias("id1"), "k", "v").join(b, "base").where("k < k2")
    return p.select("id1", "id2", "base", r6(vec.cosine(F.col("v"), F.col("v2")), "cosine"), r6(vec.euclid(F.col("v"), F.col("v2")), "distance"))


@registry.query(
    "checkpoint_compare",
    f"SELECT checkpoint, count(*) AS vectors, count(DISTINCT base) AS words, round(avg(sqrt(list_sum(list_transform(v, lambda x: x * x)))), 6) AS norm FROM {_WORDS} GROUP BY checkpoint",
)
def checkpoint_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_vectors(spark, sf_dir)
    return w.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("base").alias("words"), r6(F.avg(vec.norm(F.col("v"))), "norm"))


@registry.query(
    "knn_batch",
    f"""SELECT q.vec_id AS query, e.vec_id AS neighbour, round(list_cosine_similarity(q.v, e.v), 6) + 0.0 AS cosine, rank
FROM (SELECT q.vec_id AS qi, e.vec_id AS ei, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 6) DESC, e.vec_id) AS rank
      FROM {E} q JOIN {E} e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0) t JOIN {E} q ON q.vec_id = qi JOIN {E} e ON e.vec_id = ei WHERE rank <= 5""",
)
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours of every hundredth vector against all rows, in blocks of queries that are broadcast."""
    return nearest_of(vectors(spark, sf_dir), vectors(spark, sf_dir).where("vec_id % 100 = 0"), 5)


QUERY_BLOCK = 20_000


def nearest_of(e: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of ``e`` by cosine for each query; each block of queries is broadcast and scans ``e`` once."""
    q = queries.select(F.col("vec_id").alias("query"), F.col("v").alias("q"))
    blocks = 1 if rows_at_most(q, QUERY_BLOCK) else -(-q.count() // QUERY_BLOCK)
    out = None
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        s = e.select(F.col("vec_id").alias("neighbour"), "v").join(F.broadcast(part), F.col("neighbour") != F.col("query"))
        s = s.select("query", "neighbour", r6(vec.cosine(F.col("v"), F.col("q")), "cosine"))
        w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
        top = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    return out


@registry.query(
    "not_rank",
    f"""WITH p AS (SELECT id1, {_NOT_A} AS n, b FROM {VEC_PAIRS} WHERE id1 % 100 = 0 AND kind = 'antonym')
SELECT id1, count(*) FILTER (round(list_cosine_similarity(n, v), 6) > round(list_cosine_similarity(n, b), 6)) + 1 AS rank FROM p, {E} WHERE vec_id <> id1 GROUP BY id1, n, b""",
)
def not_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the antonym among all vectors nearest to the negated word, for every hundredth pair."""
    from .vectors import pairs

    p = pairs(spark, sf_dir).where("id1 % 100 = 0 AND kind = 'antonym'")
    p = p.select("id1", vec.vec_not(F.col("a"), POLARITY_DIMS).alias("n"), "b")
    p = p.select("id1", "n", F.round(vec.cosine(F.col("n"), F.col("b")), 6).alias("own"))
    blocks = 1 if rows_at_most(p, QUERY_BLOCK) else -(-p.count() // QUERY_BLOCK)
    out = None
    for b in range(blocks):
        part = p if blocks == 1 else p.where(F.pmod(F.xxhash64("id1"), F.lit(blocks)) == b)
        s = vectors(spark, sf_dir).join(F.broadcast(part), F.col("vec_id") != F.col("id1"))
        r = s.groupBy("id1").agg((F.count_if(F.round(vec.cosine(F.col("n"), F.col("v")), 6) > F.col("own")) + 1).alias("rank"))
        out = r if out is None else out.unionByName(r)
    return out


@registry.query(
    "axis_selectivity",
    f"""WITH d AS (SELECT label, dim, avg(abs(v)) AS m FROM {LONG} GROUP BY 1, 2), t AS (SELECT label, dim, m, row_number() OVER (PARTITION BY label ORDER BY m DESC, dim) AS k FROM d)
SELECT count(*) AS total, count(DISTINCT dim) AS dims, round(1 - count(DISTINCT dim)::DOUBLE / count(*), 6) AS overlap FROM t WHERE k <= 3""",
)
def axis_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the three strongest dimensions of the groups coincide."""
    d = long_form(spark, sf_dir).groupBy("label", "dim").agg(F.avg(F.abs("v")).alias("m"))
    t = d.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("m"), "dim"))).where("k <= 3")
    return t.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("dim").alias("dims"), r6(1 - F.try_divide(F.countDistinct("dim"), F.count(F.lit(1))), "overlap"))


@registry.query(
    "cluster_alignment",
    f"""SELECT dim, round(avg(CASE WHEN label = 0 THEN (v > 0)::INT WHEN label = 1 THEN (v < 0)::INT END), 6) AS accuracy, count(*) FILTER (label IN (0, 1)) AS members
FROM {LONG} WHERE dim IN {tuple(POLARITY_DIMS)} GROUP BY dim""",
)
def cluster_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a positive (label 0) and a negative group (label 1) with the sign their configuration asks for."""
    ok = F.when(F.col("label") == 0, (F.col("v") > 0).cast("int")).when(F.col("label") == 1, (F.col("v") < 0).cast("int"))
    d = long_form(spark, sf_dir).where(F.col("dim").isin(*POLARITY_DIMS)).groupBy("dim")
    return d.agg(r6(F.avg(ok), "accuracy"), F.count_if(F.col("label").isin(0, 1)).alias("members"))


@registry.query(
    "antonym_polarization",
    f"SELECT dim, round(avg((x * y < 0)::INT), 6) AS polarized, round(avg(abs(x - y)), 6) AS strength, count(*) AS pairs FROM {PAIR_DIMS} WHERE kind = 'antonym' AND dim < 51 GROUP BY dim",
)
def antonym_polarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    p = pair_dims(spark, sf_dir).where("kind = 'antonym' AND dim < 51").groupBy("dim")
    return p.agg(r6(F.avg((x * y < 0).cast("int")), "polarized"), r6(F.avg(F.abs(x - y)), "strength"), F.count(F.lit(1)).alias("pairs"))


_POLES = f"""WITH RECURSIVE {_LINKS}, k AS (SELECT a, b FROM l WHERE shared >= 4), u AS (SELECT a AS u, b AS v FROM k UNION SELECT b, a FROM k),
r AS (SELECT u AS node, u AS seen FROM u UNION SELECT r.node, u.v FROM r JOIN u ON r.seen = u.u), c AS (SELECT node, min(seen) AS pole FROM r GROUP BY node)"""


def poles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    links = materialise(_links(written_opposites(spark, sf_dir)), "pole-links")
    c = graph.components(links.where("shared >= 4"), "a", "b").withColumnRenamed("component", "pole")
    return links, materialise(c, "poles")


@registry.query(
    "graph_confidence",
    f"""{_POLES} SELECT count(*) AS edges, count(*) FILTER (x.pole = y.pole) AS internal, round(0.5 + 0.5 * count(*) FILTER (x.pole = y.pole)::DOUBLE / count(*), 6) AS confidence
FROM l JOIN c x ON x.node = a JOIN c y ON y.node = b""",
)
def graph_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.5 + 0.5 · share of links inside a pole."""
    links, c = poles(spark, sf_dir)
    j = bounded_join(bounded_join(links, c.toDF("a", "pa"), "a"), c.toDF("b", "pb"), "b")
    inside = F.count_if(F.col("pa") == F.col("pb"))
    n = F.count(F.lit(1))
    return j.agg(n.alias("edges"), inside.alias("internal"), r6(0.5 + 0.5 * F.try_divide(inside, n), "confidence"))


@registry.query(
    "axis_expansion",
    f"""{_POLES}, z AS (SELECT pole, count(*) AS size FROM c GROUP BY pole), m AS (SELECT a AS w, b AS x FROM l UNION ALL SELECT b, a FROM l)
SELECT w AS word, c.pole, count(*) AS shared, round(count(*)::DOUBLE / any_value(size), 6) AS share FROM m JOIN c ON c.node = x JOIN z ON z.pole = c.pole LEFT JOIN c o ON o.node = w
WHERE o.pole IS NULL OR o.pole <> c.pole GROUP BY w, c.pole HAVING count(*) >= 0.7 * any_value(size)""",
)
def axis_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that share opposites with at least 70 % of a pole they are not in."""
    links, c = poles(spark, sf_dir)
    size = c.groupBy("pole").agg(F.count(F.lit(1)).alias("size"))
    m = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    j = bounded_join(m, c.select(F.col("node").alias("b"), "pole"), "b")
    j = bounded_join(j, c.select(F.col("node").alias("a"), F.col("pole").alias("own")), "a", "left").where("own IS NULL OR own <> pole")
    n = bounded_join(j.groupBy(F.col("a").alias("word"), "pole").agg(F.count(F.lit(1)).alias("shared")), size, "pole")
    return n.where("shared >= 0.7 * size").select("word", "pole", "shared", r6(F.col("shared") / F.col("size"), "share"))


def _stars(pairs: DataFrame) -> DataFrame:
    """(centre, pole, n): poles in order of their names; each one not yet taken takes the later ones beside it that are not yet taken.

    The same as one pass in order, in rounds: a pole without an earlier undecided one beside it is a centre, and
    what lies beside a centre is taken. What is never taken is a centre; the earliest centre beside a taken pole
    has it. ``pairs`` has ``a`` < ``b`` and ``n``.
    """
    every = materialise(pairs, "opposing-poles")
    undecided, taken = every, None
    while not undecided.isEmpty():
        first = undecided.select("a").distinct().join(undecided.select(F.col("b").alias("a")), "a", "left_anti")
        first = materialise(first, "centres")
        new = materialise(bounded_join(undecided, first, "a", "left_semi", spread=["b"]).select("b").distinct(), "taken-poles")
        taken = new if taken is None else taken.unionByName(new)
        gone = materialise(new.withColumnRenamed("b", "p").unionByName(first.withColumnRenamed("a", "p")), "decided-poles")
        rest = bounded_join(undecided, gone.withColumnRenamed("p", "a"), "a", "left_anti", spread=["b"])
        undecided = materialise(bounded_join(rest, gone.withColumnRenamed("p", "b"), "b", "left_anti", spread=["a"]), "undecided-poles")
    if taken is None:
        return every.select(F.col("a").alias("centre"), F.col("b").alias("pole"), "n")
    own = bounded_join(every, taken.withColumnRenamed("b", "a"), "a", "left_anti", spread=["b"])
    best = own.groupBy("b").agg(F.min(F.struct("a", "n")).alias("m"))
    return best.select(F.col("m.a").alias("centre"), F.col("b").alias("pole"), F.col("m.n").alias("n"))


@registry.query("axis_assembly")
def axis_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of poles that oppose one another, each pole in one axis, smaller pole names first."""
    p = written_opposites(spark, sf_dir)
    c = materialise(shared_poles(p).withColumnRenamed("component", "pole"), "poles")
    j = bounded_join(bounded_join(p, c.toDF("w1", "p1"), "w1"), c.toDF("w2", "p2"), "w2").where("p1 <> p2")
    n = j.groupBy(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    axes = _stars(n).groupBy("centre").agg(F.array_sort(F.collect_set("pole")).alias("mates"), F.sum("n").alias("pairs"))
    axes = materialise(axes, "axes")
    ids = graph.vocabulary(axes.select(F.col("centre").alias("word"))).withColumnRenamed("word", "centre")
    named = axes.join(ids, "centre").select(F.col("word_id").cast("int").alias("axis_id"), F.concat(F.array("centre"), "mates").alias("poles"), "pairs")

    def place(batches):
        import pyarrow as pa

        for b in batches:
            points = [[v for _, v in anchors.pole_geometry(names)] for names in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(points, pa.list_(pa.list_(pa.float64())))], names=["axis_id", "poles", "pairs", "vertices"])

    return named.mapInArrow(place, "axis_id int, poles array<string>, pairs long, vertices array<array<double>>")


@registry.query(
    "representative_pairs",
    f"""WITH e AS (SELECT source, target FROM ({EDGES}) WHERE relation = 'compared-to'), n AS (SELECT w, CASE WHEN sum(s) > 0 THEN 1 ELSE 2 END AS pole FROM (SELECT source AS w, 1 AS s FROM e UNION ALL SELECT target, -1 FROM e) GROUP BY w)
SELECT w1, w2, CASE WHEN x.pole <> y.pole THEN 2.0 ELSE 0.5 END::DOUBLE AS score FROM {PAIRS} JOIN n x ON x.w = w1 JOIN n y ON y.w = w2 ORDER BY score DESC, w1, w2 LIMIT 5""",
)
def representative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pairs whose words stand in different poles, in order."""
    e = edges_of(spark, sf_dir).where("relation = 'compared-to'")
    ends = e.select(F.explode(F.array(F.struct(F.col("source").alias("w"), F.lit(1).alias("s")), F.struct(F.col("target").alias("w"), F.lit(-1).alias("s")))).alias("x"))
    n = ends.groupBy(F.col("x.w").alias("w")).agg(F.when(F.sum("x.s") > 0, F.lit(1)).otherwise(F.lit(2)).alias("pole"))
    j = bounded_join(bounded_join(opposites(spark, sf_dir), n.toDF("w1", "p1"), "w1"), n.toDF("w2", "p2"), "w2")
    score = F.when(F.col("p1") != F.col("p2"), F.lit(2.0)).otherwise(F.lit(0.5))
    return j.select("w1", "w2", score.alias("score")).orderBy(F.desc("score"), "w1", "w2").limit(5)


@registry.query(
    "axis_validation",
    f"SELECT count(*) AS axes, min(size) AS min_size, max(size) AS max_size, round(avg(coherence), 6) AS mean_coherence, round(median(coherence), 6) AS median_coherence, count(DISTINCT axis)::DOUBLE / count(*) AS name_diversity FROM {_AXES}",
)
def axis_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = edges_of(spark, sf_dir).groupBy(F.col("relation").alias("axis")).agg(F.count(F.lit(1)).alias("size"), graph.mean("confidence").alias("coherence"))
    return a.agg(
        F.count(F.lit(1)).alias("axes"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), r6(F.avg("coherence"), "mean_coherence"),
        r6(F.median("coherence"), "median_coherence"), F.try_divide(F.countDistinct("axis"), F.count(F.lit(1))).alias("name_diversity"),
    )

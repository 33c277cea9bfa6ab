"""Vector queries over ``embeddings``: algebra, neighbours, per-dimension statistics, polarity and losses.

Row-wise operators use higher-order functions; per-dimension ones use the long form
(vec_id, dim, v), which aggregates map-side. Pairs are (i, i + 1): the same label is a synonym,
another one an antonym.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..core.sizing import bounded_join
from ..functions import vec
from ..operators import stats
from ..operators.graph import mean
from . import Registry, table

registry = Registry()
DIMS = 64
POLARITY_DIMS = [0, 3, 5, 8, 13, 21]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", "label", F.posexplode("v").alias("dim", "v"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id1, id2, kind, a, b), joined by key; the next vector is an equi-join on id + 1."""
    e = vectors(spark, sf_dir)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("id2"), F.col("v").alias("b"), F.col("label").alias("l2"))
    kind = F.when(F.col("label") == F.col("l2"), F.lit("synonym")).otherwise(F.lit("antonym"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("id1"), "id2", kind.alias("kind"), F.col("v").alias("a"), "b")


def pair_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id1, id2, kind, dim, x, y) without a second join: both arrays are zipped and exploded."""
    p = pairs(spark, sf_dir).select("id1", "id2", "kind", F.posexplode(F.arrays_zip(F.col("a").alias("x"), F.col("b").alias("y"))).alias("dim", "z"))
    return p.select("id1", "id2", "kind", "dim", F.col("z.x").alias("x"), F.col("z.y").alias("y"))


E = "(SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
LONG = f"(SELECT vec_id, label, (unnest(range(len(v))))::INT AS dim, unnest(v) AS v FROM {E})"
PAIRS = f"""(SELECT x.vec_id AS id1, y.vec_id AS id2, CASE WHEN x.label = y.label THEN 'synonym' ELSE 'antonym' END AS kind, x.v AS a, y.v AS b
FROM {E} x JOIN {E} y ON y.vec_id = x.vec_id + 1)"""
PAIR_DIMS = f"(SELECT id1, id2, kind, (unnest(range(len(a))))::INT AS dim, unnest(a) AS x, unnest(b) AS y FROM {PAIRS})"
NORM = "sqrt(list_sum(list_transform({0}, lambda t: t * t)))"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda t: t[1] * t[2]))"


def zipped(body: str) -> str:
    """SQL list of ``body`` over elements x and y of a and b, rounded."""
    return f"list_transform(list_zip(a, b), lambda t: round({body.replace('#x', 't[1]').replace('#y', 't[2]')}, 6) + 0.0)"


def r6(c: Column | str, name: str) -> Column:
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


@registry.query("vec_norm", f"SELECT vec_id, round({NORM.format('v')}, 6) AS norm, list_transform(v, lambda t: round(t / {NORM.format('v')}, 6) + 0.0) AS unit FROM {E}")
def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", r6(vec.norm(F.col("v")), "norm"), vec.rounded(vec.normalise(F.col("v"))).alias("unit"))


@registry.query(
    "vec_cosine",
    f"SELECT id1, id2, kind, round(list_cosine_similarity(a, b), 6) + 0.0 AS cosine, round(list_distance(a, b), 6) AS euclid, round({DOT.format('a', 'b')}, 6) + 0.0 AS dot FROM {PAIRS}",
)
def vec_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf_dir).select("id1", "id2", "kind", r6(vec.cosine(a, b), "cosine"), r6(vec.euclid(a, b), "euclid"), r6(vec.dot(a, b), "dot"))


_IN_POL = f"list_contains({POLARITY_DIMS}, i - 1)"


@registry.query("vec_not", f"SELECT vec_id, list_transform(v, lambda x, i: CASE WHEN {_IN_POL} THEN -x ELSE x END) AS v FROM {E}")
def vec_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", vec.vec_not(F.col("v"), POLARITY_DIMS).alias("v"))


_NA, _NB = NORM.format("a"), NORM.format("b")
_ALGEBRA = {
    "vec_and_avg": (lambda a, b: vec.vec_and(a, b), "(#x + #y) / 2"),
    "vec_and_weighted": (lambda a, b: vec.vec_and(a, b, "weighted"), f"({_NA} * #x + {_NB} * #y) / ({_NA} + {_NB})"),
    "vec_and_min": (lambda a, b: vec.vec_and(a, b, "min"), "CASE WHEN abs(#x) < abs(#y) THEN #x ELSE #y END"),
    "vec_or_max": (lambda a, b: vec.vec_or(a, b), "CASE WHEN abs(#x) > abs(#y) THEN #x ELSE #y END"),
    "vec_or_avg": (lambda a, b: vec.vec_or(a, b, "average"), "(#x + #y) / 2"),
    "vec_or_weighted": (lambda a, b: vec.vec_or(a, b, "weighted"), f"({_NA} * #x + {_NB} * #y) / ({_NA} + {_NB})"),
}


def _algebra(name: str, f, sql: str) -> None:
    if "#x) /" in sql or _NA in sql:
        sql = f"SELECT id1, id2, {zipped(sql.replace(_NA, 'na').replace(_NB, 'nb'))} AS v FROM (SELECT *, {_NA} AS na, {_NB} AS nb FROM {PAIRS})"
    else:
        sql = f"SELECT id1, id2, {zipped(sql)} AS v FROM {PAIRS}"

    @registry.query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pairs(spark, sf_dir).select("id1", "id2", vec.rounded(f(F.col("a"), F.col("b"))).alias("v"))


for _name, (_f, _sql) in _ALGEBRA.items():
    _algebra(_name, _f, _sql)

EDGE_TYPES = ["SUBJECT", "OBJECT", "DESCRIPTION", "MODIFICATION", "SPECIFICATION", "COORDINATION", "PREPOSITION", "SUBORDINATION", "COMPLEMENT"]


@registry.query(
    "compose_by_edge",
    f"""SELECT id1, id2, edge, CASE edge WHEN 'DESCRIPTION' THEN {zipped('#x * #y')} WHEN 'SPECIFICATION' THEN {zipped('#x * (1 + 0.2 * m)')}
  WHEN 'COORDINATION' THEN {zipped('(#x + #y) / 2')} ELSE {zipped('#x + w * #y')} END AS v
FROM (SELECT *, list_sum(b) / len(b) AS m, (CASE edge WHEN 'MODIFICATION' THEN 0.3 WHEN 'PREPOSITION' THEN 0.4 WHEN 'SUBORDINATION' THEN 0.6 ELSE 0.5 END)::DOUBLE AS w
      FROM (SELECT *, {EDGE_TYPES}[(id1 % 9)::INT + 1] AS edge FROM {PAIRS}))""",
)
def compose_by_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.element_at(F.array(*[F.lit(e) for e in EDGE_TYPES]), (F.col("id1") % 9).cast("int") + 1)
    p = pairs(spark, sf_dir).withColumn("edge", edge)
    return p.select("id1", "id2", "edge", vec.rounded(vec.compose(F.col("a"), F.col("b"), F.col("edge"))).alias("v"))


def _nearest(measure: str, best: str):
    sql = f"""SELECT vec_id, {measure.format('v', 'q')} AS score FROM {E}, (SELECT v AS q FROM {E} WHERE vec_id = 0) WHERE vec_id <> 0
ORDER BY score {best}, vec_id LIMIT 10"""
    return sql


def _knn(spark: SparkSession, sf_dir: str, score, descending: bool) -> DataFrame:
    """One query vector against all rows: a one-row broadcast, then a bounded top k without a full sort."""
    e = vectors(spark, sf_dir)
    q = e.where("vec_id = 0").select(F.col("v").alias("q")).limit(1)
    s = e.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", r6(score(F.col("v"), F.col("q")), "score"))
    return s.orderBy(F.desc("score") if descending else F.col("score"), "vec_id").limit(10)


@registry.query("knn_cosine", _nearest("round(list_cosine_similarity({0}, {1}), 6) + 0.0", "DESC"))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, vec.cosine, True)


@registry.query("knn_dot", _nearest(f"round({DOT}, 6) + 0.0", "DESC"))
def knn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, vec.dot, True)


@registry.query("knn_euclid", _nearest("round(list_distance({0}, {1}) / sqrt(64), 6)", "ASC"))
def knn_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, lambda a, b: vec.euclid(a, b) / F.lit(8.0), False)


_DIM = "round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std, round(var_pop(v), 6) AS variance, round(min(v), 6) AS min_val, round(max(v), 6) AS max_val"


def _dim_aggs() -> list[Column]:
    return [r6(F.avg("v"), "mean"), r6(F.stddev_pop("v"), "std"), r6(F.var_pop("v"), "variance"), r6(F.min("v"), "min_val"), r6(F.max("v"), "max_val")]


@registry.query("dim_stats", f"SELECT dim, {_DIM}, round(median(v), 6) + 0.0 AS median FROM {LONG} GROUP BY dim")
def dim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = long_form(spark, sf_dir)
    middle = stats.medians(l, "dim", "v").select("dim", r6(F.col("median"), "median"))
    return l.groupBy("dim").agg(*_dim_aggs()).join(middle, "dim")


@registry.query(
    "dim_topk",
    f"""WITH s AS (SELECT dim, vec_id, v, 'top' AS side, -v AS o FROM {LONG} WHERE v > 0.01 UNION ALL SELECT dim, vec_id, v, 'bottom', v FROM {LONG} WHERE v < -0.01)
SELECT dim, side, vec_id, v, rank FROM (SELECT *, row_number() OVER (PARTITION BY dim, side ORDER BY o, vec_id) AS rank FROM s) WHERE rank <= 10""",
)
def dim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of each dimension; Spark keeps ten rows of a partition before it shuffles."""
    l = long_form(spark, sf_dir).where(F.abs("v") > 0.01)
    side = F.when(F.col("v") > 0, F.lit("top")).otherwise(F.lit("bottom"))
    w = Window.partitionBy("dim", "side").orderBy("o", "vec_id")
    ranked = l.withColumn("side", side).withColumn("o", -F.abs("v")).withColumn("rank", F.row_number().over(w))
    return ranked.where("rank <= 10").select("dim", "side", "vec_id", "v", "rank")


@registry.query(
    "dim_usage",
    f"""SELECT dim, avg((abs(v) > 1e-6)::INT) AS used, round(sum(abs(v)), 6) AS l1, count(*) FILTER (abs(v) < 0.1) AS below_01,
  count(*) FILTER (abs(v) < 0.3) AS below_03, count(*) FILTER (abs(v) < 0.7) AS below_07, avg((abs(v) < 0.01)::INT) AS sparsity FROM {LONG} GROUP BY dim""",
)
def dim_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.abs("v")

    def share(c: Column) -> Column:
        return F.avg(F.when(c, 1).otherwise(0))

    return long_form(spark, sf_dir).groupBy("dim").agg(
        share(size > 1e-6).alias("used"), r6(F.sum(size), "l1"), F.count_if(size < 0.1).alias("below_01"), F.count_if(size < 0.3).alias("below_03"),
        F.count_if(size < 0.7).alias("below_07"), share(size < 0.01).alias("sparsity"),
    )


@registry.query(
    "dim_saturation",
    f"SELECT count(*) AS dims, count(*) FILTER (used >= 0.3) AS saturated, count(*) FILTER (used >= 0.3) >= 0.8 * count(*) AS add_dimensions, count(*) FILTER (used < 0.05) AS prunable FROM (SELECT dim, avg((abs(v) > 1e-6)::INT) AS used FROM {LONG} GROUP BY dim)",
)
def dim_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = long_form(spark, sf_dir).groupBy("dim").agg(F.avg(F.when(F.abs("v") > 1e-6, 1).otherwise(0)).alias("used"))
    full = F.count_if(F.col("used") >= 0.3)
    n = F.count(F.lit(1))
    return used.agg(n.alias("dims"), full.alias("saturated"), (full >= 0.8 * n).alias("add_dimensions"), F.count_if(F.col("used") < 0.05).alias("prunable"))


@registry.query("sparsity", f"SELECT round(avg((abs(v) < 0.01)::INT), 6) AS sparsity, round(avg(abs(v)), 6) AS mean_abs, count(*) AS cells FROM {LONG}")
def sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(spark, sf_dir).agg(
        r6(F.avg(F.when(F.abs("v") < 0.01, 1).otherwise(0)), "sparsity"), r6(F.avg(F.abs("v")), "mean_abs"), F.count(F.lit(1)).alias("cells")
    )


@registry.query(
    "high_low_variance",
    f"""WITH d AS (SELECT dim, var_pop(v) AS x FROM {LONG} GROUP BY dim)
SELECT dim, 'high' AS kind, round(x, 6) AS variance FROM (FROM d ORDER BY x DESC, dim LIMIT 20) UNION ALL SELECT dim, 'low', round(x, 6) FROM d WHERE x < 0.01""",
)
def high_low_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = long_form(spark, sf_dir).groupBy("dim").agg(F.var_pop("v").alias("x"))
    high = d.orderBy(F.desc("x"), "dim").limit(20).select("dim", F.lit("high").alias("kind"), r6("x", "variance"))
    return high.unionByName(d.where("x < 0.01").select("dim", F.lit("low").alias("kind"), r6("x", "variance")))


@registry.query("model_statistics", f"SELECT count(*) AS vectors, round(avg({NORM.format('v')}), 6) AS norm_mean, round(stddev_pop({NORM.format('v')}), 6) AS norm_std FROM {E}")
def model_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vectors(spark, sf_dir).select(vec.norm(F.col("v")).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("vectors"), r6(F.avg("n"), "norm_mean"), r6(F.stddev_pop("n"), "norm_std"))


@registry.query(
    "sign_structure",
    f"""SELECT dim, {_DIM}, count(*) FILTER (v > 0) AS positive, count(*) FILTER (v < 0) AS negative, count(*) FILTER (v = 0) AS zero,
  round(least(count(*) FILTER (v > 0), count(*) FILTER (v < 0))::DOUBLE / greatest(count(*) FILTER (v > 0), count(*) FILTER (v < 0), 1), 6) AS balance
FROM {LONG} WHERE dim IN {tuple(POLARITY_DIMS)} GROUP BY dim""",
)
def sign_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down = F.count_if(F.col("v") > 0), F.count_if(F.col("v") < 0)
    return long_form(spark, sf_dir).where(F.col("dim").isin(*POLARITY_DIMS)).groupBy("dim").agg(
        *_dim_aggs(), up.alias("positive"), down.alias("negative"), F.count_if(F.col("v") == 0).alias("zero"),
        r6(F.least(up, down) / F.greatest(up, down, F.lit(1)), "balance"),
    )


@registry.query(
    "polarity_signed",
    f"""SELECT dim, round(avg(abs(x - y)) * abs(avg(sign(x - y))), 6) AS score, round(abs(avg(sign(x - y))), 6) AS consistency
FROM {PAIR_DIMS} WHERE kind = 'antonym' GROUP BY dim HAVING abs(avg(sign(x - y))) >= 0.02""",
)
def polarity_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions whose antonym pairs are ordered the same way."""
    d = F.col("x") - F.col("y")
    p = pair_dims(spark, sf_dir).where("kind = 'antonym'").groupBy("dim").agg(F.avg(F.abs(d)).alias("m"), F.abs(F.avg(F.sign(d))).alias("c"))
    return p.where("c >= 0.02").select("dim", r6(F.col("m") * F.col("c"), "score"), r6("c", "consistency"))


@registry.query(
    "polarity_opposite",
    f"""SELECT dim, round(avg((x * y < 0)::INT) * avg(abs(x - y)), 6) AS score, round(avg((x * y < 0)::INT), 6) AS opposite
FROM {PAIR_DIMS} WHERE kind = 'antonym' GROUP BY dim HAVING avg((x * y < 0)::INT) >= 0.15""",
)
def polarity_opposite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions on which antonyms often have opposite signs."""
    opposite = F.avg(F.when(F.col("x") * F.col("y") < 0, 1).otherwise(0))
    p = pair_dims(spark, sf_dir).where("kind = 'antonym'").groupBy("dim").agg(opposite.alias("o"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("m"))
    return p.where("o >= 0.15").select("dim", r6(F.col("o") * F.col("m"), "score"), r6("o", "opposite"))


@registry.query(
    "polarity_validate",
    f"""SELECT dim, count(*) FILTER (x * y < 0) AS opposite, count(*) FILTER (x * y >= 0) AS same, round(avg(abs(x - y)), 6) AS mean_difference
FROM {PAIR_DIMS} WHERE kind = 'antonym' AND dim IN {tuple(POLARITY_DIMS)} GROUP BY dim""",
)
def polarity_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opposite and same signs; a zero counts as same."""
    xy = F.col("x") * F.col("y")
    p = pair_dims(spark, sf_dir).where((F.col("kind") == "antonym") & F.col("dim").isin(*POLARITY_DIMS))
    return p.groupBy("dim").agg(F.count_if(xy < 0).alias("opposite"), F.count_if(xy >= 0).alias("same"), r6(F.avg(F.abs(F.col("x") - F.col("y"))), "mean_difference"))


@registry.query(
    "discriminative_dims",
    f"WITH d AS (SELECT dim, avg(abs(x - y)) AS m FROM {PAIR_DIMS} WHERE kind = 'antonym' GROUP BY dim) SELECT dim, round(m, 6) AS difference FROM d WHERE m >= 0.1 ORDER BY m DESC, dim LIMIT 10",
)
def discriminative_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pair_dims(spark, sf_dir).where("kind = 'antonym'").groupBy("dim").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("m"))
    return d.where("m >= 0.1").orderBy(F.desc("m"), "dim").limit(10).select("dim", r6("m", "difference"))


@registry.query(
    "similarity_dims",
    f"WITH d AS (SELECT dim, avg(abs(x - y)) AS m FROM {PAIR_DIMS} WHERE kind = 'synonym' GROUP BY dim) SELECT dim, round(m, 6) AS difference FROM d WHERE m <= 0.2 ORDER BY m, dim LIMIT 10",
)
def similarity_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pair_dims(spark, sf_dir).where("kind = 'synonym'").groupBy("dim").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("m"))
    return d.where("m <= 0.2").orderBy("m", "dim").limit(10).select("dim", r6("m", "difference"))


@registry.query(
    "relation_profiles",
    f"""WITH d AS (SELECT kind, dim, avg(abs(x - y)) AS m, stddev_pop(abs(x - y)) AS s FROM {PAIR_DIMS} GROUP BY 1, 2)
SELECT kind, dim, round(m, 6) AS mean_difference, round(CASE kind WHEN 'synonym' THEN 1 / (m + 1e-6) ELSE m END, 6) AS importance,
  round(m / (s + 1e-6), 6) AS stability FROM d""",
)
def relation_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each dimension by relation: synonyms 1/(m + 1e-6), antonyms m; m/(s + 1e-6) for hierarchies."""
    size = F.abs(F.col("x") - F.col("y"))
    d = pair_dims(spark, sf_dir).groupBy("kind", "dim").agg(F.avg(size).alias("m"), F.stddev_pop(size).alias("s"))
    importance = F.when(F.col("kind") == "synonym", 1 / (F.col("m") + 1e-6)).otherwise(F.col("m"))
    return d.select("kind", "dim", r6("m", "mean_difference"), r6(importance, "importance"), r6(F.col("m") / (F.col("s") + 1e-6), "stability"))


@registry.query(
    "seed_axis",
    f"""WITH d AS (SELECT dim, avg(v) FILTER (label IN (0, 1)) - avg(v) FILTER (label IN (2, 3)) AS separation, stddev_pop(v) AS s FROM {LONG} GROUP BY dim)
SELECT dim, round(separation, 6) + 0.0 AS separation, round(abs(separation) / s, 6) AS strength, rank FROM (SELECT *, row_number() OVER (ORDER BY abs(separation) DESC, dim) AS rank FROM d) WHERE rank <= 5""",
)
def seed_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions that separate two seed groups most (labels 0–1 from 2–3)."""

    def level(*labels: int) -> Column:
        return F.avg(F.when(F.col("label").isin(*labels), F.col("v")))

    d = long_form(spark, sf_dir).groupBy("dim").agg((level(0, 1) - level(2, 3)).alias("x"), F.stddev_pop("v").alias("s"))
    # the window runs over one row for each dimension
    ranked = d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("x")), "dim"))).where("rank <= 5")
    return ranked.select("dim", r6("x", "separation"), r6(F.try_divide(F.abs("x"), F.col("s")), "strength"), "rank")


@registry.query(
    "anchor_validation",
    f"""SELECT dim, round(h - l, 6) + 0.0 AS separation, round((h - l) / r, 6) + 0.0 AS share, (h - l) / r >= 0.01 AS valid
FROM (SELECT dim, avg(v) FILTER (label = 0) AS h, avg(v) FILTER (label = 1) AS l, max(v) - min(v) AS r FROM {LONG} WHERE dim < 51 GROUP BY dim)""",
)
def anchor_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = (F.avg(F.when(F.col("label") == i, F.col("v"))) for i in (0, 1))
    d = long_form(spark, sf_dir).where("dim < 51").groupBy("dim").agg((high - low).alias("s"), (F.max("v") - F.min("v")).alias("r"))
    return d.select("dim", r6("s", "separation"), r6(F.try_divide("s", "r"), "share"), (F.try_divide("s", "r") >= 0.01).alias("valid"))


_NOT_A = f"list_transform(a, lambda x, i: CASE WHEN {_IN_POL} THEN -x ELSE x END)"


@registry.query(
    "not_validation",
    f"""SELECT kind, count(*) AS pairs, round(avg(c), 6) + 0.0 AS mean, round(stddev_pop(c), 6) AS std, count(*) FILTER (c > 0.1) AS successes
FROM (SELECT kind, list_cosine_similarity({_NOT_A}, b) AS c FROM {PAIRS}) GROUP BY kind""",
)
def not_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pairs(spark, sf_dir).select("kind", vec.cosine(vec.vec_not(F.col("a"), POLARITY_DIMS), F.col("b")).alias("c"))
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg("c"), "mean"), r6(F.stddev_pop("c"), "std"), F.count_if(F.col("c") > 0.1).alias("successes"))


@registry.query(
    "pair_polarity",
    f"""SELECT id1, id2, count(*) FILTER (abs(x - y) > 0.2) AS opposing, count(*) FILTER (abs(x - y) <= 0.2) AS similar,
  count(*) FILTER (x * y < 0) AS opposite_sign, round(sqrt(sum((x - y) * (x - y))), 6) AS distance FROM {PAIR_DIMS} WHERE kind = 'antonym' GROUP BY 1, 2""",
)
def pair_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed within each row from the two arrays, without a shuffle beyond the pair join."""
    z = F.zip_with("a", "b", lambda x, y: F.struct(F.abs(x - y).alias("d"), (x * y < 0).alias("o")))
    p = pairs(spark, sf_dir).where("kind = 'antonym'").withColumn("z", z)

    def count(f) -> Column:
        return F.size(F.filter("z", f)).cast("long")

    return p.select(
        "id1", "id2", count(lambda t: t["d"] > 0.2).alias("opposing"), count(lambda t: t["d"] <= 0.2).alias("similar"),
        count(lambda t: t["o"]).alias("opposite_sign"), r6(vec.euclid(F.col("a"), F.col("b")), "distance"),
    )


@registry.query("compare_on_dim", f"SELECT id1, id2, a[8] AS value1, b[8] AS value2, round(a[8] - b[8], 6) + 0.0 AS difference, round((a[8] + b[8]) / 2, 6) + 0.0 AS mean FROM {PAIRS}")
def compare_on_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.get("a", F.lit(7)), F.get("b", F.lit(7))
    return pairs(spark, sf_dir).select("id1", "id2", x.alias("value1"), y.alias("value2"), r6(x - y, "difference"), r6((x + y) / 2, "mean"))


# Distance range and weight of each kind of constraint.
CONSTRAINT_RANGES = {"synonym": (0.0, 0.2, 2.0), "antonym": (0.7, 1.0, 1.5), "hypernym": (0.4, 0.7, 1.0), "hyponym": (0.4, 0.7, 1.0), "cross_lingual": (0.1, 0.3, 1.5), "parse_derived": (0.3, 0.6, 0.8)}
DEFAULT_RANGE = (0.3, 0.6, 1.0)


def constraint_range(kind: Column, i: int) -> Column:
    out = F.lit(DEFAULT_RANGE[i])
    for k, v in CONSTRAINT_RANGES.items():
        out = F.when(kind == k, F.lit(v[i])).otherwise(out)
    return out


_RANGED = f"""(SELECT *, greatest(0, lo - d, d - hi) AS violation FROM (SELECT *, list_distance(a, b) AS d,
  (CASE kind WHEN 'synonym' THEN 0.0 ELSE 0.7 END)::DOUBLE AS lo, (CASE kind WHEN 'synonym' THEN 0.2 ELSE 1.0 END)::DOUBLE AS hi,
  (CASE kind WHEN 'synonym' THEN 2.0 ELSE 1.5 END)::DOUBLE AS w FROM {PAIRS}))"""


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumn("d", vec.euclid(F.col("a"), F.col("b")))
    lo, hi, w = (constraint_range(F.col("kind"), i) for i in range(3))
    return p.withColumns({"violation": F.greatest(F.lit(0.0), lo - F.col("d"), F.col("d") - hi), "w": w})


@registry.query(
    "constraint_loss",
    f"SELECT kind, count(*) AS n, round(sum(w * violation * violation), 6) AS loss, count(*) FILTER (violation = 0) AS satisfied, round(avg((violation = 0)::INT), 6) AS rate FROM {_RANGED} GROUP BY kind",
)
def constraint_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted squared violation of the distance ranges, and how many pairs satisfy theirs."""
    ok = F.col("violation") == 0
    return _ranged(spark, sf_dir).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("w") * F.col("violation") * F.col("violation")), "loss"),
        F.count_if(ok).alias("satisfied"), r6(F.avg(F.when(ok, 1).otherwise(0)), "rate"),
    )


_SIGNED = "(CASE WHEN d < lo THEN -1 ELSE 1 END) * 2 * w * violation / greatest(d, 1e-8)"


@registry.query(
    "constraint_gradient",
    f"""WITH g AS (SELECT id1, id2, (unnest(range(64)))::INT AS dim, unnest(a) AS x, unnest(b) AS y, f FROM (SELECT id1, id2, a, b, {_SIGNED} AS f FROM {_RANGED} WHERE violation > 0))
SELECT vec_id, dim, round(sum(g), 6) + 0.0 AS gradient FROM (SELECT id1 AS vec_id, dim, f * (x - y) AS g FROM g UNION ALL SELECT id2, dim, f * (y - x) FROM g) GROUP BY 1, 2""",
)
def constraint_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the loss for every vector and dimension, both ends summed by key."""
    lo = constraint_range(F.col("kind"), 0)
    sign = F.when(F.col("d") < lo, F.lit(-1)).otherwise(F.lit(1))
    f = sign * 2 * F.col("w") * F.col("violation") / F.greatest(F.col("d"), F.lit(vec.EPS))
    r = _ranged(spark, sf_dir).where("violation > 0").withColumn("f", f)
    # the factor is a column beside the exploded arrays: inside a lambda it would be computed for every dimension
    z = r.select("id1", "id2", "f", F.posexplode(F.arrays_zip(F.col("a").alias("x"), F.col("b").alias("y"))).alias("dim", "z"))
    g = F.col("f") * (F.col("z.x") - F.col("z.y"))
    ends = F.array(F.struct(F.col("id1").alias("id"), g.alias("g")), F.struct(F.col("id2").alias("id"), (-g).alias("g")))
    each = z.select("dim", F.explode(ends).alias("e"))
    return each.groupBy(F.col("e.id").alias("vec_id"), "dim").agg(r6(F.sum("e.g"), "gradient"))


_POL = f"SELECT id1, id2, CASE WHEN x * y > 0 THEN abs(x) + abs(y) WHEN x * y < 0 THEN -(abs(x) + abs(y)) ELSE 0.1 END AS p, CASE WHEN x * y > 0 THEN abs(x) + abs(y) WHEN x * y < 0 THEN -0.5 * (abs(x) + abs(y)) ELSE 0.1 END AS s, (x - y) * (x - y) AS q, dim IN {tuple(POLARITY_DIMS)} AS own FROM {PAIR_DIMS} WHERE kind = 'antonym'"


@registry.query(
    "polarity_loss",
    f"SELECT round(2.0 * sum(p) FILTER (own), 6) AS polarity, round(sum(s) FILTER (own) + 0.5 * avg(q) FILTER (NOT own), 6) AS selective, count(DISTINCT (id1, id2)) AS pairs FROM ({_POL})",
)
def polarity_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same signs on polarity dimensions cost, opposite signs reward; the selective form also keeps the others alike."""
    d = pair_dims(spark, sf_dir).where("kind = 'antonym'")
    x, y, own = F.col("x"), F.col("y"), F.col("dim").isin(*POLARITY_DIMS)
    size = F.abs(x) + F.abs(y)
    p = F.when(x * y > 0, size).when(x * y < 0, -size).otherwise(F.lit(0.1))
    s = F.when(x * y > 0, size).when(x * y < 0, -0.5 * size).otherwise(F.lit(0.1))
    return d.agg(
        r6(2.0 * F.sum(F.when(own, p)), "polarity"),
        r6(F.sum(F.when(own, s)) + 0.5 * F.avg(F.when(~own, (x - y) * (x - y))), "selective"),
        F.countDistinct("id1", "id2").alias("pairs"),
    )


@registry.query(
    "consistency_loss",
    f"""SELECT dim, round(avg(greatest(0, -v)) FILTER (label = 0) + avg(greatest(0, v)) FILTER (label = 1) + 0.1 * avg(abs(v)) FILTER (label = 2), 6) AS loss
FROM {LONG} WHERE dim IN {tuple(POLARITY_DIMS)} GROUP BY dim""",
)
def consistency_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive group above zero, negative below, neutral near it (labels 0, 1 and 2)."""
    v, label = F.col("v"), F.col("label")
    return long_form(spark, sf_dir).where(F.col("dim").isin(*POLARITY_DIMS)).groupBy("dim").agg(
        r6(
            F.avg(F.when(label == 0, F.greatest(F.lit(0.0), -v))) + F.avg(F.when(label == 1, F.greatest(F.lit(0.0), v))) + 0.1 * F.avg(F.when(label == 2, F.abs(v))),
            "loss",
        )
    )


@registry.query(
    "distance_loss",
    f"SELECT kind, round(avg(pow(list_distance(a, b) / 8 - (CASE kind WHEN 'synonym' THEN 0.1 ELSE 0.9 END), 2)), 6) AS loss, round(avg(list_cosine_similarity(a, b)), 6) + 0.0 AS cosine FROM {PAIRS} GROUP BY kind",
)
def distance_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    target = F.when(F.col("kind") == "synonym", F.lit(0.1)).otherwise(F.lit(0.9))
    miss = vec.euclid(a, b) / 8 - target
    return pairs(spark, sf_dir).groupBy("kind").agg(r6(F.avg(miss * miss), "loss"), r6(F.avg(vec.cosine(a, b)), "cosine"))


@registry.query(
    "activation_matrix",
    f"SELECT w AS vec_id, coalesce(v, list_transform(range(64), lambda x: 0.0::DOUBLE)) AS v FROM unnest([1, 5, 999999999]) t(w) LEFT JOIN {E} ON w = vec_id",
)
def activation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of asked ids, a zero row for unknown ones."""
    asked = spark.range(1).select(F.explode(F.array(F.lit(1), F.lit(5), F.lit(999999999))).alias("vec_id"))
    e = vectors(spark, sf_dir).select(F.col("vec_id").cast("int").alias("vec_id"), "v")
    return bounded_join(e, asked, "vec_id", "right").select("vec_id", F.coalesce("v", F.array_repeat(F.lit(0.0), DIMS)).alias("v"))


@registry.query(
    "dimension_reports",
    """WITH a AS (SELECT DISTINCT report_id, dim_index, word, activation FROM dim_activation WHERE activation IS NOT NULL AND isfinite(activation))
SELECT report_id, dim_index, count(*) AS words, round(sum(activation), 6) / count(*) AS mean, round(var_pop(activation), 6) AS variance,
  round(min(activation), 6) + 0.0 AS min_val, round(max(activation), 6) + 0.0 AS max_val, dim_index < 51 AS is_anchor FROM a GROUP BY 1, 2""",
)
def dimension_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics that belong in ``dimension_stats``, from the activations themselves."""
    a = table(spark, sf_dir, "dim_activation").select("report_id", "dim_index", "word", "activation").where(F.abs("activation") < float("inf")).distinct()
    return a.groupBy("report_id", "dim_index").agg(
        F.count(F.lit(1)).alias("words"), mean("activation").alias("mean"), r6(F.var_pop("activation"), "variance"),
        r6(F.min("activation"), "min_val"), r6(F.max("activation"), "max_val"),
    ).withColumn("is_anchor", F.col("dim_index") < 51)

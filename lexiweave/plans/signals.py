"""Signals between antonym pairs, clusters from seeds, coherence and separation of axes, features of senses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.session import materialise
from ..core.terms import term, term_sql
from ..functions import text as fx, vec
from ..operators import graph, lexicon
from . import Registry, table
from .axes import _MEMBERS
from .features import _L
from .graph import edges_of
from .lexicon import EDG, SENSES, SYN
from .vectors import PAIRS, pairs as vector_pairs, r6

registry = Registry()

_UP = f"""e0 AS (SELECT src AS c, dst AS p FROM {EDG} WHERE kind = 'hypernym'), n0 AS (SELECT c AS x FROM e0 UNION SELECT p FROM e0),
u0 AS (SELECT x AS d, x AS a, 0 AS k FROM n0 UNION ALL SELECT d, p, k + 1 FROM u0 JOIN e0 ON a = c WHERE k < 20), up AS (SELECT d, a, min(k) AS k FROM u0 GROUP BY 1, 2)"""
_PATHS = f"""w0 AS (SELECT word, a, min(k) AS k FROM {SENSES} s JOIN up ON d = s.synset_id GROUP BY 1, 2),
path AS (SELECT x.word AS w1, y.word AS w2, 1.0::DOUBLE / (1 + min(x.k + y.k)) AS path FROM w0 x JOIN w0 y ON x.a = y.a AND x.word < y.word GROUP BY 1, 2)"""


def _closure(spark: SparkSession) -> DataFrame:
    return graph.closure(lexicon.literal_edges(spark).where("kind = 'hypernym'"), "src", "dst")


@registry.query(
    "antonym_signals",
    f"""WITH RECURSIVE {_UP}, q AS (SELECT DISTINCT least(src, dst) AS s1, greatest(src, dst) AS s2 FROM {EDG} WHERE kind = 'antonym'), p AS (SELECT s1 || '|' || s2 AS p, s1, s2 FROM q),
side AS (SELECT p, 1 AS side, s1 AS s FROM p UNION ALL SELECT p, 2, s2 FROM p), lem AS (SELECT synset_id, unnest(lemmas) AS l FROM {SYN}),
ends AS (SELECT p, list(DISTINCT x) AS xs FROM (SELECT p, s AS x FROM side UNION ALL SELECT p, l FROM side JOIN lem ON synset_id = s) GROUP BY p),
near AS (SELECT p, side, list(DISTINCT dst) AS xs FROM side JOIN {EDG} ON src = s AND kind = 'similar' GROUP BY 1, 2),
hyp AS (SELECT p, list(DISTINCT a) AS xs FROM side JOIN up ON d = s GROUP BY p),
ws AS (SELECT p, unnest({fx.content_words_sql('definition')}) AS w FROM side JOIN {SYN} ON synset_id = s), tf AS (SELECT p, w, count(*) AS c FROM ws GROUP BY 1, 2),
idf AS (SELECT w, ln((SELECT count(*) FROM p)::DOUBLE / (1 + count(*))) AS i FROM tf GROUP BY w), v AS (SELECT p, w, c::DOUBLE / sum(c) OVER (PARTITION BY p) * i AS x FROM tf JOIN idf USING (w)),
m AS (SELECT p, sqrt(sum(x * x)) AS n FROM v GROUP BY p), dot AS (SELECT a.p AS p1, b.p AS p2, sum(a.x * b.x) AS d FROM v a JOIN v b ON a.w = b.w AND a.p < b.p GROUP BY 1, 2),
z AS (SELECT a.p AS p1, b.p AS p2 FROM p a JOIN p b ON a.p < b.p),
j AS (SELECT p1, p2, (SELECT len(list_intersect(x.xs, y.xs)) FROM ends x, ends y WHERE x.p = p1 AND y.p = p2) AS t,
  coalesce((SELECT sum(len(list_intersect(x.xs, y.xs)) / (len(list_distinct(list_concat(x.xs, y.xs))) + 1e-6)) / 2 FROM near x JOIN near y ON x.side = y.side WHERE x.p = p1 AND y.p = p2), 0) AS quad,
  coalesce((SELECT any_value(d) / nullif(any_value(x.n) * any_value(y.n), 0) FROM dot, m x, m y WHERE dot.p1 = z.p1 AND dot.p2 = z.p2 AND x.p = z.p1 AND y.p = z.p2), 0) AS def,
  coalesce((SELECT any_value(len(list_intersect(x.xs, y.xs)) / (len(list_distinct(list_concat(x.xs, y.xs))) + 1e-6)) FROM hyp x, hyp y WHERE x.p = p1 AND y.p = p2), 0) AS hyp FROM z),
r AS (SELECT p1, p2, (t > 0)::INT::DOUBLE AS transitivity, round(quad, 6) + 0.0 AS quadrilateral, round(def, 6) + 0.0 AS definition, round(hyp, 6) + 0.0 AS hypernym,
  round(0.4 * (t > 0)::INT + 0.3 * quad + 0.2 * def + 0.1 * hyp, 6) AS combined FROM j)
SELECT * FROM r WHERE combined > 0""",
)
def antonym_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four signals of pairs of antonym pairs and their weighted sum; pairs of pairs without any are left out."""
    return lexicon.antonym_signals(lexicon.literal_synsets(spark), lexicon.literal_edges(spark), _closure(spark))


# Seeds of the six seed axes (dimension, side, words).
SEED_AXES = [
    (0, "positive", "good virtue righteous moral ethical honest just"),
    (0, "negative", "bad evil wicked immoral unethical dishonest unjust"),
    (1, "positive", "hot warm heated boiling"),
    (1, "negative", "cold cool chilled freezing"),
    (2, "positive", "large big huge giant massive enormous"),
    (2, "negative", "small tiny minuscule miniature minute"),
    (4, "positive", "happy joy cheerful delighted pleased"),
    (4, "negative", "sad sorrow gloomy disappointed depressed"),
    (5, "positive", "light bright luminous radiant brilliant"),
    (5, "negative", "dark dim shadowy murky gloomy"),
    (6, "positive", "strong powerful mighty robust sturdy"),
    (6, "negative", "weak feeble frail fragile delicate"),
]
# Neutral seeds of each seed axis.
NEUTRAL_SEEDS = {
    0: "chair table rock water door window", 1: "chair table number", 2: "color idea truth", 4: "rock table number", 5: "chair number idea", 6: "color shape time",
}
_SEED_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({d}, '{s}', '{w}')" for d, s, ws in SEED_AXES for w in ws.split()) + ") t(dim, side, seed))"
_NEUTRAL_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({d}, '{w}')" for d, ws in NEUTRAL_SEEDS.items() for w in ws.split()) + ") t(dim, seed))"


def _seed_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, s, w) for d, s, ws in SEED_AXES for w in ws.split()], "dim int, side string, seed string")


def _neutral(spark: SparkSession) -> DataFrame:
    seeds = spark.createDataFrame([(d, w) for d, ws in NEUTRAL_SEEDS.items() for w in ws.split()], "dim int, seed string")
    e = lexicon.literal_edges(spark).where("kind = 'hypernym'").select(F.col("dst").alias("src"), F.lit("hyponym").alias("kind"), F.col("src").alias("dst"))
    return lexicon.expand(lexicon.literal_synsets(spark), e, seeds, "hyponym", "n", 2, 3).select("dim", "word").distinct()


def _expansion_sql(seeds: str, keys: str, edges: str, pos: str, first: int, near: int) -> str:
    """Words of expanded seeds as a subquery."""
    own = f"SELECT s.*, l.synset_id FROM {seeds} s JOIN (SELECT word, synset_id, row_number() OVER (PARTITION BY word ORDER BY synset_id) - 1 AS i FROM {SENSES} WHERE {pos}) l ON l.word = seed WHERE i < {first}"
    far = f"SELECT * EXCLUDE (k, synset_id, dst), dst AS synset_id FROM (SELECT o.*, dst, row_number() OVER (PARTITION BY {keys}, seed, o.synset_id ORDER BY dst) AS k FROM ({own}) o JOIN {edges} x ON x.src = o.synset_id) WHERE k <= {near}"
    return f"""(SELECT DISTINCT {keys}, word FROM (SELECT {keys}, seed AS word FROM {seeds} UNION ALL
      SELECT {keys}, lower(l) AS word FROM (SELECT {keys}, seed, synset_id FROM ({own}) UNION ALL SELECT {keys}, seed, synset_id FROM ({far})) o JOIN (SELECT synset_id, unnest(lemmas) AS l FROM {SYN}) USING (synset_id)) WHERE word NOT LIKE '% %')"""


_HYPO = f"(SELECT DISTINCT dst AS src, src AS dst FROM {EDG} WHERE kind = 'hypernym')"
_SIMILAR = f"(SELECT DISTINCT src, dst FROM {EDG} WHERE kind = 'similar')"
_NEUTRAL_WORDS = _expansion_sql(_NEUTRAL_SQL, "dim", _HYPO, "pos = 'n'", 2, 3)


@registry.query("neutral_words", f"SELECT dim, word FROM {_NEUTRAL_WORDS}")
def neutral_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without a place on an axis: neutral seeds, the lemmas of their first two noun senses and of three hyponyms of each."""
    return _neutral(spark)


_CLUSTERS = f"SELECT dim, side, word FROM {_expansion_sql(_SEED_SQL, 'dim, side', _SIMILAR, 'true', 3, 2)} UNION ALL SELECT dim, 'neutral', word FROM {_NEUTRAL_WORDS}"


def _clusters(spark: SparkSession) -> DataFrame:
    own = lexicon.expand(lexicon.literal_synsets(spark), lexicon.literal_edges(spark), _seed_rows(spark), "similar").select("dim", "side", "word").distinct()
    return own.unionByName(_neutral(spark).select("dim", F.lit("neutral").alias("side"), "word"))


@registry.query("seed_clusters", f"SELECT dim, side, list_sort(list(word)) AS words FROM ({_CLUSTERS}) GROUP BY dim, side")
def seed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive, negative and neutral words of the six seed axes."""
    return _clusters(spark).groupBy("dim", "side").agg(F.array_sort(F.collect_list("word")).alias("words"))


@registry.query(
    "vocabulary_clusters",
    f"""WITH c AS ({_CLUSTERS}), v AS (SELECT DISTINCT {term_sql('word')} AS word FROM graph_node)
SELECT dim, side, count(*) AS words, count(v.word) AS known FROM c LEFT JOIN v ON v.word = c.word GROUP BY 1, 2""",
)
def vocabulary_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each cluster the graph's vocabulary has: clusters matched to a vocabulary."""
    v = table(spark, sf_dir, "graph_node").select(term("word").alias("w")).where("w IS NOT NULL").distinct()
    c = _clusters(spark)
    return c.join(v, c["word"] == v["w"], "left").groupBy("dim", "side").agg(F.count(F.lit(1)).alias("words"), F.count("w").alias("known"))


@registry.query(
    "axis_quality",
    f"""WITH RECURSIVE {_UP}, {_PATHS}, c AS (SELECT * FROM ({_CLUSTERS}) WHERE side <> 'neutral'),
j AS (SELECT a.dim, a.side = b.side AS inside, path FROM path JOIN c a ON a.word = w1 JOIN c b ON b.word = w2 AND a.dim = b.dim), d AS (SELECT DISTINCT dim FROM c)
SELECT d.dim, round(coalesce(avg(path) FILTER (inside), 0.0), 6) AS coherence, round(coalesce(1 - avg(path) FILTER (NOT inside), 0.5), 6) AS separation, count(path) AS pairs FROM d LEFT JOIN j USING (dim) GROUP BY d.dim""",
)
def axis_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence (mean path similarity within the poles of an axis) and separation (1 − that between them); 0 and 0.5 without any path."""
    c = _clusters(spark).where("side <> 'neutral'")
    paths = lexicon.word_paths(lexicon.literal_synsets(spark), _closure(spark))
    a, b = c.toDF("dim", "side", "w1"), c.toDF("dim", "other", "w2")
    j = paths.join(a, "w1").join(b, ["dim", "w2"]).select("dim", (F.col("side") == F.col("other")).alias("inside"), "path")
    every = c.select("dim").distinct().join(j, "dim", "left")
    return every.groupBy("dim").agg(
        r6(F.coalesce(F.avg(F.when(F.col("inside"), F.col("path"))), F.lit(0.0)), "coherence"),
        r6(F.coalesce(1 - F.avg(F.when(~F.col("inside"), F.col("path"))), F.lit(0.5)), "separation"),
        F.count("path").alias("pairs"),
    )


@registry.query(
    "adjective_axes",
    f"""WITH RECURSIVE {_UP}, {_PATHS}, m AS {_MEMBERS}, c AS (SELECT axis, w FROM m), s AS (SELECT axis, count(*) AS size, min(w) AS name FROM c GROUP BY axis),
j AS (SELECT a.axis, avg(path) AS x FROM path JOIN c a ON a.w = w1 JOIN c b ON b.w = w2 AND a.axis = b.axis GROUP BY 1)
SELECT s.axis, name, size, 1 AS poles, round(coalesce(x, 0.5), 6) AS coherence, 0.0::DOUBLE AS separation FROM s LEFT JOIN j USING (axis) WHERE coalesce(x, 0.5) >= 0.3""",
)
def adjective_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word clusters as axes of one pole, if coherent: mean path similarity of at least 0.3, or 0.5 where no two words have a path."""
    m = edges_of(spark, sf_dir).where("relation LIKE 'has-%'").select(F.col("relation").alias("axis"), F.col("target").alias("w")).distinct()
    m = materialise(m, "cluster-words")
    size = m.groupBy("axis").agg(F.count(F.lit(1)).alias("size"), F.min("w").alias("name"))
    paths = lexicon.word_paths(lexicon.literal_synsets(spark), _closure(spark))
    x = paths.join(m.toDF("axis", "w1"), "w1").join(m.toDF("axis", "w2"), ["axis", "w2"]).groupBy("axis").agg(F.avg("path").alias("x"))
    j = size.join(x, "axis", "left").withColumn("x", F.coalesce("x", F.lit(0.5))).where("x >= 0.3")
    return j.select("axis", "name", "size", F.lit(1).alias("poles"), r6(F.col("x"), "coherence"), F.lit(0.0).alias("separation"))


_OVERLAP = 0.5


@registry.query("overlap_merge")
def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes merged where their words overlap by half: (axis, merged, words).

    Overlaps are counted by Spark from each word's list of axes; the greedy pass is over axis names, of which there are
    as many as relations, in order of size.
    """
    m = materialise(edges_of(spark, sf_dir).where("relation LIKE 'has-%'").select(F.col("relation").alias("axis"), F.col("target").alias("w")).distinct(), "axis-words")
    size = m.groupBy("axis").agg(F.count(F.lit(1)).alias("n"))
    order = [(r.axis, r.n) for r in size.orderBy(F.desc("n"), "axis").collect()]  # one row for each relation
    lists = m.groupBy("w").agg(F.array_sort(F.collect_list("axis")).alias("l")).select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a <> b")
    shared = {(r.a, r.b): r.n for r in lists.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}  # pairs of relations
    n, used, groups = dict(order), set(), []
    for name, _ in order:
        if name in used:
            continue
        # all that stand before are used, so what is left comes later in the order
        mates = [o for o, _ in order if o not in used and o != name and shared.get((name, o), 0) / min(n[name], n[o]) >= _OVERLAP]
        used |= {name, *mates}
        groups += [(name, x) for x in (name, *mates)]
    g = spark.createDataFrame(groups, "merged string, axis string")
    return m.join(F.broadcast(g), "axis").groupBy(F.col("merged").alias("axis")).agg(F.countDistinct("w").alias("words"), F.array_sort(F.collect_set("axis")).alias("merged"))


@registry.query(
    "sense_features",
    f"""WITH RECURSIVE {_UP}, {_L}, h AS (SELECT d, bool_or(regexp_matches(a, 'person|animal|organism')) AS animate, bool_or(regexp_matches(a, 'organism|living_thing')) AS living,
  bool_or(regexp_matches(a, 'abstraction|psychological_feature')) AS abstract FROM up GROUP BY d)
SELECT tag, CASE WHEN coalesce(animate, regexp_matches(l.synset_id, 'person|animal|organism')) THEN 'animate' ELSE 'inanimate' END AS animacy,
  CASE WHEN coalesce(living, regexp_matches(l.synset_id, 'person|animal|organism')) THEN 'living' ELSE 'nonliving' END AS living,
  CASE WHEN coalesce(abstract, false) THEN 'abstract' ELSE 'physical' END AS embodiment, CASE WHEN regexp_matches(lower(definition), 'amount|mass|substance') THEN 'uncountable' ELSE 'countable' END AS countability,
  CASE WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN 'plural' ELSE 'singular' END AS number
FROM l JOIN {SYN} s ON s.synset_id = l.synset_id AND s.pos = 'n' LEFT JOIN h ON h.d = l.synset_id""",
)
def sense_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of noun senses that follow from hypernyms, definition and form."""
    s = lexicon.literal_synsets(spark)
    f = lexicon.noun_features(s, _closure(spark))
    plural = F.col("word").endswith("s") & ~F.col("word").endswith("ss")
    j = lexicon.senses(s).select("word", "synset_id", F.col("sense_tag").alias("tag")).join(f, "synset_id")
    return j.select("tag", "animacy", "living", "embodiment", "countability", F.when(plural, F.lit("plural")).otherwise(F.lit("singular")).alias("number"))


@registry.query(
    "verb_transitivity",
    f"""WITH {_L} SELECT tag, CASE WHEN regexp_matches(lower(definition), 'something|someone') THEN 'transitive' ELSE 'none' END AS transitivity FROM l JOIN {SYN} s ON s.synset_id = l.synset_id AND s.pos = 'v'""",
)
def verb_transitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitivity of verb senses by what their definition says, where frames are not known."""
    s = lexicon.literal_synsets(spark).where("pos = 'v'")
    j = lexicon.senses(lexicon.literal_synsets(spark)).select("synset_id", F.col("sense_tag").alias("tag")).join(s.select("synset_id", "definition"), "synset_id")
    return j.select("tag", F.when(F.lower("definition").rlike("something|someone"), F.lit("transitive")).otherwise(F.lit("none")).alias("transitivity"))


@registry.query(
    "cosine_polarity_loss",
    f"""WITH c AS (SELECT kind, list_cosine_similarity(a, b) AS c FROM {PAIRS})
SELECT kind, round(avg(CASE kind WHEN 'antonym' THEN greatest(0, c + 0.5) ELSE greatest(0, 0.5 - c) END), 6) + 0.0 AS loss, count(*) AS pairs FROM c GROUP BY kind""",
)
def cosine_polarity_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antonyms cost as far as their cosine is above −0.5, synonyms as far as it is below 0.5."""
    c = vec.cosine(F.col("a"), F.col("b"))
    loss = F.when(F.col("kind") == "antonym", F.greatest(F.lit(0.0), c + 0.5)).otherwise(F.greatest(F.lit(0.0), 0.5 - c))
    return vector_pairs(spark, sf_dir).groupBy("kind").agg((F.round(F.avg(loss), 6) + F.lit(0.0)).alias("loss"), F.count(F.lit(1)).alias("pairs"))

"""Queries over the lexicon: senses, relations, disambiguation, and the four pair signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..core.session import materialise, task_count
from ..core.sizing import bounded_join
from ..core.terms import term, term_sql
from ..functions import text as fx
from ..operators import lexicon, nearest
from . import Registry, table

registry = Registry()


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs) + "]::VARCHAR[]"


SYN = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{i}', '{p}', {_sql_list(ls.split())}, '{d}', {_sql_list([e] if e else [])})" for i, p, ls, d, e in lexicon.SYNSETS
) + ") t(synset_id, pos, lemmas, definition, examples))"
EDG = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{k}', '{b}')" for a, k, b in lexicon.EDGES) + ") t(src, kind, dst))"
SENSES = f"""(SELECT word, row_number() OVER (PARTITION BY word ORDER BY synset_id) - 1 AS sense_idx, synset_id, pos
FROM (SELECT synset_id, pos, unnest(lemmas) AS word FROM {SYN}))"""
TAG = "word || '_wn.' || lpad(sense_idx::VARCHAR, 2, '0') || '_' || pos"


@registry.query("word_senses", f"SELECT word, sense_idx, synset_id, {TAG} AS sense_tag FROM {SENSES}")
def word_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.senses(lexicon.literal_synsets(spark)).select("word", "sense_idx", "synset_id", "sense_tag")


_RELATIONS = f"""l AS (SELECT synset_id, unnest(lemmas) AS word FROM {SYN}), e AS (SELECT * FROM {EDG}),
t AS (SELECT src, kind, dst FROM e WHERE kind IN ('antonym', 'hypernym') UNION ALL SELECT dst, 'hyponym', src FROM e WHERE kind = 'hypernym'),
r AS (SELECT a.word, 'synonym' AS relation, b.word AS other FROM l a JOIN l b USING (synset_id) WHERE a.word <> b.word
      UNION SELECT a.word, kind, b.word FROM l a JOIN t ON a.synset_id = src JOIN l b ON b.synset_id = dst WHERE a.word <> b.word)"""


@registry.query("lexicon_relations", f"WITH {_RELATIONS} SELECT word, relation, other FROM r")
def lexicon_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.word_relations(lexicon.literal_synsets(spark), lexicon.literal_edges(spark))


@registry.query(
    "lexicon_import",
    f"""WITH {_RELATIONS}, k AS (SELECT r.*, row_number() OVER (PARTITION BY word, relation ORDER BY other) AS k FROM r
  WHERE word IN (SELECT {term_sql('word')} FROM graph_node))
SELECT word AS source, 'related-to' AS relation, other AS target, (CASE relation WHEN 'synonym' THEN 0.95 WHEN 'antonym' THEN 0.05 ELSE 0.8 END)::DOUBLE AS confidence, relation AS source_type
FROM k WHERE k <= 10""",
)
def lexicon_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon relations of the graph's words as edges."""
    words = table(spark, sf_dir, "graph_node").select(term("word").alias("word")).where("word IS NOT NULL")
    return lexicon.import_relations(lexicon.literal_synsets(spark), lexicon.literal_edges(spark), words)


@registry.query("antonym_pairs", f"SELECT DISTINCT least(src, dst) AS synset1, greatest(src, dst) AS synset2 FROM {EDG} WHERE kind = 'antonym'")
def antonym_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lexicon.literal_edges(spark).where("kind = 'antonym'")
    return e.select(F.least("src", "dst").alias("synset1"), F.greatest("src", "dst").alias("synset2")).distinct()


@registry.query("vocabulary_by_pos", f"SELECT pos, count(DISTINCT word) AS words, list_sort(list(DISTINCT {TAG})) AS tags FROM {SENSES} GROUP BY pos")
def vocabulary_by_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lexicon.senses(lexicon.literal_synsets(spark))
    return s.groupBy("pos").agg(F.countDistinct("word").alias("words"), F.array_sort(F.collect_set("sense_tag")).alias("tags"))


_PROFILE = f"""t AS (SELECT synset_id, lemmas, list_distinct({fx.content_words_sql('definition')}) AS gloss, list_distinct({fx.content_words_sql("array_to_string(examples, ' ')")}) AS example FROM {SYN}),
u AS (SELECT src, list_distinct(flatten(list(list_concat(lemmas, gloss)))) AS upper FROM {EDG} JOIN t ON dst = synset_id WHERE kind = 'hypernym' GROUP BY src),
p AS (SELECT word, sense_idx, {TAG} AS sense_tag, gloss, example, coalesce(upper, []::VARCHAR[]) AS upper FROM {SENSES} s JOIN t USING (synset_id) LEFT JOIN u ON s.synset_id = src),
c AS (SELECT context_id, {term_sql('word')} AS word, list_distinct(list_filter(list_transform(neighbors, lambda x: {term_sql('x')}), lambda x: x IS NOT NULL)) AS near
      FROM (SELECT DISTINCT context_id, word, neighbors FROM word_context) WHERE neighbors IS NOT NULL),
w AS (SELECT context_id, word, sense_idx, sense_tag, round(greatest(0.01, least(1.0, coalesce((0.4 * len(list_intersect(near, gloss)) + 0.3 * len(list_intersect(near, upper)) + 0.2 * len(list_intersect(near, example)))
      / nullif(0.9 * len(near), 0), 0.01)))::DOUBLE, 6) AS score FROM c JOIN p USING (word))"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "word_context").select("context_id", "word", "neighbors").where("neighbors IS NOT NULL").distinct()
    near = F.filter(F.transform("neighbors", term), lambda x: x.isNotNull())
    profiles = lexicon.sense_profiles(lexicon.literal_synsets(spark), lexicon.literal_edges(spark))
    return lexicon.wsd_scores(c, "context_id", term("word"), near, profiles)


@registry.query("wsd_scores", f"WITH {_PROFILE} SELECT context_id, word, sense_idx, sense_tag, score FROM w")
def wsd_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@registry.query(
    "wsd_best",
    f"""WITH {_PROFILE} SELECT context_id, word, sense_idx, sense_tag, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE score END AS score
FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, sense_idx) AS k, count(*) OVER (PARTITION BY context_id) AS n FROM w) WHERE k = 1""",
)
def wsd_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.wsd_best(_scores(spark, sf_dir), "context_id")


# Documents of the signals: the sentences of parse_record, compared within a batch's first sentences' shared words.
_DOCS = f"(SELECT DISTINCT sentence_id, list_distinct({fx.content_words_sql('sentence')}) AS ws, {fx.content_words_sql('sentence')} AS bag FROM parse_record WHERE sentence IS NOT NULL)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "parse_record").select("sentence_id", "sentence").where("sentence IS NOT NULL").distinct()
    bag = fx.content_words(F.col("sentence"))
    return r.select("sentence_id", F.array_distinct(bag).alias("ws"), bag.alias("bag")).distinct()


@registry.query(
    "idf",
    f"WITH d AS {_DOCS} SELECT w, round(ln((SELECT count(*) FROM d)::DOUBLE / (1 + count(*))), 6) + 0.0 AS idf FROM (SELECT unnest(ws) AS w FROM d) GROUP BY w",
)
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln(N / (1 + document frequency)) of every term."""
    d = docs(spark, sf_dir)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    df = d.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("w", (F.round(F.log(F.col("n") / (1 + F.col("df"))), 6) + F.lit(0.0)).alias("idf"))


_TFIDF = f"""d AS {_DOCS}, i AS (SELECT w, ln((SELECT count(*) FROM d)::DOUBLE / (1 + count(*))) AS idf FROM (SELECT unnest(ws) AS w FROM d) GROUP BY w),
v AS (SELECT sentence_id, w, count(*)::DOUBLE / any_value(n) * any_value(idf) AS x FROM (SELECT sentence_id, unnest(bag) AS w, len(bag) AS n FROM d) JOIN i USING (w) GROUP BY 1, 2),
m AS (SELECT sentence_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1)"""
#: Sentences that come out for one that is asked for.
NEAREST = 10


#: Cosine of the sum of products and the norms; by Cauchy and Schwarz, shared words of weights x add at most |x| of one's own norm.
COSINE = nearest.Score(
    lambda dot, n1, n2: dot / (n1 * n2), lambda x, n1: (x / n1) ** 2, lambda part: np.sqrt(part), lambda x, part, n1, n2: np.sqrt(part) * n1 * n2
)


@registry.query(
    "tfidf_cosine",
    f"""WITH {_TFIDF}, c AS (SELECT a.sentence_id AS s1, b.sentence_id AS s2, round(sum(a.x * b.x) / (any_value(n1.norm) * any_value(n2.norm)), 6) AS cosine
  FROM v a JOIN v b ON a.w = b.w AND a.sentence_id <> b.sentence_id JOIN m n1 ON n1.sentence_id = a.sentence_id JOIN m n2 ON n2.sentence_id = b.sentence_id
  WHERE a.sentence_id % 100 = 0 AND n1.norm > 0 AND n2.norm > 0 GROUP BY 1, 2)
SELECT s1, s2, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY cosine DESC, s2) AS rank FROM c) WHERE rank <= {NEAREST}""",
)
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sentences nearest by TF-IDF cosine to each sentence whose id is divisible by 100, among all that share a word with it.

    Each task keeps the ten best for each asked sentence; pairs are never written.
    """
    d = materialise(docs(spark, sf_dir), "tfidf-docs")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    df = d.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    i = df.join(F.broadcast(n)).select("w", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"))
    tf = d.select("sentence_id", F.size("bag").alias("k"), F.explode("ws").alias("w"), "bag").select("sentence_id", "k", "w", F.size(F.filter("bag", lambda x: x == F.col("w"))).alias("c"))
    # one shuffle by sentence serves all three aggregations
    v = bounded_join(tf, i, "w", spread=["sentence_id"]).repartition(task_count(spark), "sentence_id")
    v = v.groupBy("sentence_id", "w", "k", "idf").agg(F.sum("c").alias("c")).select("sentence_id", "w", (F.col("c") / F.col("k") * F.col("idf")).alias("x"))
    v = v.groupBy("sentence_id", "w").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    v = v.groupBy(F.col("sentence_id").alias("id")).agg(F.collect_list(F.struct("w", "x")).alias("l"), F.sqrt(F.sum("xx")).alias("aux")).where("aux > 0")
    v = materialise(v.where("id IS NOT NULL").select("id", F.col("l.w").alias("items"), F.col("l.x").alias("weights"), "aux"), "tfidf")
    met = nearest.candidates(v, "id % 100 = 0", NEAREST, COSINE)
    c = met.select(F.col("asked").alias("s1"), F.col("id").alias("s2"), F.round(F.col("sum") / (F.col("asked_aux") * F.col("aux")), 6).alias("cosine"))
    w = Window.partitionBy("s1").orderBy(F.desc("cosine"), "s2")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEAREST)


_NEAR = f"""(SELECT context_id, {term_sql('word')} AS word, list_distinct(list_filter(list_transform(neighbors, lambda x: {term_sql('x')}), lambda x: x IS NOT NULL)) AS near
FROM (SELECT DISTINCT context_id, word, neighbors FROM word_context) WHERE neighbors IS NOT NULL AND {term_sql('word')} IS NOT NULL)"""


#: Weight of the word among the items of a context, so that one sum holds both counts; more than the neighbours of any context.
SAME = 1 << 20


def _overlap(total: np.ndarray, n1: float, n2: np.ndarray) -> np.ndarray:
    same = np.floor(total / SAME**2)
    i = np.minimum(total - same * SAME**2, np.minimum(n1, n2))
    return 0.4 + 0.3 * (i / (n1 + n2 - i + 1e-6)) + 0.1 * np.minimum(same, 1)


OVERLAP = nearest.Score(
    _overlap, lambda w, n1: np.where(w == SAME, 0.1, 0.3 / max(n1, 1.0)), lambda part: 0.4 + part, lambda w, part, n1, n2: (w * w).sum()
)


@registry.query(
    "pair_signals",
    f"""WITH c AS {_NEAR}, p AS (SELECT a.context_id AS c1, b.context_id AS c2, len(list_intersect(a.near, b.near)) AS i, len(a.near) + len(b.near) AS n, a.word = b.word AS same
  FROM c a JOIN c b ON a.context_id <> b.context_id WHERE a.context_id % 100 = 0 AND (a.word = b.word OR len(list_intersect(a.near, b.near)) > 0)),
s AS (SELECT c1, c2, 1 AS transitivity, round(i / (n - i + 1e-6), 6) AS jaccard, round(0.4 + 0.3 * (i / (n - i + 1e-6)) + 0.1 * same::INT, 6) AS combined FROM p)
SELECT c1, c2, transitivity, jaccard, combined, rank FROM (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY combined DESC, c2) AS rank FROM s) WHERE rank <= {NEAREST}""",
)
def pair_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten contexts nearest to each one whose id is divisible by 100: a shared word or neighbour (0.4), the Jaccard overlap
    of the neighbours (0.3), the same word (0.1). The four signals of antonym pairs are in ``antonym_signals``.

    Each task keeps the ten best for each asked context; pairs are never written.
    """
    c = table(spark, sf_dir, "word_context").select("context_id", "word", "neighbors").where("neighbors IS NOT NULL").distinct()
    near = F.array_distinct(F.filter(F.transform("neighbors", term), lambda x: x.isNotNull()))
    c = c.select(F.col("context_id").alias("id"), term("word").alias("word"), near.alias("near")).where("word IS NOT NULL AND id IS NOT NULL")
    items = F.concat(F.array(F.concat(F.lit("w "), "word")), F.transform("near", lambda t: F.concat(F.lit("n "), t)))
    weights = F.concat(F.array(F.lit(float(SAME))), F.transform("near", lambda t: F.lit(1.0)))
    c = materialise(c.select("id", items.alias("items"), weights.alias("weights"), F.size("near").cast("double").alias("aux")), "contexts")
    met = nearest.candidates(c, "id % 100 = 0", NEAREST, OVERLAP)
    # the word's weight stands on both sides
    same = F.floor(F.col("sum") / SAME**2)
    i, n = F.col("sum") - same * SAME**2, F.col("asked_aux") + F.col("aux")
    jaccard = i / (n - i + 1e-6)
    s = met.select(F.col("asked").alias("c1"), F.col("id").alias("c2"), F.lit(1).alias("transitivity"), F.round(jaccard, 6).alias("jaccard"), F.round(0.4 + 0.3 * jaccard + 0.1 * same, 6).alias("combined"))
    w = Window.partitionBy("c1").orderBy(F.desc("combined"), "c2")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEAREST)

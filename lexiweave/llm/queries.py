"""Queries of the operators in this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.sizing import spread, unique_rows
from ..core.terms import term, term_sql
from ..plans import Registry, table
from . import contamination, cooccur, knn, mojibake, termfreq, tokenize, topn

registry = Registry()
DIMS = 64
NEIGHBOURS = 5

_USABLE = """
SELECT DISTINCT word_id, embeddings FROM word_vector
WHERE embeddings IS NOT NULL AND len(embeddings) = 64
  AND len(list_filter(embeddings, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0"""


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.similar_vectors(table(spark, sf_dir, "word_vector"), "word_id", "embeddings", DIMS, NEIGHBOURS)


@registry.query(
    "p1_found",
    f"""
WITH u AS ({_USABLE}), s AS (
  SELECT a.word_id AS x, b.word_id AS y, round(list_cosine_similarity(a.embeddings::DOUBLE[], b.embeddings::DOUBLE[]), 9) AS c
  FROM u a JOIN u b ON a.word_id <> b.word_id),
r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS k FROM s)
SELECT DISTINCT least(x, y) AS word_id_a, greatest(x, y) AS word_id_b FROM r WHERE k <= 5
""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _similar(spark, sf_dir)
    return pairs.select(F.least("id", "neighbour").alias("word_id_a"), F.greatest("id", "neighbour").alias("word_id_b")).distinct()


@registry.query("p1_recall")
def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashing chosen for these vectors, with its recall against brute force over all rows for a bounded sample."""
    return knn.measured(table(spark, sf_dir, "word_vector"), "word_id", "embeddings", DIMS, NEIGHBOURS)


_ITEMS = f"""
SELECT DISTINCT context_id, x AS item FROM (
  SELECT context_id, unnest(list_transform(list_append(coalesce(neighbors, []::VARCHAR[]), word), lambda y: {term_sql('y')})) AS x
  FROM word_context) WHERE x IS NOT NULL"""
_PAIRS = f"""
WITH i AS ({_ITEMS}), n AS (SELECT count(DISTINCT context_id) AS n FROM i), m AS (SELECT item, count(*) AS c FROM i GROUP BY item),
p AS (SELECT a.item AS word_a, b.item AS word_b, count(*) AS together
      FROM i a JOIN i b ON a.context_id = b.context_id AND a.item < b.item GROUP BY 1, 2)"""


def _words() -> F.Column:
    return F.transform(F.concat(F.array("word"), F.coalesce("neighbors", F.array().cast("array<string>"))), term)


@registry.query(
    "p3_found",
    _PAIRS
    + """
SELECT word_a, word_b FROM p, n, m ma, m mb WHERE ma.item = word_a AND mb.item = word_b
  AND together >= 15 AND together * n >= 10 * ma.c * mb.c
""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccur.cooccurrence(table(spark, sf_dir, "word_context"), "context_id", _words(), 15, 10.0)
    return pairs.select(F.col("item_a").alias("word_a"), F.col("item_b").alias("word_b"))


@registry.query(
    "p3_associations",
    _PAIRS
    + """
SELECT word_a, word_b, together, ma.c AS count_a, mb.c AS count_b,
       round(together * n / (ma.c::DOUBLE * mb.c), 6) AS lift, round(ln(together * n / (ma.c::DOUBLE * mb.c)), 6) AS pmi
FROM p, n, m ma, m mb WHERE ma.item = word_a AND mb.item = word_b AND together >= 5
""",
)
def p3_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that are together in at least five records, however common their words."""
    pairs = cooccur.cooccurrence(table(spark, sf_dir, "word_context"), "context_id", _words(), 5)
    return pairs.select(
        F.col("item_a").alias("word_a"), F.col("item_b").alias("word_b"), "together", "count_a", "count_b",
        F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"),
    )


RARE_BELOW, COMMON_SHARE = 3, (1, 5)
_TERMS = f"""
WITH t AS (SELECT DISTINCT triple_id, sentence_id, {term_sql('subject')} AS s, {term_sql('object')} AS o FROM semantic_triple),
r AS (SELECT triple_id, sentence_id, s AS term FROM t WHERE s IS NOT NULL UNION ALL SELECT triple_id, sentence_id, o FROM t WHERE o IS NOT NULL),
f AS (SELECT term, count(*) AS occurrences, count(DISTINCT sentence_id) AS sentences FROM r GROUP BY term),
n AS (SELECT count(DISTINCT sentence_id) AS n FROM r)"""


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "semantic_triple")
    return termfreq.term_frequencies(t, "triple_id", "sentence_id", [term("subject"), term("object")])


def _sentences_with_terms(spark: SparkSession, sf_dir: str) -> int:
    t = table(spark, sf_dir, "semantic_triple").where(F.coalesce(term("subject"), term("object")).isNotNull())
    return t.select("sentence_id").where("sentence_id IS NOT NULL").distinct().count()


@registry.query(
    "p4_found",
    _TERMS
    + """
SELECT term, CASE WHEN sentences < 3 THEN 'rare' ELSE 'common' END AS mark FROM f, n WHERE sentences < 3 OR sentences * 5 >= n
""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = termfreq.mark_terms(_frequencies(spark, sf_dir), _sentences_with_terms(spark, sf_dir), RARE_BELOW, COMMON_SHARE)
    return marked.where(F.col("mark").isNotNull()).select("term", "mark")


@registry.query(
    "p4_frequencies",
    _TERMS
    + f""", g AS (SELECT {term_sql('word')} AS term, max(frequency) AS frequency FROM graph_node GROUP BY 1)
SELECT f.term, occurrences, sentences, g.frequency AS node_frequency FROM f LEFT JOIN g ON f.term = g.term
""",
)
def p4_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term's counts beside the frequency its graph node claims."""
    nodes = table(spark, sf_dir, "graph_node").groupBy(term("word").alias("term")).agg(F.max("frequency").alias("node_frequency"))
    return _frequencies(spark, sf_dir).withColumnRenamed("records", "sentences").join(nodes, "term", "left")


_TOP = """
WITH d AS (SELECT DISTINCT report_id, dim_index, word, activation FROM dim_activation WHERE activation IS NOT NULL AND isfinite(activation)),
s AS (SELECT *, 'top' AS side, -activation AS o FROM d UNION ALL SELECT *, 'bottom', activation FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY report_id, dim_index, side ORDER BY o, word) AS k FROM s)"""


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, sf_dir, "dim_activation"), ["report_id", "dim_index"], "activation", ["word"], 5)


@registry.query("p5_found", _TOP + " SELECT report_id, dim_index, side, word FROM r WHERE k <= 5")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("report_id", "dim_index", "side", "word")


@registry.query(
    "p5_activation_lists",
    _TOP
    + """
SELECT report_id, dim_index, list(word ORDER BY k) FILTER (side = 'top') AS top_words, list(activation ORDER BY k) FILTER (side = 'top') AS top_values,
       list(word ORDER BY k) FILTER (side = 'bottom') AS bottom_words, list(activation ORDER BY k) FILTER (side = 'bottom') AS bottom_values
FROM r WHERE k <= 5 GROUP BY report_id, dim_index
""",
)
def p5_activation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists that belong in the dimensions' ``top_activations`` and ``bottom_activations``."""

    def ordered(side: str) -> F.Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "word", "activation"))))

    lists = _top(spark, sf_dir).groupBy("report_id", "dim_index").agg(ordered("top").alias("t"), ordered("bottom").alias("b"))
    return lists.select(
        "report_id", "dim_index", F.col("t.word").alias("top_words"), F.col("t.activation").alias("top_values"),
        F.col("b.word").alias("bottom_words"), F.col("b.activation").alias("bottom_values"),
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@registry.query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = unique_rows(_texts(spark, sf_dir), ["doc_id"])
    return tokenize.encode(docs, "doc_id", "text")


@registry.query("p6_round_trip", "SELECT DISTINCT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, true AS exact FROM documents")
def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether decoding gives each text back; ``bytes`` is where the last token ends."""
    docs = unique_rows(_texts(spark, sf_dir), ["doc_id"])
    ids = tokenize.encode(docs, "doc_id", "text", offsets=True)
    back = tokenize.decode(ids, "doc_id").withColumnRenamed("text", "decoded")
    both = docs.join(back, "doc_id")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return both.select("doc_id", F.octet_length("decoded").cast("long").alias("bytes"), same.alias("exact"))


@registry.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.leaks(_texts(spark, sf_dir), table(spark, sf_dir, "eval_item"))
    return found.select("doc_id", "item_id")


@registry.query("p7_clean_documents")
def p7_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the leaked passages cut out."""
    docs = unique_rows(_texts(spark, sf_dir), ["doc_id"])
    return contamination.remove_leaks(docs, table(spark, sf_dir, "eval_item"))


@registry.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(_texts(spark, sf_dir)).select("doc_id")


@registry.query("p8_restored")
def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their texts as far as they can be restored."""
    return mojibake.find_garbled(_texts(spark, sf_dir))

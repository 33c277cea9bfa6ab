"""Queries over the word graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.session import materialise
from ..core.sizing import bounded_join, spread
from ..core.terms import relation_name, relation_name_sql, term, term_sql
from ..functions import text as fx
from ..operators import graph
from . import Registry, table
from .text import sentence_rows, SENTENCES

registry = Registry()
WORD = "word"
#: A word that is an object of many triples.
TARGET = "phrase"


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "semantic_triple").select("triple_id", "subject", "relation", "object", "confidence", "source_type")
    t = spread(t).select(
        "triple_id", term("subject").alias("subject"), relation_name("relation").alias("relation"), term("object").alias("object"),
        "confidence", "source_type",
    )
    t = t.where("subject IS NOT NULL AND relation IS NOT NULL AND object IS NOT NULL").distinct()
    return graph.build_edges(t)


EDGES = f"""
SELECT subject AS source, relation, object AS target, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 1.0 ELSE confidence END AS confidence,
       coalesce(source_type, 'parse') AS source_type
FROM (SELECT DISTINCT triple_id, {term_sql('subject')} AS subject, {relation_name_sql('relation')} AS relation, {term_sql('object')} AS object,
             confidence, source_type FROM semantic_triple)
WHERE subject IS NOT NULL AND relation IS NOT NULL AND object IS NOT NULL"""
ENDS = "SELECT source AS word FROM e UNION ALL SELECT target FROM e"


@registry.query(
    "kg_stats",
    f"""WITH e AS ({EDGES}) SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT relation) FROM e) AS relations,
  (SELECT count(DISTINCT word) FROM ({ENDS})) AS nodes, 2.0::DOUBLE * (SELECT count(*) FROM e) / (SELECT count(DISTINCT word) FROM ({ENDS})) AS average_degree""",
)
def kg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.statistics(edges_of(spark, sf_dir))


@registry.query("kg_relations", f"SELECT relation, source_type, count(*) AS n, round(sum(confidence), 6) / count(*) AS confidence FROM ({EDGES}) GROUP BY ALL")
def kg_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges_of(spark, sf_dir)
    return e.groupBy("relation", "source_type").agg(F.count(F.lit(1)).alias("n"), graph.mean("confidence").alias("confidence"))


@registry.query("kg_out", f"SELECT * FROM ({EDGES}) WHERE source = '{WORD}' AND relation = 'is-agent-of'")
def kg_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.outgoing(edges_of(spark, sf_dir), WORD, "is-agent-of")


@registry.query("kg_in", f"SELECT * FROM ({EDGES}) WHERE target = '{TARGET}'")
def kg_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incoming(edges_of(spark, sf_dir), TARGET)


@registry.query(
    "kg_neighbors",
    f"WITH e AS ({EDGES}) SELECT target AS neighbour FROM e WHERE source = '{WORD}' UNION SELECT source FROM e WHERE target = '{WORD}'",
)
def kg_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(edges_of(spark, sf_dir), WORD)


@registry.query("kg_related", f"SELECT DISTINCT relation, target FROM ({EDGES}) WHERE source = '{WORD}'")
def kg_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(edges_of(spark, sf_dir), WORD)


@registry.query("kg_node", f"SELECT DISTINCT node_id, word, lower(language) AS language, frequency FROM graph_node WHERE word = '{WORD}' AND lower(language) = 'en'")
def kg_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "graph_node").where((F.col("word") == WORD) & (F.lower("language") == "en"))
    return n.select("node_id", "word", F.lower("language").alias("language"), "frequency").distinct()


@registry.query("node_frequency", f"WITH e AS ({EDGES}) SELECT word, count(*) AS frequency FROM ({ENDS}) GROUP BY word")
def node_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_nodes(edges_of(spark, sf_dir))


@registry.query("edge_aggregate", f"SELECT source, relation, target, round(sum(confidence), 6) / count(*) AS confidence, count(*) AS n FROM ({EDGES}) GROUP BY 1, 2, 3")
def edge_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.aggregate_edges(edges_of(spark, sf_dir))


@registry.query(
    "freq_filter_edges",
    f"""WITH e AS ({EDGES}), k AS (SELECT word FROM ({ENDS}) GROUP BY word HAVING count(*) >= 5)
SELECT source, relation, target, count(*) AS n FROM e WHERE source IN (FROM k) AND target IN (FROM k) GROUP BY 1, 2, 3""",
)
def freq_filter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.frequent_ends(materialise(edges_of(spark, sf_dir), "frequent-edges"), 5)
    return e.groupBy("source", "relation", "target").agg(F.count(F.lit(1)).alias("n"))


VOCAB = f"WITH e AS ({EDGES}), v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM ({ENDS})))"


def _vocab(e: DataFrame) -> DataFrame:
    return graph.vocabulary(e.select(F.explode(F.array("source", "target")).alias("word")))


@registry.query("vocab_ids", f"{VOCAB} SELECT word, word_id FROM v")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(edges_of(spark, sf_dir))


@registry.query(
    "encode_edges",
    f"{VOCAB} SELECT s.word_id AS source_id, relation, t.word_id AS target_id, confidence FROM e JOIN v s ON source = s.word JOIN v t ON target = t.word",
)
def encode_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = materialise(edges_of(spark, sf_dir), "encode-edges")  # read for the vocabulary and for both ends
    return graph.encode(e, _vocab(e)).select("source_id", "relation", "target_id", "confidence")


@registry.query(
    "triples_by_pair",
    f"SELECT source, target, list_sort(list(DISTINCT relation)) AS relations FROM ({EDGES}) GROUP BY 1, 2",
)
def triples_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark, sf_dir).groupBy("source", "target").agg(F.array_sort(F.collect_set("relation")).alias("relations"))


@registry.query("relation_filter", f"SELECT source, relation, target, confidence FROM ({EDGES}) WHERE relation IN ('describes', 'modifies-degree')")
def relation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark, sf_dir).where(F.col("relation").isin("describes", "modifies-degree")).drop("source_type")


@registry.query(
    "transitive_triples",
    f"""WITH d AS (SELECT DISTINCT source, target FROM ({EDGES}) WHERE relation = 'describes')
SELECT DISTINCT a.source, b.target FROM d a JOIN d b ON a.target = b.source WHERE a.source <> b.target""",
)
def transitive_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = edges_of(spark, sf_dir).where("relation = 'describes'").select("source", "target").distinct()
    d = materialise(d, "describes")
    b = d.select(F.col("source").alias("target"), F.col("target").alias("far"))
    # a hub in the middle is spread over tasks; its pairs are distinct already where they are made
    return bounded_join(d, b, "target", spread=["source"]).where("source <> far").select("source", F.col("far").alias("target")).distinct()


_OTHER = f"SELECT DISTINCT {term_sql('word')} AS word FROM graph_node WHERE {term_sql('word')} IS NOT NULL"


@registry.query(
    "merge_vocab_sets",
    f"""WITH e AS ({EDGES}), a AS (SELECT DISTINCT word FROM ({ENDS})), b AS ({_OTHER})
SELECT 'union' AS part, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'shared', count(*) FROM (FROM a INTERSECT FROM b)
UNION ALL SELECT 'only_a', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'only_b', count(*) FROM (FROM b EXCEPT FROM a)""",
)
def merge_vocab_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, shared and one-sided words of two vocabularies from a single aggregation."""
    a = edges_of(spark, sf_dir).select(F.explode(F.array("source", "target")).alias("word"), F.lit(1).alias("m"))
    b = table(spark, sf_dir, "graph_node").select(term("word").alias("word"), F.lit(2).alias("m")).where("word IS NOT NULL")
    m = a.unionByName(b).groupBy("word").agg(F.bit_or("m").alias("m"))
    n = m.agg(
        F.count(F.lit(1)).alias("union"), F.count_if(F.col("m") == 3).alias("shared"),
        F.count_if(F.col("m") == 1).alias("only_a"), F.count_if(F.col("m") == 2).alias("only_b"),
    )
    return n.select(F.expr("stack(4, 'union', `union`, 'shared', shared, 'only_a', only_a, 'only_b', only_b) AS (part, n)"))


COOCCUR = f"""
SELECT lower(words[i]) AS source, lower(words[j]) AS target, (j - i)::INT AS distance
FROM (SELECT words, i, unnest(range(i + 1, least(i + {fx.WINDOW}, len(words)) + 1)) AS j
      FROM (SELECT words, unnest(range(1, len(words) + 1)) AS i
            FROM (SELECT {fx.tokens_sql('sentence')} AS words FROM ({SENTENCES}))))"""


def cooccur_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = sentence_rows(spark, sf_dir).select(fx.tokens(F.col("sentence")).alias("w"))
    pairs = words.select(F.explode(fx.window_pairs(F.transform("w", F.lower))).alias("p"))
    return pairs.select("p.source", "p.target", "p.distance")


@registry.query("cooccur_edges", f"SELECT source, target, count(*) AS n, min(distance) AS nearest FROM ({COOCCUR}) GROUP BY 1, 2")
def cooccur_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words within five places of one another; pairs are made in the array, so only counts are shuffled."""
    return cooccur_rows(spark, sf_dir).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("nearest"))


@registry.query(
    "edge_confidence",
    f"""SELECT source, target, round(sum(greatest(0.3, round(1.0 - 0.1 * distance, 6))::DOUBLE), 6) / count(*) AS confidence
FROM ({COOCCUR}) WHERE length(source) >= 2 AND length(target) >= 2 AND greatest(0.3, round(1.0 - 0.1 * distance, 6)) >= 0.6 GROUP BY 1, 2""",
)
def edge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = graph.confidence_by_distance(F.col("distance"))
    e = cooccur_rows(spark, sf_dir).where((F.length("source") >= 2) & (F.length("target") >= 2) & (c >= 0.6))
    return e.groupBy("source", "target").agg(graph.mean(c).alias("confidence"))


@registry.query(
    "remap_union",
    f"""WITH e AS ({EDGES}), c AS (SELECT source, 'co-occur' AS relation, target, 0.5 AS confidence FROM (SELECT DISTINCT source, target FROM ({COOCCUR}) WHERE distance = 1)),
m AS (SELECT source, relation, target, confidence, 'graph:' || source_type AS origin FROM e UNION ALL SELECT source, relation, target, confidence, 'text:window' FROM c),
v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT source AS word FROM m UNION SELECT target FROM m))
SELECT origin, relation, count(*) AS n, sum(s.id + 2 * t.id)::BIGINT AS id_sum FROM m JOIN v s ON source = s.word JOIN v t ON target = t.word GROUP BY 1, 2""",
)
def remap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edge sets merged over one new vocabulary, with the source in ``origin``."""
    e = edges_of(spark, sf_dir).withColumn("origin", F.concat(F.lit("graph:"), "source_type")).drop("source_type")
    c = cooccur_rows(spark, sf_dir).where("distance = 1").select("source", "target").distinct()
    c = c.withColumns({"relation": F.lit("co-occur"), "confidence": F.lit(0.5), "origin": F.lit("text:window")})
    m = e.unionByName(c)
    ids = graph.encode(m, _vocab(m))
    return ids.groupBy("origin", "relation").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("source_id") + 2 * F.col("target_id")).alias("id_sum")
    )


@registry.query(
    "components",
    f"""WITH RECURSIVE d AS (SELECT DISTINCT source AS u, target AS v FROM ({EDGES})),
b AS (SELECT u, v FROM d UNION SELECT v, u FROM d), r AS (SELECT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.seen = b.u)
SELECT node, min(seen) AS component FROM r GROUP BY node""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over the edges of all relations."""
    return graph.components(edges_of(spark, sf_dir), "source", "target")


ISA = """
SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region"""


def isa_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(t: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
        return table(spark, sf_dir, t).select(F.concat(F.lit(a[0]), F.col(a[1]).cast("string")).alias("child"), F.concat(F.lit(b[0]), F.col(b[1]).cast("string")).alias("parent"))

    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("world").alias("parent"))
    return (
        named("customer", ("c", "c_custkey"), ("n", "c_nationkey"))
        .unionByName(named("supplier", ("s", "s_suppkey"), ("n", "s_nationkey")))
        .unionByName(named("nation", ("n", "n_nationkey"), ("r", "n_regionkey")))
        .unionByName(top)
    )


CLOSURE = f"""WITH RECURSIVE e AS ({ISA}), n AS (SELECT child AS x FROM e UNION SELECT parent FROM e),
u AS (SELECT x AS descendant, x AS ancestor, 0 AS depth FROM n UNION ALL SELECT descendant, parent, depth + 1 FROM u JOIN e ON ancestor = child WHERE depth < 20)"""


@registry.query("isa_closure", f"{CLOSURE} SELECT descendant, ancestor, min(depth) AS depth FROM u GROUP BY 1, 2")
def isa_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(isa_edges(spark, sf_dir), "child", "parent")


_ISA_PAIRS = "SELECT DISTINCT 's' || l_suppkey AS a, 'c' || o_custkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@registry.query(
    "path_similarity",
    f"""{CLOSURE}, p AS ({_ISA_PAIRS}), c AS (SELECT descendant, ancestor, min(depth) AS depth FROM u GROUP BY 1, 2)
SELECT a, b, 1.0::DOUBLE / (1 + min(x.depth + y.depth)) AS similarity FROM p JOIN c x ON a = x.descendant JOIN c y ON b = y.descendant AND x.ancestor = y.ancestor GROUP BY 1, 2""",
)
def path_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is-a path similarity of suppliers and their customers."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    p = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("b")
    )
    return graph.path_similarity(graph.closure(isa_edges(spark, sf_dir), "child", "parent"), p.distinct(), "a", "b")

"""Queries of even per-key processing (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core import skew
from ..core.terms import relation_name, relation_name_sql, term, term_sql
from . import Registry, table

registry = Registry()

KEYS = ["subject", "relation"]


def keyed_triples(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Triples whose subject and relation are not null, both in their plain form."""
    t = table(spark, sf_dir, "semantic_triple")
    return t.select("triple_id", term("subject").alias("subject"), relation_name("relation").alias("relation"), *more).where(
        F.col("subject").isNotNull() & F.col("relation").isNotNull()
    )


KEYED_SQL = f"""
SELECT DISTINCT triple_id, {term_sql('subject')} AS subject, {relation_name_sql('relation')} AS relation,
       CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence, {term_sql('object')} AS object
FROM semantic_triple"""


@registry.query(
    "p2_found",
    f"""
WITH t AS ({KEYED_SQL}), k AS (SELECT * FROM t WHERE subject IS NOT NULL AND relation IS NOT NULL)
SELECT subject, relation FROM k GROUP BY subject, relation HAVING count(*) * 100 >= (SELECT count(*) FROM k)
""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = keyed_triples(spark, sf_dir)
    per_key = skew.balanced_aggregate(
        t, KEYS, ["triple_id"], [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")], skew.plan_load(t, KEYS)
    )
    total = per_key.agg(F.sum("n").alias("total"))
    return per_key.join(F.broadcast(total), F.col("n") * 100 >= F.col("total")).select(*KEYS)


@registry.query(
    "p2_key_results",
    f"""
WITH t AS ({KEYED_SQL}), k AS (SELECT * FROM t WHERE subject IS NOT NULL AND relation IS NOT NULL),
g AS (SELECT {term_sql('word')} AS word, max(frequency) AS frequency FROM graph_node GROUP BY 1)
SELECT k.subject, k.relation, count(*) AS triples, count(k.confidence) AS scored,
       round(sum(k.confidence), 4) AS confidence_sum, count(k.object) AS with_object, sum(g.frequency) AS node_frequency_sum
FROM k LEFT JOIN g ON k.subject = g.word GROUP BY k.subject, k.relation
""",
)
def p2_key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-key sums with the matching graph node, whose rows go only where their keys' rows are."""
    t = keyed_triples(spark, sf_dir, "confidence", term("object").alias("object"))
    nodes = table(spark, sf_dir, "graph_node").groupBy(term("word").alias("subject")).agg(F.max("frequency").alias("frequency"))
    nodes = nodes.where(F.col("subject").isNotNull())
    plan = skew.plan_load(t, ["subject"])
    joined = skew.fragment_replicate_join(t, nodes, ["subject"], ["triple_id"], "left", plan, distinct=True)
    score = F.when(~F.isnan("confidence"), F.col("confidence"))
    return joined.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("triples"),
        F.count(score).alias("scored"),
        F.round(F.sum(score), 4).alias("confidence_sum"),
        F.count("object").alias("with_object"),
        F.sum("frequency").alias("node_frequency_sum"),
    )

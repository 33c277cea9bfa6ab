"""Sinks: parse batches, graphs, vectors, training data, axes, samples and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def parse_batches(records: DataFrame, path: str, batch_rows: int = 100_000) -> None:
    """JSON lines, files of at most ``batch_rows`` records."""
    records.write.mode("overwrite").option("maxRecordsPerFile", batch_rows).json(path)


def consolidate(spark, path: str, out: str, schema: str) -> None:
    """All batch files as one Parquet table."""
    spark.read.schema(schema).json(path).write.mode("overwrite").parquet(out)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two Parquet tables; edges are partitioned by relation, so a relation filter reads only its files."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartition("relation", F.pmod(F.xxhash64("source"), F.lit(16))).write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def save_training(edges: DataFrame, vocabulary: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")


def save_axes(axes: DataFrame, path: str) -> None:
    axes.write.mode("overwrite").json(path)


def save_lexicon(synsets: DataFrame, edges: DataFrame, senses: DataFrame, path: str) -> None:
    """Synsets as JSON lines with their relations as lists, antonym pairs, and each word's senses; ``readers.synsets`` reads the first."""
    kinds = {"hypernym": "hypernyms", "hyponym": "hyponyms", "meronym": "meronyms", "holonym": "holonyms", "similar": "similar"}
    lists = edges.groupBy(F.col("src").alias("synset_id")).agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("dst")))).alias(n) for k, n in kinds.items()])
    synsets.join(lists, "synset_id", "left").write.mode("overwrite").json(f"{path}/synsets")
    antonyms = edges.where("kind = 'antonym'").select(F.least("src", "dst").alias("synset1"), F.greatest("src", "dst").alias("synset2")).distinct()
    antonyms.write.mode("overwrite").json(f"{path}/antonyms")
    senses.select("word", "sense_idx", "synset_id", "sense_tag").write.mode("overwrite").json(f"{path}/senses")


def save_clusters(clusters: DataFrame, path: str) -> None:
    """(dim, side, words) as JSON lines, one object for each dimension with its sides as a map."""
    sides = clusters.groupBy("dim").agg(F.map_from_entries(F.collect_list(F.struct("side", "words"))).alias("sides"))
    sides.write.mode("overwrite").json(path)


def axis_report(axes: DataFrame) -> DataFrame:
    """Summary figures of axes: number, mean size, coherence and separation."""
    return axes.agg(F.count(F.lit(1)).alias("axes"), F.avg("size").alias("size"), F.avg("coherence").alias("coherence"), F.avg("separation").alias("separation"))


def save_sample(sentences: DataFrame, path: str) -> None:
    """One sentence in each line."""
    sentences.select(F.col("sentence").alias("value")).write.mode("overwrite").text(path)


def dot(parsed: DataFrame) -> DataFrame:
    """(sentence_id, dot): Graphviz text of each tree, built from its arrays in the JVM."""
    label = F.transform(
        "nodes", lambda n, i: F.concat(F.lit("  n"), i.cast("string"), F.lit(' [label="'), F.regexp_replace(F.coalesce(n["text"], n["type"]), '"', "'"), F.lit("\\n"), n["type"], F.lit('"];'))
    )
    arrow = F.transform(
        "edges", lambda e: F.concat(F.lit("  n"), e["child"].cast("string"), F.lit(" -> n"), e["parent"].cast("string"), F.lit(' [label="'), e["type"], F.lit('"];'))
    )
    body = F.concat_ws("\n", F.lit("digraph parse_tree {"), F.array_join(label, "\n"), F.nullif(F.array_join(arrow, "\n"), F.lit("")), F.lit("}"))
    return parsed.where("success").select("sentence_id", body.alias("dot"))

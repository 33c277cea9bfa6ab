"""Whole jobs: training, tree encoding, and streams drained over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.session import materialise, shared_dir
from ..operators import train
from ..sources import sinks
from ..streaming import streams
from . import Registry, table
from .graph import edges_of
from .parsing import parsed

registry = Registry()
DIMS = 16


@registry.query("train_vectors")
def train_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of each epoch over the graph's edges, from vectors seeded by the words."""
    e = train.training_edges(edges_of(spark, sf_dir))
    words = e.select(F.explode(F.array("source", "target")).alias("word"))
    _, losses = train.train(e, train.initial_vectors(words, DIMS), epochs=3)
    return spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")


@registry.query("train_validation")
def train_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation loss of each epoch; a tenth of the edges is held out, six anchor dimensions keep still."""
    e = train.training_edges(edges_of(spark, sf_dir))
    words = e.select(F.explode(F.array("source", "target")).alias("word"))
    _, history = train.validated(e, train.initial_vectors(words, DIMS), epochs=3, anchors=6)
    return spark.createDataFrame(history, "epoch int, loss double, validation double")


def _tree_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = materialise(parsed(spark, sf_dir), "parsed")
    words = p.where("success").select(F.explode("nodes").alias("n")).select(F.lower("n.text").alias("word")).where("word IS NOT NULL")
    return p, materialise(train.initial_vectors(words, DIMS), "word-vectors")


@registry.query("composition_loss")
def composition_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the vectors of parts agree with the whole, and how alike an edge type's differences are."""
    return train.composition_loss(materialise(train.composition_tests(*_tree_words(spark, sf_dir), DIMS), "composition"))


@registry.query("tree_loss")
def tree_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance error of the words that parse edges join, by edge type."""
    return train.tree_loss(*_tree_words(spark, sf_dir))


@registry.query("encode_sentences")
def encode_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence vectors composed along the parse trees."""
    p, vectors = _tree_words(spark, sf_dir)
    return train.tree_vectors(p, vectors, DIMS)


@registry.query("parse_trees_dot")
def parse_trees_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dot(parsed(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _days(d: DataFrame) -> DataFrame:
    return d.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@registry.query(
    "event_windows",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS "start", (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(streams.tumbling(_events(spark, sf_dir), late=None))


@registry.query(
    "event_sliding",
    """SELECT date_trunc('day', ts)::TIMESTAMP - to_days(k::INT) AS "start", date_trunc('day', ts)::TIMESTAMP + to_days((2 - k)::INT) AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events, unnest([0, 1]) t(k) GROUP BY ALL""",
)
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(streams.sliding(_events(spark, sf_dir), late=None))


@registry.query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(streams.sessions(_events(spark, sf_dir), late=None))


@registry.query(
    "event_stream_counts",
    "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
)
def event_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts drained through a stream with a running aggregate: batch and stream agree."""
    base = f"{shared_dir(spark)}/lexiweave/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(schema).parquet(path if _is_dir(spark, path) else f"{sf_dir}/events.parquet*")
    running = source.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    streams.drain(running, f"{base}/out", f"{base}/state", "complete")
    return spark.read.parquet(f"{base}/out")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()

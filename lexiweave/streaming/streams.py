"""Structured Streaming: the parse stream with exactly-once files, running counters, and event windows.

Event-time windows, watermarks and stream deduplication are extensions beyond batch parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import parse_op, parser


def sentence_stream(spark: SparkSession, path: str, max_files: int = 8) -> DataFrame:
    """Lines of text files that arrive in a folder, as (sentence_id, sentence); blank lines drop out."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    s = lines.select(F.trim("value").alias("sentence")).where("sentence <> ''")
    return s.select(F.xxhash64("sentence").alias("sentence_id"), "sentence")


def parse_stream(sentences: DataFrame, config: parser.Config = parser.Config()) -> DataFrame:
    return parse_op.parse_sentences(sentences, config=config, spread=False)


def write_parses(parsed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse records as JSON files. The checkpoint holds the offsets: a restart resumes after the last
    whole batch, and the file sink's log makes each record count once."""
    return (
        parsed.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def running_counters(parsed: DataFrame) -> DataFrame:
    """Cumulative totals of the stream, for complete mode."""
    return parsed.groupBy(F.lit("all").alias("scope")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("success"), F.sum("num_triples").alias("triples"), F.avg("parse_score").alias("score")
    )


def event_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet events with ``ts`` as an instant (files hold it without a zone)."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = "1 day") -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return _flat(e.groupBy(F.window("ts", size), "event_type"))


def sliding(events: DataFrame, size: str = "2 days", slide: str = "1 day", late: str | None = "1 day") -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return _flat(e.groupBy(F.window("ts", size, slide), "event_type"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str | None = "1 day") -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _flat(grouped) -> DataFrame:
    g = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over everything that is there and stop; Parquet for append mode, a table in memory else."""
    w = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        q = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return q

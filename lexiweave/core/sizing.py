"""Joins that broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import skew
from .session import materialise

#: A side is broadcast only if a count of its rows and of their bytes stays within both bounds.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 64 << 20


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than ``bound`` + 1 of them."""
    return df.limit(bound + 1).count() <= bound


def _width(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def fits(df: DataFrame, rows: int | None = None, most_bytes: int | None = None) -> bool:
    """Whether ``df`` has at most ``rows`` rows of at most ``most_bytes`` bytes together; reads no more than ``rows`` + 1 of them."""
    rows = BROADCAST_ROWS if rows is None else rows
    width = sum((_width(f.name, f.dataType) for f in df.schema), F.lit(16)).cast("long")
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return n <= rows and (size or 0) <= (BROADCAST_BYTES if most_bytes is None else most_bytes)


def spread(scan: DataFrame) -> DataFrame:
    """A table scan for work that is heavy for each row: rows are dealt out anew only when the scan
    has fewer partitions than there are cores, as with one small file. Large inputs stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def bounded_join(
    left: DataFrame, right: DataFrame, on, how: str = "inner", bound: int | None = None, spread: list[str] | None = None
) -> DataFrame:
    """Join that broadcasts ``right`` when a count of its rows and bytes proves it small, else shuffles both sides.

    With ``spread`` (columns of ``left`` that tell the rows of one key apart) hot keys of
    ``left`` are then cut into shards and only the matching rows of ``right`` are repeated.
    """
    if fits(right, bound):
        return left.join(F.broadcast(right), on, how)
    keys = [on] if isinstance(on, str) else list(on)
    if spread:
        return skew.fragment_replicate_join(left, right, keys, spread, how)
    return left.join(right.hint("shuffle_hash"), keys, how)


def unique_rows(df: DataFrame, key: list[str], bound: int | None = None) -> DataFrame:
    """One row for each key, without shuffling wide rows whose key occurs once.

    Only the key column is shuffled to find repeated keys. Rows of repeated keys (usually
    few) go through ``dropDuplicates``; all other rows stay where they are. Null keys are
    one key. An empty table stays empty.
    """
    flag = "__repeated"
    repeated = df.groupBy(*key).count().where("count > 1").select(*key).withColumn(flag, F.lit(True))
    repeated = materialise(repeated, "repeated-keys")
    if rows_at_most(repeated, 0):
        return df
    if not fits(repeated, bound):
        return df.dropDuplicates(key)
    names = {k: f"__key_{i}" for i, k in enumerate(key)}
    small = F.broadcast(repeated.withColumnsRenamed(names))
    cond = None
    for k, n in names.items():
        c = df[k].eqNullSafe(F.col(n))
        cond = c if cond is None else cond & c
    marked = df.join(small, cond, "left").drop(*names.values())
    once = marked.where(F.col(flag).isNull()).drop(flag)
    again = marked.where(F.col(flag).isNotNull()).drop(flag).dropDuplicates(key)
    return once.unionByName(again)

"""Frequency of every distinct term, by blockwise count arrays.

A global dictionary gives every term a dense integer. Encoded rows are spread by record and
term, each task accumulates arrays of occurrences and of record presence for the blocks of
identifiers it meets, and the arrays are summed by identifier range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..core.session import materialise
from ..core.sizing import bounded_join

#: Identifiers in one block.
BLOCK = 1 << 14
_SHIFT = 33


def dictionary(terms: DataFrame, column: str = "term") -> DataFrame:
    """Distinct terms with dense ids from 0, as a written table (``term``, ``term_id``).

    Ids are numbered within partitions and moved by the sizes of the partitions before, so
    no task sees the whole dictionary; the driver gets one number for each partition.
    """
    spark = terms.sparkSession
    distinct = terms.select(F.col(column).alias("term")).where(F.col("term").isNotNull()).distinct()
    numbered = materialise(distinct.withColumn("__id", F.monotonically_increasing_id()), "terms")
    part = F.shiftright("__id", _SHIFT)
    sizes = sorted((r.p, r.n) for r in numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    offsets = spark.createDataFrame(starts, "__p long, __start long")
    within = F.col("__id").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    joined = numbered.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return joined.select("term", (F.col("__start") + within).alias("term_id"))


def _accumulate(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted (term_id, record, row) to arrays of counts for each block; only one block is held."""
    last = (-1, None, None)
    block, ids, occ, pres = -1, [], [], []

    def flush() -> pa.RecordBatch:
        i, o, p = np.concatenate(ids), np.concatenate(occ), np.concatenate(pres)
        at, where = np.unique(i, return_inverse=True)
        sums = [np.bincount(where, weights=x, minlength=len(at)).astype(np.int64) for x in (o, p)]
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block], pa.int64()),
                "at": pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                "occurrences": pa.array([sums[0]], pa.list_(pa.int64())),
                "records": pa.array([sums[1]], pa.list_(pa.int64())),
            }
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch.column("term_id").to_numpy(zero_copy_only=False)
        known = np.asarray(batch.column("record").is_valid())
        r = batch.column("record").fill_null(0).to_numpy(zero_copy_only=False)
        k = batch.column("row").to_numpy(zero_copy_only=False)
        pt, pr, pk = (np.concatenate(([x], y[:-1])) for x, y in ((last[0], t), (last[1] or 0, r), (last[2] or 0, k)))
        pv = np.concatenate(([last[1] is not None], known[:-1]))
        new_record = (t != pt) | (r != pr) | (known != pv)
        new_row = new_record | (k != pk)
        last = (int(t[-1]), int(r[-1]) if known[-1] else None, int(k[-1]))
        blocks = t // size
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(t)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if blocks[a] != block and ids:
                yield flush()
                ids, occ, pres = [], [], []
            block = int(blocks[a])
            at, where = np.unique(t[a:b] - block * size, return_inverse=True)
            ids.append(at)
            occ.append(np.bincount(where, weights=new_row[a:b], minlength=len(at)))
            pres.append(np.bincount(where, weights=(new_record & known)[a:b], minlength=len(at)))
    if ids:
        yield flush()


def _sum_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Arrays sorted by block to sums (term_id, occurrences, records). One block's sum is held, however many arrays
    it comes from; Spark bounds the bytes of a batch."""
    block = -1
    occ, pres = np.zeros(size, np.int64), np.zeros(size, np.int64)

    def done() -> pa.RecordBatch:
        i = np.flatnonzero(occ)
        return pa.RecordBatch.from_arrays([pa.array(i + block * size), pa.array(occ[i]), pa.array(pres[i])], names=["term_id", "occurrences", "records"])

    for b in batches:
        for own, at, o, p in zip(b.column(0).to_pylist(), *(b.column(c) for c in (1, 2, 3))):
            if own != block:
                if block >= 0:
                    yield done()
                    occ[:] = 0
                    pres[:] = 0
                block = own
            i = at.values.to_numpy()
            occ[i] += o.values.to_numpy()
            pres[i] += p.values.to_numpy()
    if block >= 0:
        yield done()


def term_frequencies(df: DataFrame, row: str, record: str, terms: list[Column], block: int = BLOCK) -> DataFrame:
    """Occurrences of every distinct term and the number of records it is in.

    ``row`` identifies a row (repeated rows count once), ``record`` the document or sentence, both whole numbers;
    ``terms`` are the columns that hold terms; a term that stands in two of them occurs twice.
    Null terms do not count; rows with a null record count as occurrences but in no record.
    ``block`` is the number of identifiers
    in one block. An empty table gives no rows. Returns ``term``, ``occurrences`` and ``records``.
    """
    held = F.array(*[F.struct(F.lit(i).alias("slot"), t.alias("term")) for i, t in enumerate(terms)])
    rows = df.select(
        (F.col(row).cast("long") * len(terms)).alias("__row"), F.col(record).cast("long").alias("record"), F.explode(held).alias("h")
    )
    rows = rows.select((F.col("__row") + F.col("h.slot")).alias("row"), "record", F.col("h.term").alias("term")).where("term IS NOT NULL")
    words = dictionary(rows)
    encoded = bounded_join(rows, words, "term", spread=["row"]).select("term_id", "record", "row")
    spread = encoded.repartition(F.col("term_id"), F.coalesce("record", "row")).sortWithinPartitions("term_id", "record", "row")
    arrays = spread.mapInArrow(lambda batches: _accumulate(batches, block), "block long, at array<int>, occurrences array<long>, records array<long>")
    ranges = arrays.repartition("block").sortWithinPartitions("block")
    sums = ranges.mapInArrow(lambda batches: _sum_blocks(batches, block), "term_id long, occurrences long, records long")
    return bounded_join(sums, words, "term_id").select("term", "occurrences", "records")


def mark_terms(freq: DataFrame, records: int, rare_below: int, common_share: tuple[int, int]) -> DataFrame:
    """Adds ``mark``: ``rare`` below ``rare_below`` records, ``common`` from the share (numerator,
    denominator) of all records on, null between. Rare wins where both hold."""
    up, down = common_share
    rare = F.col("records") < rare_below
    common = F.col("records") * down >= F.lit(records) * up
    return freq.withColumn("mark", F.when(rare, F.lit("rare")).when(common, F.lit("common")))

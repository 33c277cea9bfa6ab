"""Even per-key processing when a few keys hold most of the rows.

Method: fragment-replicate by estimated load. One map-side combined pass counts the rows of
each key. Keys are packed into tasks, largest first; a key above one task's share is cut into
shards in proportion to its load; every other key goes by its hash bin. A matching side is
replicated only to the shards of the keys that were cut.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .session import task_count

BINS_PER_TASK = 32


@dataclass(frozen=True)
class LoadPlan:
    """Where each key's rows go. ``heavy`` holds at most 2 × tasks keys, ``bins`` 32 × tasks numbers."""

    keys: tuple[str, ...]
    tasks: int
    total: int
    heavy: tuple[tuple[tuple, int, tuple[int, ...]], ...]
    bins: tuple[int, ...]
    key_types: tuple[T.DataType, ...]

    def loads(self) -> list[float]:
        """Planned rows of each task that come from heavy keys."""
        out = [0.0] * self.tasks
        for _, n, shards in self.heavy:
            for t in shards:
                out[t] += n / len(shards)
        return out


def _bin(keys, n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n)).cast("int")


def pack(heavy: list[tuple[tuple, int]], bin_loads: list[int], tasks: int) -> tuple[list[tuple[tuple, int, tuple[int, ...]]], list[int]]:
    """Largest-first packing of shards of heavy keys and of hash bins into ``tasks`` tasks."""
    total = sum(n for _, n in heavy) + sum(bin_loads)
    share = max(1.0, total / tasks)
    items: list[tuple[float, int, int]] = []
    placed: list[list[int]] = []
    for i, (_, n) in enumerate(heavy):
        shards = min(tasks, max(1, -(-n // int(max(1, share)))))
        placed.append([])
        items += [(n / shards, i, -1)] * shards
    items += [(load, -1, b) for b, load in enumerate(bin_loads)]
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    queue = [(0.0, t) for t in range(tasks)]
    heapq.heapify(queue)
    bins = [0] * len(bin_loads)
    for load, i, b in items:
        if i < 0:
            at, t = heapq.heappop(queue)
            bins[b] = t
            heapq.heappush(queue, (at + load, t))
            continue
        skipped = []
        at, t = heapq.heappop(queue)
        while t in placed[i] and queue:  # shards of one key go to different tasks
            skipped.append((at, t))
            at, t = heapq.heappop(queue)
        placed[i].append(t)
        heapq.heappush(queue, (at + load, t))
        for x in skipped:
            heapq.heappush(queue, x)
    return [(k, n, tuple(p)) for (k, n), p in zip(heavy, placed)], bins


def plan_load(df: DataFrame, keys: list[str], tasks: int | None = None) -> LoadPlan:
    """Estimate each key's load over all rows and pack keys into tasks.

    Only one row for each hash bin comes to the driver: its load and its largest key. When a
    bin hides further heavy keys, those bins alone are asked again; a key is heavy from half a
    task's share on, so there are never more than 2 × tasks of them.
    """
    spark = df.sparkSession
    tasks = tasks or task_count(spark)
    n_bins = BINS_PER_TASK * tasks
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    binned = counts.withColumn("__bin", _bin(keys, n_bins))
    per_bin = binned.groupBy("__bin").agg(
        F.sum("__n").alias("load"), F.max("__n").alias("top"), F.max_by(F.struct(*keys), "__n").alias("key")
    )
    rows = per_bin.collect()
    total = sum(r.load for r in rows)
    least = max(1.0, total / (2 * tasks))
    loads = [0] * n_bins
    heavy: list[tuple[tuple, int]] = []
    again = []
    for r in rows:
        rest = r.load
        if r.top >= least:
            if r.load - r.top >= least:
                again.append(r["__bin"])
                continue
            heavy.append((tuple(r.key), r.top))
            rest -= r.top
        loads[r["__bin"]] = rest
    if again:
        whole = {r["__bin"]: r.load for r in rows}
        found = binned.where(F.col("__bin").isin(again) & (F.col("__n") >= least)).collect()
        for b in again:
            own = [(tuple(r[k] for k in keys), r["__n"]) for r in found if r["__bin"] == b]
            heavy += own
            loads[b] = whole[b] - sum(n for _, n in own)
    heavy.sort(key=lambda x: (-x[1], repr(x[0])))
    placed, bins = pack(heavy, loads, tasks)
    types = tuple(df.schema[k].dataType for k in keys)
    return LoadPlan(tuple(keys), tasks, total, tuple(placed), tuple(bins), types)


def _placement(spark: SparkSession, plan: LoadPlan) -> tuple[DataFrame, DataFrame]:
    fields = [T.StructField(f"__k{i}", t) for i, t in enumerate(plan.key_types)]
    heavy = spark.createDataFrame(
        [(*k, list(shards)) for k, _, shards in plan.heavy],
        T.StructType([*fields, T.StructField("__shards", T.ArrayType(T.IntegerType()))]),
    )
    bins = spark.createDataFrame(list(enumerate(plan.bins)), "__b int, __home int")
    return heavy, bins


def _with_home(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """Adds ``__shards`` (null for light keys) and ``__home``. Both lookups are broadcast; the plan bounds their rows."""
    heavy, bins = _placement(df.sparkSession, plan)
    cond = None
    for i, k in enumerate(plan.keys):
        c = df[k].eqNullSafe(F.col(f"__k{i}"))
        cond = c if cond is None else cond & c
    marked = df.join(F.broadcast(heavy), cond, "left").drop(*[f"__k{i}" for i in range(len(plan.keys))])
    return marked.withColumn("__b", _bin(plan.keys, len(plan.bins))).join(F.broadcast(bins), "__b", "left").drop("__b")


def place(df: DataFrame, plan: LoadPlan, spread: list[str]) -> DataFrame:
    """Move each row to its planned task, column ``__task``; rows of a cut key go by the hash of ``spread``.

    Rows equal in the keys and in ``spread`` always meet in one task, so exact copies can be
    dropped there without another shuffle.
    """
    homed = _with_home(df, plan)
    shard = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.size("__shards")).cast("int")
    task = F.when(F.col("__shards").isNotNull(), F.get("__shards", shard)).otherwise(F.col("__home"))
    return homed.withColumn("__task", task).drop("__shards", "__home").repartitionById(plan.tasks, F.col("__task"))


def replicate(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """Send each row of a matching side to every task that holds rows of its key, and to no other."""
    homed = _with_home(df, plan)
    tasks = F.coalesce(F.col("__shards"), F.array("__home"))
    return homed.withColumn("__task", F.explode(tasks)).drop("__shards", "__home").repartitionById(plan.tasks, F.col("__task"))


def balanced_aggregate(
    df: DataFrame, keys: list[str], row_key: list[str], partial: list[Column], final: list[Column], plan: LoadPlan | None = None
) -> DataFrame:
    """Per-key results in even time.

    ``row_key`` names the columns that identify a row; rows equal in keys and ``row_key`` count
    once (exact copies). ``partial`` aggregates one shard of one key, ``final`` merges the shards
    by the aliases that ``partial`` gave. Null keys form a key of their own; an empty table gives no rows.
    """
    plan = plan or plan_load(df, keys)
    placed = place(df, plan, row_key)
    once = placed.dropDuplicates(["__task", *keys, *row_key])
    shards = once.groupBy("__task", *keys).agg(*partial)
    return shards.groupBy(*keys).agg(*final)


def fragment_replicate_join(
    df: DataFrame, other: DataFrame, keys: list[str], spread: list[str], how: str = "inner", plan: LoadPlan | None = None, null_safe: bool = False,
    distinct: bool = False,
) -> DataFrame:
    """Equi-join on ``keys`` (same names on both sides) whose hot keys are spread over tasks.

    ``how`` is inner, left, left_semi or left_anti, which replication of the right side leaves
    exact. Null keys match only with ``null_safe``. Columns of ``other`` that clash with ``df``
    get the suffix ``_right``. With ``distinct``, exact copies of a row of ``df`` count once; they
    meet in one task, so dropping them costs no shuffle.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} would repeat rows of the replicated side")
    plan = plan or plan_load(df, keys)
    clash = {c: f"{c}_right" for c in other.columns if c in df.columns and c not in keys}
    left = place(df, plan, spread)
    left = left.distinct() if distinct else left
    own = {k: f"__right_{k}" for k in [*keys, "__task"]}
    right = replicate(other.withColumnsRenamed(clash), plan).withColumnsRenamed(own)
    cond = left["__task"] == right["__right___task"]
    for k in keys:
        cond &= left[k].eqNullSafe(right[own[k]]) if null_safe else left[k] == right[own[k]]
    return left.join(right.hint("shuffle_hash"), cond, how).drop("__task", *own.values())

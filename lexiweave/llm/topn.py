"""Top N items within every group, by score histograms.

One map-side combined pass keeps, for each group and score bin, a bit set of hashed items.
Its population count never exceeds the number of distinct items in the bin, so walking the
bins from the best one down gives a threshold below which no item can be among the best N.
Rows beyond the thresholds are filtered out and only the survivors are ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core import sizing, skew
from ..core.session import materialise

#: Bins for each doubling of the score's magnitude.
STEPS = 8
_LOWEST = 1080 * STEPS


def score_bin(score: Column) -> Column:
    """A whole number that never falls as the score rises; zero has bin 0."""
    size = F.floor(F.log2(F.abs(score)) * STEPS).cast("int") + F.lit(_LOWEST)
    return F.when(score == 0, F.lit(0)).when(score > 0, size).otherwise(-size)


def _masks(tie: list[str], n: int) -> list[Column]:
    """One-hot bit of an item's hash, over enough 63-bit words to count ``n`` items."""
    words = max(1, -(-n // 16))
    h = F.xxhash64(*[F.col(c) for c in tie])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(63)).cast("int"))
    word = F.pmod(F.floor(F.pmod(h, F.lit(63 * 1_000_003)) / 63), F.lit(words))
    return [F.when(word == i, bit).otherwise(F.lit(0).cast("long")).alias(f"__m{i}") for i in range(words)]


def thresholds(df: DataFrame, group: list[str], score: str, tie: list[str], n: int) -> DataFrame:
    """For each group the lowest bin that may hold one of the N best (``__from``; null: all may)
    and the highest that may hold one of the N worst (``__to``)."""
    masks = _masks(tie, n)
    names = [f"__m{i}" for i in range(len(masks))]
    hist = (
        df.select(*group, score_bin(F.col(score)).alias("__bin"), *masks)
        .groupBy(*group, "__bin")
        .agg(*[F.bit_or(m).alias(m) for m in names])
    )

    def counted(w: Window) -> Column:
        out = F.lit(0)
        for m in names:
            out = out + F.bit_count(F.bit_or(m).over(w))
        return out

    rows = Window.partitionBy(*group).rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("__down", counted(rows.orderBy(F.desc("__bin")))).withColumn("__up", counted(rows.orderBy("__bin")))
    return ranked.groupBy(*group).agg(
        F.max(F.when(F.col("__down") >= n, F.col("__bin"))).alias("__from"),
        F.min(F.when(F.col("__up") >= n, F.col("__bin"))).alias("__to"),
    )


def top_n_per_group(
    df: DataFrame, group: list[str], score: str, tie: list[str], n: int, sides: tuple[str, ...] = ("top", "bottom")
) -> DataFrame:
    """The N best (side ``top``) and N worst (``bottom``) items of each group.

    ``tie`` identifies an item within its group and orders equal scores, ascending on both
    sides, nulls last. Null, NaN and infinite scores do not count. Repeated rows count once.
    Groups with fewer than N items give all of them. Null group keys form a group. An empty
    table gives no rows. Columns besides the named ones are ignored, whatever their names.
    Returns ``group``, ``side``, ``tie``, ``score`` and ``rank`` from 1.
    """
    if n < 1 or not set(sides) <= {"top", "bottom"}:
        raise ValueError("n must be positive and sides among top and bottom")
    value = F.col(score).cast("double")
    rows = df.select(*group, *tie, value.alias(score)).where(F.abs(F.col(score)) < float("inf"))
    bounds = materialise(thresholds(rows, group, score, tie, n), "topn-thresholds")
    if sizing.rows_at_most(bounds, sizing.BROADCAST_ROWS):
        own = {g: f"__g_{i}" for i, g in enumerate(group)}
        cond = F.lit(True)
        for g, o in own.items():
            cond &= F.col(g).eqNullSafe(F.col(o))
        marked = rows.join(F.broadcast(bounds.withColumnsRenamed(own)), cond).drop(*own.values())
    else:  # too many groups to broadcast: spread the rows of hot groups and replicate their thresholds
        marked = skew.fragment_replicate_join(rows, bounds, group, tie, "inner", null_safe=True)
    at = score_bin(F.col(score))
    kept = F.array_compact(
        F.array(
            F.when(F.lit("top" in sides) & (F.col("__from").isNull() | (at >= F.col("__from"))), F.lit("top")),
            F.when(F.lit("bottom" in sides) & (F.col("__to").isNull() | (at <= F.col("__to"))), F.lit("bottom")),
        )
    )
    survivors = marked.withColumn("__sides", kept).where(F.size("__sides") > 0)
    survivors = survivors.select(*group, *tie, score, F.explode("__sides").alias("side"))
    best_first = F.when(F.col("side") == "top", -F.col(score)).otherwise(F.col(score))
    order = [best_first, *[F.col(t).asc_nulls_last() for t in tie]]
    # a dense rank lets copies of a row share one place; Spark cuts each partition to N places before the shuffle
    ranked = survivors.withColumn("rank", F.dense_rank().over(Window.partitionBy(*group, "side").orderBy(*order)))
    return ranked.where(F.col("rank") <= n).dropDuplicates([*group, "side", "rank"]).select(*group, "side", *tie, score, "rank")

"""Items that appear together: pair counts and their excess over chance.

Items are made distinct within a basket, ordered pairs are emitted from each basket's sorted
item ids, counts are combined map-side, and lift and pointwise mutual information follow from
the marginals. Bounds on the result prune items beforehand without losing a pair. A basket too
large for one row is kept as rows, and its pairs are made between blocks of its items, in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core.session import materialise, task_count
from ..core.sizing import bounded_join, rows_at_most

#: Items (repeats included) up to which a basket is one row; the pairs of larger baskets are made in blocks of ``PAIR_BLOCK`` items.
ONE_ROW = 4096
PAIR_BLOCK = 1024


def baskets(df: DataFrame, basket: str, items: Column) -> DataFrame:
    """One row for each basket with its distinct items, placed by basket.

    Repeated rows and repeated items fall together. Null baskets, null arrays and null items
    do not count.
    """
    # a set: copies of a row, however many, combine map-side
    return _present(df, basket, items).groupBy("basket").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def _present(df: DataFrame, basket: str, items: Column) -> DataFrame:
    present = F.filter(F.array_distinct(items), lambda x: x.isNotNull())
    return df.select(F.col(basket).alias("basket"), present.alias("items")).where(F.col("basket").isNotNull())


def _block_pairs(items: DataFrame) -> DataFrame:
    """Pairs a < b of the distinct (basket, id) rows of large baskets: each pair of blocks of a basket is a join key of its own."""
    sizes = items.groupBy("basket").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cut = bounded_join(items, sizes, "basket", spread=["id"]).select("basket", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = task_count(items.sparkSession)
    a = cut.select("basket", F.col("own").alias("i"), F.col("other").alias("j"), F.col("id").alias("a")).repartition(tasks, "basket", "i", "j")
    b = cut.select("basket", F.col("other").alias("i"), F.col("own").alias("j"), F.col("id").alias("b")).repartition(tasks, "basket", "i", "j")
    return a.join(b.hint("shuffle_hash"), ["basket", "i", "j"]).where("a < b").select("a", "b")


def cooccurrence(df: DataFrame, basket: str, items: Column, min_together: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Pairs of different items with the number of baskets that hold both.

    Returns ``item_a`` < ``item_b`` (by code point), ``together``, ``count_a``, ``count_b``,
    ``baskets`` (those with at least one item), ``lift`` and ``pmi`` (natural logarithm), for
    all pairs with ``together`` ≥ ``min_together`` and lift ≥ ``min_lift``.

    Both bounds prune items exactly: a pair is together at most as often as its rarer item
    occurs, so an item below ``min_together`` is in no such pair, and since
    together ≤ min(count_a, count_b), an item with count × min_lift > baskets is in none
    either. That removes the words of nearly every basket before pairs are made.
    Baskets of one item count in ``baskets`` but give no pair; an empty table gives no rows.
    """
    rows = _present(df, basket, items)
    large = rows.groupBy("basket").agg(F.sum(F.size("items")).alias("n")).where(F.col("n") > ONE_ROW).select("basket")
    large = materialise(large, "cooccur-large")
    some = not rows_at_most(large, 0)
    small = bounded_join(rows, large, "basket", "left_anti") if some else rows
    sets = materialise(small.groupBy("basket").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")), "cooccur-sets")
    # one pass counts the items and, by each basket's first item, the baskets
    each = sets.select(F.posexplode("items").alias("pos", "item")).select("item", (F.col("pos") == 0).alias("first"))
    if some:
        held = bounded_join(rows, large, "basket", "left_semi").select("basket", F.explode("items").alias("item")).distinct()
        held = materialise(held, "cooccur-large-items")
        heads = held.groupBy("basket").agg(F.min("item").alias("item"), F.lit(True).alias("first"))
        marked = bounded_join(held, heads.withColumnRenamed("item", "head").drop("first"), "basket", spread=["item"])
        each = each.unionByName(marked.select("item", (F.col("item") == F.col("head")).alias("first")))
    counts = each.groupBy("item").agg(F.count(F.lit(1)).alias("count"), F.count_if("first").alias("first"))
    every = materialise(counts.withColumn("id", F.monotonically_increasing_id()), "cooccur-items")
    n = every.agg(F.sum("first")).first()[0] or 0
    vocabulary = every.drop("first").where((F.col("count") >= min_together) & (F.col("count") * F.lit(float(min_lift)) <= n))
    encoded = bounded_join(sets.select("basket", F.explode("items").alias("item")), vocabulary.select("item", "id"), "item", spread=["basket"])
    sorted_ids = encoded.groupBy("basket").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    first = sorted_ids.select("ids", F.posexplode("ids").alias("pos", "a"))
    pairs = first.select("a", F.explode(F.slice("ids", F.col("pos") + 2, F.size("ids"))).alias("b"))
    if some:
        pairs = pairs.unionByName(_block_pairs(materialise(bounded_join(held, vocabulary.select("item", "id"), "item", spread=["basket"]).select("basket", "id"), "cooccur-large-ids")))
    together = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= min_together)

    def side(key: str) -> DataFrame:
        return vocabulary.select(F.col("id").alias(key), F.col("item").alias(f"item_{key}"), F.col("count").alias(f"n_{key}"))

    named = bounded_join(bounded_join(together, side("a"), "a"), side("b"), "b")
    swap = F.col("item_a") > F.col("item_b")
    lift = F.col("together") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
    out = named.select(
        F.least("item_a", "item_b").alias("item_a"),
        F.greatest("item_a", "item_b").alias("item_b"),
        "together",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("count_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("count_b"),
        F.lit(n).cast("long").alias("baskets"),
        lift.alias("lift"),
        F.log(lift).alias("pmi"),
        (F.col("together") * F.lit(float(n)) >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b")).alias("__enough"),
    )
    return out.where("__enough").drop("__enough")

import random

from pyspark.sql import functions as F

from lexiweave.core import sizing, skew


def rows(spark, n=3000):
    rng = random.Random(3)
    data = []
    for i in range(n):
        hot = rng.random() < 0.4
        data.append((i, "hot" if hot else f"k{rng.randrange(300)}", None if rng.random() < 0.02 else rng.random()))
    data += data[:50]
    return spark.createDataFrame(data, "id long, key string, x double"), data


def test_hot_key_is_cut_and_loads_are_even(spark):
    df, data = rows(spark)
    plan = skew.plan_load(df, ["key"], 8)
    hot = next(h for h in plan.heavy if h[0] == ("hot",))
    assert plan.total == len(data)
    assert len(set(hot[2])) == len(hot[2]) >= 3
    sizes = [r["count"] for r in skew.place(df, plan, ["id"]).groupBy("__task").count().collect()]
    assert max(sizes) < 1.4 * len(data) / 8


def test_aggregate_counts_copies_once(spark):
    df, data = rows(spark)
    got = skew.balanced_aggregate(df, ["key"], ["id"], [F.count("id").alias("n")], [F.sum("n").alias("n")])
    want = {}
    for i, k, _ in set(data):
        want[k] = want.get(k, 0) + 1
    assert {r.key: r.n for r in got.collect()} == want


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, key string")
    agg = lambda d: skew.balanced_aggregate(d, ["key"], ["id"], [F.count("id").alias("n")], [F.sum("n").alias("n")])
    assert {(r.key, r.n) for r in agg(df).collect()} == {(None, 2), ("a", 1)}
    assert agg(df.limit(0)).collect() == []


def test_join_equals_plain_join(spark):
    df, _ = rows(spark)
    other = spark.createDataFrame([("hot", 1, 5.0), ("k1", 2, 6.0), ("k1", 3, 7.0), ("none", 4, 8.0)], "key string, y int, x double")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.fragment_replicate_join(df, other, ["key"], ["id"], how, skew.plan_load(df, ["key"], 8))
        want = df.join(other.withColumnRenamed("x", "x_right"), "key", how)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, None), (2, "a")], "id long, key string")
    b = spark.createDataFrame([(None, 9), ("a", 8)], "key string, y int")
    assert {(r.id, r.y) for r in skew.fragment_replicate_join(a, b, ["key"], ["id"], null_safe=True).collect()} == {(1, 9), (2, 8)}
    assert {(r.id, r.y) for r in skew.fragment_replicate_join(a, b, ["key"], ["id"]).collect()} == {(2, 8)}


def test_place_needs_one_shuffle(spark):
    df, _ = rows(spark)
    plan = skew.plan_load(df, ["key"], 8)
    agg = skew.place(df, plan, ["id"]).groupBy("__task", "key").count()
    text = agg._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") - text.count("BroadcastExchange ") == 1


def test_pack_keeps_every_bin_and_key():
    heavy, bins = skew.pack([(("a",), 1000), (("b",), 300)], [10] * 64, 8)
    assert len(bins) == 64 and set(bins) <= set(range(8))
    assert len(heavy[0][2]) >= 4 and len(heavy[1][2]) >= 1


def test_unique_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c")], "k long, v string")
    for bound in (None, 0):
        assert sorted(map(str, sizing.unique_rows(df, ["k"], bound).collect())) == sorted(map(str, df.distinct().collect()))
    assert sizing.unique_rows(df.limit(0), ["k"]).count() == 0


def test_bounded_join_both_ways(spark):
    df, _ = rows(spark)
    other = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, y int")
    want = df.join(other, "key").count()
    assert sizing.bounded_join(df, other, "key").count() == want
    assert sizing.bounded_join(df, other, "key", bound=1).count() == want
    assert sizing.bounded_join(df, other, "key", bound=1, spread=["id"]).count() == want

import random

from pyspark.sql import functions as F

from placeweave.operators.joins import fallback_rows
from placeweave.operators.ranking import (
    earliest_per_key, global_top_ties, latest_per_key, ordered_join, priority_dedup, top_n)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_large_top_n_with_one_hot_key(spark):
    """The salted two-step cut equals the plain one, also for copies of one row."""
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.7 else f"k{i % 5}", rng.randint(0, 50), i % 900) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v int, i int").repartition(6)
    got = rows(top_n(df, ["k"], [F.desc("v"), "i"], 150).select("k", "v", "i"))
    want = []
    for key in {k for k, _, _ in data}:
        want += sorted((r for r in data if r[0] == key), key=lambda r: (-r[1], r[2]))[:150]
    assert got == sorted(want)


def test_cut_happens_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as v")
    plan = top_n(df, ["k"], [F.desc("v")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_latest_and_earliest(spark):
    df = spark.createDataFrame([(1, "2025-06-17", "old"), (1, "2025-09-22", "new"), (2, "2025-06-17", "only")],
                               "id int, snapshot_date string, what string")
    assert {r.what for r in latest_per_key(df, ["id"], "snapshot_date").collect()} == {"new", "only"}
    once = earliest_per_key(df, ["id"], "snapshot_date")
    assert {r.what for r in once.collect()} == {"old", "only"}
    assert rows(earliest_per_key(once, ["id"], "snapshot_date")) == rows(once)


def test_ties(spark):
    df = spark.createDataFrame([(n, v) for n, v in zip("abcde", [5, 4, 4, 4, 1])], "n string, v int")
    assert sorted(r.n for r in global_top_ties(df, "v", 2).collect()) == ["a", "b", "c", "d"]
    assert global_top_ties(df, "v", 50).count() == 5
    ranked = top_n(df.withColumn("g", F.lit(1)), ["g"], [F.desc("v")], 2, ties=True)
    assert sorted(r.n for r in ranked.collect()) == ["a", "b", "c", "d"]


def test_priority_dedup_drops_missing_ids(spark):
    df = spark.createDataFrame([("s", "1", 2), ("s", "1", 0), ("s", None, 0), ("s", "", 0), ("t", "1", 1)],
                               "slug string, id string, rank int")
    assert rows(priority_dedup(df, ["slug"], "id", ["rank"])) == [("s", "1", 0), ("t", "1", 1)]


def test_ordered_join(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, rank int, w string")
    assert rows(ordered_join(df, ["k"], "w", "rank", "out", " | ")) == [("a", "y | x"), ("b", "z")]


def test_fallback_only_where_primary_is_thin(spark):
    df = spark.createDataFrame([("a", "p")] * 3 + [("a", "f"), ("b", "p"), ("b", "f"), ("c", "f"), ("a", None)],
                               "k string, kind string")
    got = rows(fallback_rows(df, ["k"], F.col("kind") == "p", F.col("kind") == "f", 3).na.fill("-"))
    assert got == sorted([("a", "p")] * 3 + [("a", "-"), ("b", "p"), ("b", "f"), ("c", "f")])


def test_ties_with_missing_values(spark):
    from placeweave.operators.ranking import global_top_ties

    df = spark.createDataFrame([(5,), (None,), (None,)], "v int")
    assert [global_top_ties(df, "v", n).count() for n in (0, 1, 2, 10)] == [0, 1, 3, 3]


def test_salted_cut_is_the_same(spark):
    from pyspark.sql import functions as F

    from placeweave.operators.ranking import top_n

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("v"))
    want = sorted(map(tuple, top_n(df, ["k"], ["v"], 120).collect()))
    assert sorted(map(tuple, top_n(df, ["k"], ["v"], 120, salts=8).collect())) == want and len(want) == 360

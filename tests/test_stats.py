import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from placeweave.functions.ordering import ordered_bits
from placeweave.operators.checks import Check, CheckFailed, enforce, no_nulls, observed, row_count, run_checks
from placeweave.operators.stats import (
    _narrowed, _place_by_order, _place_by_width, engagement, polarity, shannon_entropy, share_in_group, with_median)


def entropy(spark, counts):
    return spark.createDataFrame([(c,) for c in counts], "n bigint").agg(shannon_entropy("n").alias("h")).first().h


def test_entropy(spark):
    assert entropy(spark, [1, 1]) == pytest.approx(math.log(2))
    assert entropy(spark, [5]) == 0
    assert entropy(spark, [5, 0]) == 0
    assert entropy(spark, []) is None
    assert entropy(spark, [0]) is None
    counts = [3, 9, 1, 40]
    p = [c / sum(counts) for c in counts]
    assert entropy(spark, counts) == pytest.approx(-sum(x * math.log(x) for x in p))
    assert 0 <= entropy(spark, counts) <= math.log(len(counts))


def test_median_is_exact_with_a_hot_key(spark):
    """Checked against a sort, with a coarse sketch so that the bracket is really used."""
    rng = random.Random(3)
    data = [("hot", float(rng.choice([rng.gauss(0, 1), rng.randint(0, 9), 1e6 * rng.random()]))) for _ in range(4001)]
    data += [(f"k{i % 40}", float(rng.randint(0, 5))) for i in range(400)]
    data += [(None, 4.0), (None, 7.0), ("empty", None), ("one", 3.5), ("hot", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    for accuracy, parts in ((50, 4096), (1000, 4096), (50, 2)):
        got = {r.k: (r.m, r.n) for r in with_median(df, ["k"], "v", "m", [F.count("*").alias("n")], accuracy, parts).collect()}
        for key in {k for k, _ in data}:
            values = [v for k, v in data if k == key and v is not None]
            want = statistics.median(values) if values else None
            assert got[key] == (want, sum(k == key for k, _ in data)), key


def test_polarity(spark):
    df = spark.createDataFrame([("a", "positive"), ("a", "positive"), ("b", "negative")], "g string, sentiment string")
    got = {r.g: (r.pos_ratio, r.positive, r.negative) for r in polarity(df, ["g"]).collect()}
    assert got == {"a": (pytest.approx(2 / 3), 2, 0), "b": (0.0, 0, 1)}


def test_engagement_skips_missing_measures(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", None, 5)], "g string, score int, num_comments int")
    assert tuple(engagement(df, ["g"], ["score", "num_comments"]).first()) == ("a", 2, 3)


def test_shares_sum_to_one_also_for_a_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, v double")
    got = sorted((r.g or "", r.share) for r in share_in_group(df, ["g"], "v", "share").collect())
    assert got == [("", 1.0), ("a", 0.25), ("a", 0.75)]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    result = run_checks(df, [row_count(2), no_nulls("id"), no_nulls("name", "warn")])
    assert [(r.check, r.passed, r.observed) for r in result.collect()] == [
        ("row_count", True, 2), ("no_null_id", True, 0), ("no_null_name", False, 1)]
    assert [r.check for r in enforce(result)] == ["no_null_name"]
    with pytest.raises(CheckFailed):
        enforce(run_checks(df, [Check("big", F.max("id"), 9)]))


def test_observed_rides_along(spark):
    df, watch = observed(spark.range(10), "stage", raw=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    df.write.format("noop").mode("overwrite").save()
    assert watch.get == {"raw": 10, "even": 5}


def test_a_missing_measure_fails_its_check(spark):
    import pytest
    from pyspark.sql import functions as F

    from placeweave.operators.checks import Check, CheckFailed, enforce, run_checks

    results = run_checks(spark.range(0), [Check("sum", F.sum("id"), 0)])
    assert not results.first().passed
    with pytest.raises(CheckFailed):
        enforce(results)


def test_order_of_all_doubles(spark):
    rng = random.Random(5)
    edges = [math.ldexp(m, e) for e in range(-1074, 1024) for m in (1.0, 1.5, 1.9999999999999998) if m == 1.0 or e > -1022]
    edges += [math.nextafter(x, 0.0) for x in edges[::7]] + [rng.uniform(-1e9, 1e9) for _ in range(300)]
    values = sorted({x * s for x in edges for s in (1, -1)} | {math.inf, -math.inf, 0.0})
    df = spark.createDataFrame([(v,) for v in [*values, -0.0, math.nan]], "v double").select("v", ordered_bits("v").alias("b"))
    bits = [r.b for r in df.collect()]
    assert all(a < b for a, b in zip(bits[:-2], bits[1:-2], strict=False))
    assert bits[-2] == 0 and bits[-1] > max(bits[:-1])
    raw = [struct.unpack(">q", struct.pack(">d", abs(v)))[0] for v in values]
    assert bits[:-2] == [-r if v < 0 else r for v, r in zip(values, raw, strict=True)]


def test_median_far_from_its_marks(spark):
    """All scales of doubles, both signs, in one key: whatever the sketch says, the rounds find the middle."""
    rng = random.Random(6)
    values = [rng.choice([1, -1]) * math.ldexp(rng.random(), rng.randint(-1060, 1000)) for _ in range(801)] + [math.inf, -math.inf] * 3
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    for some in (df, df.filter("v > 0"), df.filter("v < 0")):
        every = [r.v for r in some.collect()]
        assert with_median(some, ["k"], "v", "m", accuracy=20, parts=3).first().m == statistics.median(every)


def test_rounds_fold_a_hot_key_in_the_map_tasks(spark):
    """No sort or window sees a key's values, and what a task sends on is bounded by the parts."""
    df = spark.range(0, 300_000, numPartitions=4).select(F.lit("hot").alias("k"), F.hash("id").cast("double").alias("v"))
    ranges = spark.createDataFrame([("hot", 300_000, -2.0 ** 31, 2.0 ** 31)], "k string, _n bigint, _l double, _h double")
    for place in (_place_by_width, _place_by_order):
        step = _narrowed(df.withColumnRenamed("v", "_v"), ranges.filter("_l < 0"), ["k"], 64, place)
        assert step.count() == 1
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert plan.rindex("Window") < plan.index("functions=[partial_count(1)")


def test_median_of_a_key_with_a_million_values(spark):
    df = spark.range(1_000_001).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 1_000_001).alias("v"))
    assert with_median(df, ["k"], "v", "m").first().m == 500_000.0

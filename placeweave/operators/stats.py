"""Grouped statistics that combine in the map tasks before any shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.functions.ordering import ordered_bits
from placeweave.operators.joins import with_group_value
from placeweave.session import cut_lineage


def shannon_entropy(count: Column | str) -> Column:
    """Aggregate: entropy in nats of positive counts, NULL when there are none.

    ``ln(T) - sum(n ln n) / T`` equals ``-sum(p ln p)`` and needs no total per row."""
    n = F.col(count) if isinstance(count, str) else count
    n = F.when(n > 0, n.cast("double"))
    total = F.sum(n)
    return (F.when(F.count(n) == 1, F.lit(0.0))
            .otherwise(F.ln(total) - F.sum(n * F.ln(n)) / total))


def category_counts(df: DataFrame, keys: list[str], category: str, out: str = "n") -> DataFrame:
    return df.groupBy(*keys, category).agg(F.count("*").alias(out))


def diversity(counts: DataFrame, keys: list[str], n: str = "n", total: str = "total",
              index: str = "diversity") -> DataFrame:
    """Total and entropy of category counts per key."""
    return counts.groupBy(*keys).agg(F.sum(n).alias(total), shannon_entropy(n).alias(index))


#: Parts that a round of the selection cuts a key's range into.
PARTS = 4096


def with_median(df: DataFrame, keys: list[str], value: str, out: str, aggs: list[Column] = (),
                accuracy: int = 10_000, parts: int = PARTS) -> DataFrame:
    """Aggregates and the exact median per key, without holding a group in one place.

    A first pass takes the aggregates and a quantile sketch, whose marks around the middle are the
    range to look in first; a wrong one costs a round, not the result. Each further pass folds, in the map tasks, a key's values
    into one row for each part of its range and one for each side of it, with count, least and largest
    value. The part that holds the middle ranks is the next range. Parts are of equal width at first, which as a rule
    ends it; from then on they are equal in the order of all doubles, so that a range shrinks by ``parts``
    each time, whatever the values, and is one value after six. Keys that are done take no part in later passes."""
    margin = 3.0 / accuracy
    v = F.col(value).cast("double")
    marks = F.percentile_approx(v, [0.5 - margin, 0.5 + margin], accuracy)
    first = cut_lineage(df.groupBy(*keys).agg(*aggs, F.count(v).alias("_n"), marks.alias("_b")), "marks")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, v.alias("_v"))
    ranges = first.filter(F.col("_n") > 0).select(*keys, "_n", F.col("_b")[0].alias("_l"), F.col("_b")[1].alias("_h"))
    found, place = None, _place_by_width
    while True:
        step = cut_lineage(_narrowed(rows, ranges, keys, parts, place), "middle")
        place = _place_by_order
        done = step.filter("_done").select(*keys, ((F.col("_l") + F.col("_h")) / 2).alias(out))
        found = done if found is None else found.unionByName(done)
        ranges = step.filter(~F.col("_done")).drop("_done")
        if ranges.isEmpty():
            return with_group_value(first.drop("_b", "_n"), found, keys)


def _place_by_width(parts: int) -> Column:
    """Part of a value between ``_l`` and ``_h``; one part where their distance is no number to divide by."""
    width = F.col("_h") - F.col("_l")
    return F.when((width > 0) & (width < float("inf")), F.floor((F.col("_v") - F.col("_l")) / width * (parts - 1))).otherwise(0)


def _place_by_order(parts: int) -> Column:
    """The same, parts holding equally many doubles; the two signs are told apart first."""
    low, high = ordered_bits("_l"), ordered_bits("_h")
    place = F.floor((ordered_bits("_v") - low).cast("double") / ((high - low).cast("double") + 1) * parts)
    both = (F.col("_l") < 0) & (F.col("_h") >= 0)
    return F.when(both, F.when(F.col("_v") < 0, 0).otherwise(1)).otherwise(F.least(place, F.lit(parts - 1)))


def _narrowed(rows: DataFrame, ranges: DataFrame, keys: list[str], parts: int, place: Callable[[int], Column]) -> DataFrame:
    """Per key either the two middle values (``_done``) or the least and largest value of the part that holds both."""
    met = with_group_value(rows, ranges, keys, "inner")
    part = F.when(F.col("_v") < F.col("_l"), -1).when(F.col("_v") > F.col("_h"), parts).otherwise(place(parts)).cast("int")
    folded = met.groupBy(*keys, "_n", part.alias("_p")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    ranked = folded.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c"))

    def held(rank: Column) -> tuple[Column, Column, Column]:
        """Of the part with this rank the value if it is certain, the least and the largest value."""
        here = (F.col("_before") < rank) & (rank <= F.col("_upto"))
        value = (F.when(F.col("_least") == F.col("_most"), F.col("_least")).when(rank == F.col("_before") + 1, F.col("_least"))
                 .when(rank == F.col("_upto"), F.col("_most")))
        return F.max(F.when(here, value)), F.max(F.when(here, F.col("_least"))), F.max(F.when(here, F.col("_most")))

    low, least, _ = held(F.floor((F.col("_n") + 1) / 2))
    high, _, most = held(F.floor(F.col("_n") / 2) + 1)
    done = low.isNotNull() & high.isNotNull()
    return ranked.groupBy(*keys, "_n").agg(
        done.alias("_done"), F.when(done, low).otherwise(least).alias("_l"), F.when(done, high).otherwise(most).alias("_h"))


def engagement(df: DataFrame, keys: list[str], parts: list[str], n: str = "post_count",
               total: str = "total_engagement") -> DataFrame:
    """Row count and the sum of added-up measures; a row missing any measure adds nothing."""
    added = F.col(parts[0])
    for p in parts[1:]:
        added = added + F.col(p)
    return df.groupBy(*keys).agg(F.count("*").alias(n), F.coalesce(F.sum(added), F.lit(0)).alias(total))


def polarity(df: DataFrame, keys: list[str], sentiment: str = "sentiment", positive: str = "positive",
             negative: str = "negative", ratio: str = "pos_ratio") -> DataFrame:
    """Positive and negative counts per key as two columns, and pos / (pos + neg + 1)."""
    wide = (df.groupBy(*keys).pivot(sentiment, ["positive", "negative"]).agg(F.count(F.lit(1)))
            .na.fill(0, ["positive", "negative"]))
    share = F.col("positive") / (F.col("positive") + F.col("negative") + 1)
    return wide.select(*keys, share.alias(ratio), F.col("positive").alias(positive),
                       F.col("negative").alias(negative))


def share_in_group(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Each row's share of its group total. Totals are summed apart, written, so that their size is
    known, and joined back; a hot group is never gathered, nor the rows shuffled on it."""
    totals = cut_lineage(df.groupBy(*keys).agg(F.sum(value).alias("_total")), "totals")
    return (with_group_value(df, totals, keys)
            .withColumn(out, F.col(value) / F.col("_total")).drop("_total"))


def mean_and_sd(df: DataFrame, keys: list[str], value: str, mean: str, sd: str, aggs: list[Column] = ()) -> DataFrame:
    """Mean and sample deviation, and further aggregates; one value alone has no deviation."""
    return df.groupBy(*keys).agg(F.avg(value).alias(mean), F.stddev_samp(value).alias(sd), *aggs)

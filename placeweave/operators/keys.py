"""Incremental work on keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave import fixed
from placeweave.operators.joins import missing_keys, with_group_value
from placeweave.session import cut_lineage


def todo_keys(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys still to do."""
    return missing_keys(expected, done, key)


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of keys the new batch does not touch, then the new batch."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def full_keys(rows: DataFrame, key: str, at_least: int) -> DataFrame:
    """Keys that hold ``at_least`` rows or more."""
    return rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= at_least).select(key)


def drop_full_keys(rows: DataFrame, key: str, at_least: int) -> DataFrame:
    """The rows without full keys, so that these are collected anew."""
    return rows.join(cut_lineage(full_keys(rows, key, at_least), "full"), key, "left_anti")


def nest_by_key(df: DataFrame, keys: list[str], item: str, order: str, fields: list[str], out: str = "posts",
                per_document: int = 10_000, document_bytes: int = 16 << 20) -> DataFrame:
    """Rows of a key as one document holding an ordered array, or as several when the key is large.

    A key is dealt out by a hash of the row, so no array grows with the largest key, also where items lack an id or
    share one: over one heap for each ``per_document`` rows, or each half of ``document_bytes`` if these are more. A
    heap is then cut in order where its running size passes ``document_bytes``, so a document holds at most
    that and one row, however long the rows and however many are equal. ``part`` numbers a key's documents; reading them back and exploding gives the
    rows again."""
    size = F.octet_length(F.to_json(F.struct(*fields))).cast("long")
    rows = df.withColumn("_size", size)
    heaps = F.greatest(F.ceil(F.count("*") / per_document), F.ceil(2 * F.sum("_size") / document_bytes))
    sizes = cut_lineage(rows.groupBy(*keys).agg(heaps.cast("int").alias("_heaps")), "sizes")
    heap = F.pmod(F.xxhash64(item, order, *fields), F.col("_heaps")).cast("int")
    dealt = with_group_value(rows, sizes, keys).withColumn("_heap", heap)
    in_order = Window.partitionBy(*keys, "_heap").orderBy(order, *fields)
    before = F.coalesce(F.sum("_size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.col("_heap") + F.col("_heaps") * F.floor(before / document_bytes).cast("int")
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("_f"))))
    return (dealt.withColumn("part", part).groupBy(*keys, "_heap", "part").agg(F.transform(items, lambda r: r["_f"]).alias(out))
            .drop("_heap"))


def collection_log(stored: DataFrame, name: str, n: Column, sources: Column, existed: Column) -> DataFrame:
    """Per key: name, rows, sources as one string, and whether the key was there before."""
    return stored.select(
        "slug", F.col(name).alias("name"), n.cast("long").alias("post_count"), sources.alias("sources"),
        F.when(existed, fixed.STATUS_SKIPPED).otherwise(fixed.STATUS_COLLECTED).alias("status"))

"""Joins onto dimensions and between tables.

No join here carries a broadcast hint. Catalyst broadcasts a side when its own size
estimate is under ``spark.sql.autoBroadcastJoinThreshold``, AQE does so when the measured
size is, and beyond that the same join shuffles with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.session import cut_lineage


def same_keys(keys: list[str], left: str, right: str) -> Column:
    """Equality of aliased sides on all keys, NULL matching NULL as it does in a grouping."""
    test = F.col(f"{left}.{keys[0]}").eqNullSafe(F.col(f"{right}.{keys[0]}"))
    for k in keys[1:]:
        test = test & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return test


def with_group_value(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Rows joined to one row per group that was aggregated from them."""
    extra = [F.col(f"g.{c}") for c in groups.columns if c not in keys]
    return df.alias("r").join(groups.alias("g"), same_keys(keys, "r", "g"), how).select("r.*", *extra)


def complete_spine(spine: DataFrame, facts: DataFrame, on: list[str] | str,
                   defaults: dict | None = None) -> DataFrame:
    """Every spine row once, facts where present, gaps filled from ``defaults``."""
    joined = spine.join(facts, on, "left")
    for name, value in (defaults or {}).items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return joined


def chain_left(spine: DataFrame, parts: list[DataFrame | None], on: list[str] | str) -> DataFrame:
    """Spine left-joined to each part that is there."""
    for part in parts:
        if part is not None:
            spine = spine.join(part, on, "left")
    return spine


def missing_keys(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys that should be there and are not."""
    return expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame | list, key: str, negate: bool = False) -> DataFrame:
    """Rows whose key is (not) in a list or table."""
    if isinstance(keys, list):
        test = F.col(key).isin(keys)
        return df.filter(~test if negate else test)
    return df.join(keys.select(key).distinct(), key, "left_anti" if negate else "left_semi")


def fallback_rows(df: DataFrame, keys: list[str], is_primary: Column, is_fallback: Column,
                  at_least: int) -> DataFrame:
    """Drop fallback rows of every key that has ``at_least`` primary rows.

    Counts combine in the map tasks. The keys that must lose rows are written first, so that their size is known:
    a few are broadcast and the fallback rows stay where they are."""
    served = cut_lineage(df.filter(is_primary).groupBy(*keys).agg(F.count("*").alias("_n"))
                         .filter(F.col("_n") >= at_least).select(*keys), "served")
    rest = df.filter(F.coalesce(~is_fallback, F.lit(True)))
    return rest.unionByName(df.filter(is_fallback).join(served, keys, "left_anti"))


def union_layers(layers: dict[str, DataFrame], origin: str = "lexicon") -> DataFrame:
    """Tables stacked by column name, each row tagged with where it came from."""
    out = None
    for name, df in layers.items():
        tagged = df.withColumn(origin, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def merged_words(*tables: DataFrame | None) -> DataFrame:
    """Distinct words over several word tables."""
    out = None
    for table in tables:
        if table is not None:
            out = table.select("word") if out is None else out.unionByName(table.select("word"))
    return out.distinct()

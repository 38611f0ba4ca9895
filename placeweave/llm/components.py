"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.session import cut_lineage


def _lowest(edges: DataFrame, label: str) -> DataFrame:
    """Per node its smallest neighbour. Written, so that the join on it has two plain exchanges,
    of which Spark can split the one that holds a hub."""
    return cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")), label)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row (node, root) per node that has a link to another; root is the component's smallest node,
    which has a row too.

    Nodes are any ordered values. A large star ties the neighbours above a node to its
    smallest neighbour, a small star those below it; after a logarithmic number of rounds
    every node hangs directly on its root. Only two numbers per round reach the driver.
    Links of a node to itself and with a NULL end are ignored; no links give no rows."""
    now = cut_lineage(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, "star")
        large = cut_lineage(
            both.filter(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "star")
        low = _lowest(large, "star")
        tied = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)

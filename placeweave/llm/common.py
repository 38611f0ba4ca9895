"""What the corpus operators share: word rules, row identity, order numbers and row removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.session import cut_lineage

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str) -> Column:
    """A text, NULL read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of all keys, NULL equal to NULL."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", merge: bool = False) -> DataFrame:
    """A join on keys where NULL equals NULL; the right side's keys are dropped.

    ``merge`` asks for a sort-merge join: for lists that grow with the table, so that the plan that
    a large table needs is the one that every table gets."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    out = left.join(renamed.hint("merge") if merge else renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def without_rows(docs: DataFrame, id_col: str, signature: Column, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows named in ``dropped`` and with one of each row named in ``repeated``.

    A row is named by its id and a 128-bit signature of its content (columns doc_id and sig).
    The lists grow with the table, so they are anti-joined by sorting and never broadcast. All columns of docs survive, whatever their names."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("doc_id"), signature.alias("sig"))
    repeated = repeated.select("doc_id", "sig")
    gone = dropped.select("doc_id", "sig").unionByName(repeated)
    kept = joined(rows, gone, ["doc_id", "sig"], "left_anti", merge=True)
    if not repeated.isEmpty():
        kept = kept.unionByName(joined(rows, repeated, ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id", "sig"]))
    return kept.select("_row.*")


def numbered(df: DataFrame, order: str | Column, out: str, label: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 in the order of a unique column.

    The rows are dealt out by range and written once, so the numbers stand on fixed parts;
    each part is numbered by itself and starts where the parts before it end."""
    parts = cut_lineage(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), label)
    ahead = (parts.groupBy("_part").agg(F.count("*").alias("_n"))
             .withColumn("_ahead", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return (parts.withColumn("_i", inside).join(ahead, "_part")
            .withColumn(out, F.col("_ahead") + F.col("_i") - 1).drop("_part", "_ahead", "_i"))


def merged_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (start, end), end excluded, of each key, merged where they touch: one row per key with ``spans`` in order.

    The spans of a key are those of one document, so its length bounds them."""
    by_start = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    isles = rows.withColumn("_fresh", fresh).withColumn("_isle", F.sum("_fresh").over(by_start))
    merged = isles.groupBy(*keys, "_isle").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def later_occurrences(spans: DataFrame, repeated: DataFrame) -> DataFrame:
    """Spans of a repeated hash (h1, h2) after its first place, by id (NULL last), mark and start.

    ``repeated`` holds one row per hash with the first place; it is a written table, so that Spark
    can split the rows of a hash that fills a large part of the spans."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start")
    return spans.join(repeated, ["h1", "h2"]).filter(place > F.col("first")).select("doc_id", "mark", "start", "end").distinct()


def first_places(spans: DataFrame) -> DataFrame:
    """Per hash (h1, h2) met in more than one place its first place; places fold in the map tasks."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start")
    ends = spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return ends.filter(F.col("first") < F.col("last")).select("h1", "h2", "first")

"""CSV and stage tables."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placeweave.functions.cleaning import to_int, to_number
from placeweave.session import path_exists


def _struct(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _typed(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        return to_number(c).cast(kind)
    if kind == "int":
        return to_int(c)
    return c if kind == "string" else c.try_cast(kind)


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether a field may hold a line break. A field that goes over a line's end leaves an odd number of quotes in
    the line it starts in, so lines with even numbers only are records of their own. Stray quotes count as odd too."""
    if path.endswith(".gz"):
        return True  # one task in any case
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str | list[str], schema: str | StructType,
             quoted_newlines: bool | None = None, partitions: int | None = None) -> DataFrame:
    """Declared columns of a CSV with a header, matched by name; empty and ``NA`` are NULL,
    a value that does not fit its type is NULL, a column the file lacks is NULL.

    Each path has the header of its own files, so paths with other columns or another order go
    in a list. Files under one path must agree: a differing header there fails the read.

    Line breaks inside fields and gzip both make a file one task. Unless ``quoted_newlines`` says whether
    there are any, a first pass over the lines finds out, and files without them are read in splits. ``partitions``
    spreads the rows after the read."""
    if not isinstance(path, str):
        parts = [read_csv(spark, p, schema, quoted_newlines, partitions) for p in path]
        return reduce(DataFrame.unionByName, parts) if parts else empty(spark, schema)
    if quoted_newlines is None:
        quoted_newlines = has_quoted_newlines(spark, path)
    raw = (spark.read.option("header", True).option("enforceSchema", False).option("nullValue", "NA").option("escape", '"')
           .option("multiLine", quoted_newlines).option("ignoreLeadingWhiteSpace", True)
           .option("ignoreTrailingWhiteSpace", True).csv(path))
    if partitions:
        raw = raw.repartition(partitions)
    present = set(raw.columns)
    return raw.select(*[
        (_typed(f.name, f.dataType.simpleString()) if f.name in present
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in _struct(schema).fields])


def read_snapshots(spark: SparkSession, paths: dict[str, str], schema: str, **options) -> DataFrame:
    """Several dated copies of one CSV, stacked, each row tagged with its date; no copies, no rows."""
    if not paths:
        return empty(spark, schema).withColumn("snapshot_date", F.lit(None).cast("string"))
    out = None
    for date, path in sorted(paths.items()):
        df = read_csv(spark, path, schema, **options).withColumn("snapshot_date", F.lit(date))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def small_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A literal table. Built from Arrow it becomes a local relation, whose size Catalyst
    knows, so that it may be broadcast; one built from Python rows would count as huge."""
    return spark.createDataFrame(pa.table(columns))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: its folder holds the mark that Spark's writers leave last."""
    return path_exists(spark, f"{path}/_SUCCESS")


def read_optional(spark: SparkSession, path: str | None, schema: str | None = None) -> DataFrame | None:
    """A stage table if it is there; else an empty typed one, or None without a schema."""
    if path and table_exists(spark, path):
        return spark.read.parquet(path)
    return empty(spark, schema) if schema else None


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] = ()) -> None:
    """One Parquet dataset; ``mode="ignore"`` leaves a finished one alone."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bundle(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Tables that belong together, one dataset each under a common folder."""
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", mode)

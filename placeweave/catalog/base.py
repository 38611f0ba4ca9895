"""Registration and table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placeweave.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    """Register a query, under its function name unless told otherwise, with the SQL it must agree with."""
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        ORACLES[name or fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table about to be worked on hard row by row: spread over the cores if it is one small file."""
    return spread(table(spark, sf_dir, name), key)


def sql_rules(column: str, rules: list[tuple[str, str]], default: str) -> str:
    """The ordered rules as a SQL CASE."""
    cases = " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{label}'" for label, p in rules)
    return f"CASE {cases} ELSE '{default}' END"


def sql_words(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def sql_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)

"""Data checks as one pass over a table, one result row per check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from placeweave.sources.tables import small_table

FAIL, WARN = "fail", "warn"


@dataclass(frozen=True)
class Check:
    """``measure`` is an aggregate; the check passes when it equals ``expected``."""

    name: str
    measure: Column
    expected: int = 0
    severity: str = FAIL


def row_count(expected: int, name: str = "row_count") -> Check:
    return Check(name, F.count("*"), expected)


def no_nulls(column: str, severity: str = FAIL) -> Check:
    return Check(f"no_null_{column}", F.count_if(F.col(column).isNull()), 0, severity)


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Columns: check, severity, expected, observed, passed."""
    one = df.agg(*[c.measure.cast("long").alias(f"m{i}") for i, c in enumerate(checks)])
    rows = [F.struct(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"),
                     F.lit(c.expected).cast("long").alias("expected"), F.col(f"m{i}").alias("observed"),
                     F.col(f"m{i}").eqNullSafe(F.lit(c.expected).cast("long")).alias("passed")) for i, c in enumerate(checks)]
    return one.select(F.inline(F.array(*rows)))


class CheckFailed(ValueError):
    pass


def enforce(results: DataFrame) -> list:
    """Raise on a failed check, return the warnings. Reads one row per check."""
    bad = results.filter(~F.col("passed")).collect()
    failed = [r for r in bad if r.severity == FAIL]
    if failed:
        raise CheckFailed("; ".join(f"{r.check}: expected {r.expected}, got {r.observed}" for r in failed))
    return bad


def observed(df: DataFrame, stage: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """Row accounting that rides along with whatever action runs the frame."""
    watch = Observation(stage)
    return df.observe(watch, *[m.alias(k) for k, m in measures.items()]), watch


class Accounting:
    """How many rows the steps of a stage handle, counted by whatever action runs them.

    A step counted here has to run once, and be read by a job at all, before ``table`` is asked for."""

    def __init__(self, stage: str):
        self.stage, self.watches = stage, []

    def count(self, df: DataFrame, step: str) -> DataFrame:
        df, watch = observed(df, f"{self.stage} {step}", n=F.count(F.lit(1)))
        self.watches.append((step, watch))
        return df

    def table(self, spark: SparkSession) -> DataFrame:
        """Columns: stage, step, rows; one row per step, in the order of the steps."""
        return small_table(spark, stage=[self.stage] * len(self.watches), step=[s for s, _ in self.watches],
                           rows=[w.get["n"] for _, w in self.watches])

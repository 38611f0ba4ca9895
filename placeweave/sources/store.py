"""A table kept by key, of which a change writes only what it touches.

Rows lie in a fixed number of buckets by a hash of their key. A change reads the buckets of its keys, writes
them anew under a version of its own and then adds a commit: a small table that names, for each bucket, the
version that holds it. Readers follow the last finished commit, so buckets that were not touched keep
their files, a change that broke off is never seen, and an earlier state stays readable.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.operators.joins import same_keys
from placeweave.session import cut_lineage, folder_names, path_exists
from placeweave.sources.tables import empty, small_table

_BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedStore:
    """``schema`` as DDL; ``order`` sorts the rows of a key. A bucket's files are sorted by key and carry a
    Bloom filter of it, so that reading one key opens few row groups; a bucket with a hot key becomes several files."""

    spark: SparkSession
    root: str
    schema: str
    key: str
    buckets: int = 64
    order: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)

    def commits(self) -> list[int]:
        """Numbers of the finished commits."""
        found = [int(n) for n in folder_names(self.spark, f"{self.root}/commits") if n.isdigit()]
        return sorted(n for n in found if path_exists(self.spark, f"{self.root}/commits/{n}/_SUCCESS"))

    def state(self, commit: int | None = None) -> dict[int, str]:
        """The version that holds each bucket; by default after the last commit. One entry per bucket reaches the driver."""
        done = self.commits()
        if commit is None and not done:
            return {}
        number = done[-1] if commit is None else commit
        if number not in done:
            raise ValueError(f"no commit {number}")
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.root}/commits/{number}").collect()}

    def _bucket_of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict[int, str], buckets: list[int] | None = None) -> DataFrame:
        chosen = sorted(state) if buckets is None else [b for b in buckets if b in state]
        paths = [f"{self.root}/data/{state[b]}/{_BUCKET}={b}" for b in chosen]
        nothing = empty(self.spark, self.schema)
        return self.spark.read.schema(nothing.schema).parquet(*paths) if paths else nothing

    def read(self, keys: list | None = None, commit: int | None = None) -> DataFrame:
        """The rows, of some keys or all, after the last or an earlier commit. Only the buckets of the keys are opened."""
        if keys is None:
            return self._rows(self.state(commit))
        kind = empty(self.spark, self.schema).schema[self.key].dataType
        asked = small_table(self.spark, k=keys).select(F.col("k").cast(kind).alias(self.key)) if keys else empty(self.spark, self.schema)
        buckets = sorted({r.b for r in asked.select(self._bucket_of(self.key).alias("b")).collect()})
        known = [k for k in keys if k is not None]
        test = F.col(self.key).isin(known) if len(known) == len(keys) else F.col(self.key).isin(known) | F.col(self.key).isNull()
        return self._rows(self.state(commit), buckets).filter(test)

    def replace(self, new: DataFrame) -> int:
        """Rows of the keys in ``new`` become those of ``new``; columns that it lacks are NULL. The commit's number."""
        new = cut_lineage(empty(self.spark, self.schema).unionByName(new, allowMissingColumns=True), "new")
        return self._change(new.select(self.key).distinct(), new)

    def remove(self, keys: DataFrame) -> int:
        """Drops the rows of keys. The commit's number."""
        return self._change(cut_lineage(keys.select(self.key).distinct(), "keys"), None)

    def _change(self, keys: DataFrame, new: DataFrame | None) -> int:
        before, done = self.state(), self.commits()
        number = done[-1] + 1 if done else 0
        touched = sorted(r.b for r in keys.select(self._bucket_of(self.key).alias("b")).distinct().collect())
        rows = self._rows(before, touched).alias("r").join(keys.alias("g"), same_keys([self.key], "r", "g"), "left_anti")
        rows = rows if new is None else rows.unionByName(new)
        version = f"{number:08d}-{uuid.uuid4().hex}"
        self._write(rows, f"{self.root}/data/{version}")
        held = {int(n.removeprefix(f"{_BUCKET}=")) for n in folder_names(self.spark, f"{self.root}/data/{version}") if n.startswith(_BUCKET)}
        after = {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(held, version)
        commit = small_table(self.spark, bucket=list(after), version=list(after.values())) if after else empty(
            self.spark, "bucket bigint, version string")
        commit.coalesce(1).write.mode("error").parquet(f"{self.root}/commits/{number}")  # a second writer of this number fails
        return number

    def _write(self, rows: DataFrame, path: str) -> None:
        dealt = rows.withColumn(_BUCKET, self._bucket_of(self.key)).hint("rebalance", F.col(_BUCKET))
        writer = dealt.sortWithinPartitions(_BUCKET, self.key, *self.order).write.partitionBy(_BUCKET)
        writer.options(**{f"parquet.bloom.filter.enabled#{self.key}": "true", **self.options}).parquet(path)

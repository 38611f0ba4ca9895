"""Top-n and first-row-per-key, safe when one key holds a large share of the rows.

``row_number() <= n`` plans as a limit inside every map task before the shuffle, so a
hot key sends at most n rows per task. Where n itself is large the caller asks for ``salts``:
the cut is then made twice, first on a salted key, because a top-n of top-n parts is the
top-n of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave import fixed

SALTS = 64


def _asc(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None,
          ties: bool = False, salts: int = 0) -> DataFrame:
    """The first n rows of each key. ``order`` should end in a unique column, or the choice
    between equal rows is open; ``ties=True`` keeps every row equal to the n-th.
    ``salts`` splits every key in so many parts by the order columns given by name; the result is
    the same."""
    salt_on = [c for c in order if isinstance(c, str)]
    order = [_asc(c) for c in order]
    number = F.rank() if ties else F.row_number()
    out = rank or "_rank"
    if salts and keys:
        salt = F.pmod(F.xxhash64(*salt_on), F.lit(salts))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", salt).withColumn("_part", number.over(part))
              .filter(F.col("_part") <= n).drop("_part", "_salt"))
    df = df.withColumn(out, number.over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= n)
    return df if rank else df.drop(out)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_n(df, keys, order, 1)


def latest_per_key(df: DataFrame, keys: list[str], by: str, tiebreak: list = ()) -> DataFrame:
    """One row per key from the newest snapshot."""
    return first_per_key(df, keys, [F.desc(by), *tiebreak])


def earliest_per_key(df: DataFrame, keys: list[str], by: str, tiebreak: list = ()) -> DataFrame:
    """One row per key from the oldest snapshot."""
    return first_per_key(df, keys, [F.asc(by), *tiebreak])


def cap_per_source(df: DataFrame, keys: list[str], position: str,
                   cap: int | None = None) -> DataFrame:
    """At most ``cap`` rows of each source, in collection order; all without a cap."""
    return df if cap is None else top_n(df, keys, [position], cap, salts=SALTS)


def priority_dedup(df: DataFrame, keys: list[str], item: str, priority: list) -> DataFrame:
    """One row per item within its key, the first in source priority; items without an id go."""
    kept = df.filter(F.col(item).isNotNull() & (F.col(item).cast("string") != ""))
    return first_per_key(kept, [*keys, item], priority)


def global_top(df: DataFrame, by: str, n: int, tiebreak: list = ()) -> DataFrame:
    """The n largest rows of the whole table, from a heap in every task."""
    return df.orderBy(F.desc(by), *tiebreak).limit(n)


def global_top_ties(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n largest rows and every row equal to the n-th: a heap finds the n-th value, a
    filter keeps what reaches it, and nothing is ranked in one place. NULLs come last and tie
    with one another, so all of them stay where there are fewer than n values."""
    best = df.select(by).orderBy(F.desc_nulls_last(by)).limit(n)
    found = best.agg(F.min(by).alias("edge"), F.count(by).alias("values"))
    edge, open_end = found.select("edge").scalar(), found.select(F.col("values") < n).scalar()
    return df.filter((F.col(by) >= edge) | (F.col(by).isNull() & open_end) & (F.lit(n) > 0))


def ordered_join(df: DataFrame, keys: list[str], word: str, rank: str, out: str, separator: str) -> DataFrame:
    """Words of a key in rank order as one string. For rows already cut to a few per key."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(rank), F.col(word))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p[word]), separator).alias(out))

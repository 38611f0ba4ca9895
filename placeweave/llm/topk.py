"""Exact top-k by inner product with the threshold algorithm.

Vectors are dealt to blocks and queries to batches. Where a block meets a batch, each dimension of the
block is a list sorted by value. A query reads its lists in step, from the end that its sign
prefers; a vector met for the first time is scored in full. The values just read bound what an unseen vector can
score, and reading stops once the k-th best score found is above the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from placeweave.session import cut_lineage

#: Vectors in a block, queries in a batch, and list entries read at first in each dimension.
BLOCK, BATCH, FIRST_DEPTH = 8192, 1024, 8


class Lists:
    """The vectors of a block and, per dimension, their order by value."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.vectors = rows[by_id], ids[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def top(self, row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to the smaller id, without the query's own row."""
        n = len(self.ids)
        seen = self.rows == row
        left = n - int(seen.sum())
        used = np.nonzero(query)[0]
        falling = query[used] > 0
        best, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=query.dtype)
        depth, step = 0, FIRST_DEPTH
        while left:
            stop = min(n, depth + step)
            if len(used):
                at = np.arange(depth, stop)[:, None]
                read = self.order[np.where(falling, n - 1 - at, at), used].ravel()
                fresh = np.zeros(n, dtype=bool)
                fresh[read] = True
                fresh &= ~seen
            else:
                fresh = ~seen
            new = np.nonzero(fresh)[0]
            seen |= fresh
            left -= len(new)
            best, scores = np.concatenate([best, new]), np.concatenate([scores, self.vectors[new] @ query])
            order = np.lexsort((best, -scores))[:k]
            best, scores = best[order], scores[order]
            depth, step = stop, 2 * step
            edge = self.values[np.where(falling, n - depth, depth - 1), used]
            if len(best) == k and scores[-1] > edge @ query[used]:
                break
        return self.ids[best], scores


def _exact_type(vectors: np.ndarray, queries: np.ndarray) -> type:
    """Floats multiply faster and are exact while every sum stays below 2^53."""
    top = lambda x: int(np.abs(x).max(initial=0))
    return np.float64 if top(vectors) * top(queries) * vectors.shape[1] < 2 ** 53 else np.int64


_NAMES = ("row", "query_id", "vec_id", "score")
_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in _NAMES])


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table.column("row").to_numpy(), table.column("vec_id").to_numpy(), flat.reshape(table.num_rows, -1)


def _searcher(k: int):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if vectors.num_rows and queries.num_rows:
            (rows, ids, x), (query_rows, query_ids, q) = _matrix(vectors), _matrix(queries)
            kind = _exact_type(x, q)
            lists = Lists(rows, ids, x.astype(kind))
            for row, query_id, query in zip(query_rows, query_ids, q.astype(kind), strict=True):
                best, scores = lists.top(row, query, k)
                out.append((np.full(len(best), row), np.full(len(best), query_id), best, scores.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * len(_NAMES)
        return pa.table(dict(zip(_NAMES, columns, strict=True)))
    return search


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v) with floor(scale * x) of each component; rows that take no part are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = rows.filter(F.col(id_col).isNotNull() & x.isNotNull() & finite & (F.size(x) > 0))
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: the k best other vectors of each query, ties to the smaller id.

    ``is_query`` is a test on ``vec_id``. Vectors that are NULL or empty, or hold NULL or a component that is not finite, and rows without
    an id take no part. Rows that share an id are vectors of their own, each a query of its own too, and find one another. Vectors
    meet those of their own length only. Fewer others than k give fewer rows; a query without others and an empty table give none. Scores must fit a long.

    Blocks and batches have bounded size whatever the input's; each part keeps k rows per query, cut
    again in the map tasks before the last ranking."""
    vectors = whole_vectors(rows, id_col, vector_col).withColumn("d", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    vectors = cut_lineage(vectors, "vectors")  # the numbers of rows stand on written parts
    queries = vectors.filter(is_query)
    n = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, batches = max(1, -(-n.n // block)), max(1, -(-n.q // batch))

    def dealt(count: int, salt: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(count)).cast("int")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    key = ["d", "block", "batch"]
    left = vectors.select("d", dealt(blocks, "block").alias("block"), each(batches).alias("batch"), "row", "vec_id", "v")
    right = queries.select("d", dealt(batches, "batch").alias("batch"), each(blocks).alias("block"), "row", "vec_id", "v")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searcher(k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

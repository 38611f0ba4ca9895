"""Near duplicates among vectors by a pivot-permutation index.

A bounded sample of the vectors, no two of them near each other, are reference points, the pivots. Each distinct vector is described by its nearest
pivots in order, the head of its permutation, and stands in the inverted list of each of them. Two vectors are
candidates where their heads share enough pivots, which bit signatures of the heads count from above;
candidates are verified by their cosine. Lists are cut into blocks of bounded size, ordered so that
neighbours have their earlier pivots in common; pairs of blocks that share an earlier pivot are pruned whole, as
the list of that pivot has the pair already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.llm.components import connected_components
from placeweave.session import cut_lineage

COSINE = 0.9
#: Pivots in a head, and how many of them two vectors share to be candidates.
HEAD, SHARED = 10, 2
#: Pivots grow with the root of the number of vectors, within bounds.
PIVOTS_PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 4, 32, 1 << 15
#: Vectors of a list that form a block, and of a tile inside a pair of blocks.
BLOCK, TILE = 2048, 512
_CELLS, _TRIED = 1 << 22, 256


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors that can link, as doubles; v is NULL where a vector is NULL, empty, zero or holds NULL or a
    component that is not finite, or where its squares do not add up to a positive finite number."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    square = F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c)
    fits = x.isNotNull() & whole & (square > 0) & (square < float("inf"))
    return rows.select(F.col(id_col).alias("vec_id"), F.when(F.coalesce(fits, F.lit(False)), F.transform(x, lambda c: c + 0.0)).alias("v"))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def apart(unit: np.ndarray, cosine: float) -> np.ndarray:
    """Places of vectors of which no two reach ``cosine``, the earlier first. Without this a dense group would have so many
    pivots that two of its vectors share none."""
    kept: list[int] = []
    for lo in range(0, len(unit), _TRIED):
        some = unit[lo:lo + _TRIED]
        free = ~(some @ unit[kept].T >= cosine).any(axis=1)
        near = some @ some.T >= cosine
        for i in range(len(some)):
            if free[i]:
                kept.append(lo + i)
                free &= ~near[i]
    return np.array(kept, dtype=np.int64)


def heads(unit: np.ndarray, pivots: np.ndarray, size: int) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, the nearest first, ties to the smaller number."""
    out = np.empty((len(unit), min(size, len(pivots))), dtype=np.int32)
    step = max(1, _CELLS // len(pivots))
    for lo in range(0, len(unit), step):
        near = -(unit[lo:lo + step] @ pivots.T)
        width = out.shape[1]
        edge = np.partition(near, width - 1, axis=1)[:, width - 1:width] if width < len(pivots) else near.max(axis=1)[:, None]
        inside = np.where(near <= edge, near, np.inf)
        out[lo:lo + step] = np.argsort(inside, axis=1, kind="stable")[:, :width]
    return out


def _describer(pivots, size: int, shared: int, kind: str):
    """Entries of the inverted lists; ``kind`` holds a component without loss. A head is kept in falling order
    of numbers; two heads that share ``shared`` pivots share one of the first ``size - shared + 1`` of this
    order, so an entry in the lists of those is enough."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = {d: units(p) for d, p in pivots.value.items()}
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                some = batch.take(pa.array(np.nonzero(dims == d)[0]))
                flat = some.column(1).flatten().to_numpy(zero_copy_only=False)
                vectors = flat.reshape(len(some), -1)
                head = -np.sort(-heads(units(vectors), points[d], size), axis=1)
                lists = max(1, head.shape[1] - shared + 1)
                rows = np.repeat(np.arange(len(some)), lists)
                ahead = np.repeat(head, lists, axis=0)
                place = np.tile(np.arange(lists), len(some))
                columns = [
                    pa.array(np.full(len(rows), d), pa.int32()), pa.array(ahead[np.arange(len(rows)), place], pa.int32()),
                    pa.array([row[:p].astype(">i4").tobytes() for row, p in zip(ahead, place, strict=True)], pa.binary()),
                    some.column(0).take(pa.array(rows)), some.column(2).take(pa.array(rows)),
                    pa.array([row.tobytes() for row in ahead], pa.binary()),
                    pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary()).take(pa.array(rows))]
                yield pa.RecordBatch.from_arrays(columns, ["d", "pivot", "ahead", "cls", "n", "head", "v"])
    return describe


_ENTRIES = "d int, pivot int, ahead binary, cls long, n long, head binary, v binary"
_BLOCKS = "part int, i long, d int, pivot int, common array<int>, n int, cls binary, counts binary, heads binary, vectors binary"


def _block(part: int, i: int, rows: pa.Table) -> pa.RecordBatch:
    """One block: its vectors, and the earlier pivots that all of them have."""
    ahead = [set(np.frombuffer(a, dtype=">i4").tolist()) for a in set(rows.column("ahead").to_pylist())]
    cells = [[part], [i], rows.column("d")[:1].to_pylist(), rows.column("pivot")[:1].to_pylist(), [sorted(set.intersection(*ahead))],
             [rows.num_rows], [rows.column("cls").to_numpy().tobytes()], [rows.column("n").to_numpy().tobytes()],
             [b"".join(rows.column("head").to_pylist())], [b"".join(rows.column("v").to_pylist())]]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), *[pa.binary()] * 4]
    names = ["part", "i", "d", "pivot", "common", "n", "cls", "counts", "heads", "vectors"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names)


def _cut_blocks(size: int):
    """Runs of at most ``size`` entries of one list out of a sorted partition."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, left = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            left = table if left is None else pa.concat_tables([left, table])
            keys = left.column("pivot").to_numpy().astype(np.int64) | left.column("d").to_numpy().astype(np.int64) << 32
            ends = [*(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
            lo = 0
            for end in ends:
                while end - lo >= size or (lo < end < len(keys)):
                    stop = min(end, lo + size)
                    yield _block(part, i, left.slice(lo, stop - lo))
                    lo, i = stop, i + 1
            left = left.slice(lo).combine_chunks()
        if left is not None and left.num_rows:
            yield _block(part, i, left)
    return cut


class _Tile:
    """Some vectors of a block."""

    def __init__(self, block: dict, lo: int, hi: int):
        self.cls, self.n, self.heads, self.units = (block[k][lo:hi] for k in ("cls", "counts", "heads", "units"))
        bits = np.uint64(1) << (self.heads % 64).astype(np.uint64)
        self.signs = np.bitwise_or.reduce(bits, axis=1)
        self.lost = (self.heads.shape[1] - np.bitwise_count(self.signs)).astype(np.int64)


def _unpacked(row: dict, kind: str) -> dict:
    n = row["n"]
    return {"cls": np.frombuffer(row["cls"], dtype=np.int64), "counts": np.frombuffer(row["counts"], dtype=np.int64),
            "heads": np.frombuffer(row["heads"], dtype=np.int32).reshape(n, -1),
            "units": units(np.frombuffer(row["vectors"], dtype=kind).reshape(n, -1).astype(np.float64))}


def _owned(a: _Tile, b: _Tile, i: np.ndarray, j: np.ndarray, pivot: int) -> np.ndarray:
    """Whether ``pivot`` is the first that both heads hold, so that each pair is counted in one list only."""
    out = np.empty(len(i), dtype=bool)
    step = max(1, _CELLS // max(1, a.heads.shape[1] ** 2))
    for lo in range(0, len(i), step):
        x, y = a.heads[i[lo:lo + step]], b.heads[j[lo:lo + step]]
        both = (x[:, :, None] == y[:, None, :]).any(axis=2)
        out[lo:lo + step] = x[np.arange(len(x)), both.argmax(axis=1)] == pivot
    return out


def _linked(a: _Tile, b: _Tile, same: bool, cosine: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the verified pairs of two tiles."""
    width = min(shared, a.heads.shape[1])
    count = np.bitwise_count(a.signs[:, None] & b.signs[None, :]) + np.minimum(a.lost[:, None], b.lost[None, :])
    maybe = count >= width
    if same:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    if len(i) * 8 > maybe.size:
        near = (a.units @ b.units.T)[i, j] >= cosine
    else:
        near = np.einsum("ij,ij->i", a.units[i], b.units[j]) >= cosine
    return i[near], j[near]


def _comparer(cosine: float, shared: int, tile: int, kind: str):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                cells = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                one = _unpacked({k[2:]: v for k, v in cells.items() if k.startswith("a_")}, kind)
                two = _unpacked({k[2:]: v for k, v in cells.items() if k.startswith("b_")}, kind)
                yield _compared(one, two, cells["same"], cells["pivot"], cosine, shared, tile)
    return compare


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Puts the ends of links under one smallest label, in place."""
    while len(i):
        i, j = label[i], label[j]
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
        while not np.array_equal(below := label[label], label):
            label[:] = below


def _compared(one: dict, two: dict, same: bool, pivot: int, cosine: float, shared: int, tile: int) -> pa.RecordBatch:
    """Per vector the number of its links in a pair of blocks (b is NULL), and links that span what hangs together."""
    na, nb = len(one["cls"]), len(two["cls"])
    links_a, links_b = np.zeros(na, dtype=np.int64), np.zeros(nb, dtype=np.int64)
    label = np.arange(na + (0 if same else nb))
    tiles_b = [(lo, _Tile(two, lo, lo + tile)) for lo in range(0, nb, tile)]
    for lo in range(0, na, tile):
        a = _Tile(one, lo, lo + tile)
        for at, b in tiles_b:
            if same and at < lo:
                continue
            i, j = _linked(a, b, same and at == lo, cosine, shared)
            mine = _owned(a, b, i, j, pivot)
            i, j = i[mine], j[mine]
            links_a[lo:lo + tile] += np.bincount(i, weights=b.n[j], minlength=len(a.cls)).astype(np.int64)
            links_b[at:at + tile] += np.bincount(j, weights=a.n[i], minlength=len(b.cls)).astype(np.int64)
            _forest(label, lo + i, (at if same else na + at) + j)
    ids = one["cls"] if same else np.concatenate([one["cls"], two["cls"]])
    links = links_a + links_b if same else np.concatenate([links_a, links_b])
    tied, has = np.nonzero(label != np.arange(len(label)))[0], np.nonzero(links)[0]
    a = np.concatenate([ids[has], ids[tied]])
    b = pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(ids[label[tied]], pa.int64())])
    counts = np.concatenate([links[has], np.zeros(len(tied), dtype=np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(counts, pa.int64())], ["a", "b", "n"])


def class_links(classes: DataFrame, cosine: float = COSINE, head: int = HEAD, shared: int = SHARED,
                pivots: int | None = None, block: int = BLOCK, tile: int = TILE, kind: str = "<f8") -> DataFrame:
    """Rows (a, b, n) over a written table of classes (cls, v, n, d): with b NULL the links that a got in one pair of blocks,
    each counted as often as its other end has copies, else a link; the links connect all that links connect.

    The pivots are the vectors with the smallest hashes, four times the root of the number of classes (32 to
    32,768) for each vector length, without those that reach ``cosine`` with an earlier one; every vector is indexed. Heads are numbered so that each
    pair meets in the lists of the first pivots only, and counts in one of them."""
    points = {}
    for row in classes.groupBy("d").agg(F.count("*").alias("n")).collect():
        many = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, int(PIVOTS_PER_ROOT * row.n ** 0.5)))
        chosen = classes.filter(F.col("d") == row.d).orderBy(F.xxhash64("v"), "cls").limit(many).select("v").collect()
        tried = np.array([r.v for r in chosen])
        points[row.d] = tried[apart(units(tried), cosine)]
    sent = classes.sparkSession.sparkContext.broadcast(points)
    spread = classes.select("cls", "v", "n", "d").repartition(max(1, -(-classes.count() // (4 * block))))
    entries = spread.select("cls", "v", "n", "d").mapInArrow(_describer(sent, head, shared, kind), _ENTRIES)
    ordered = cut_lineage(entries, "entries").repartitionByRange("d", "pivot", "ahead", "cls").sortWithinPartitions("d", "pivot", "ahead", "cls")
    blocks = cut_lineage(ordered.mapInArrow(_cut_blocks(block), _BLOCKS), "blocks")
    place = blocks.select("part", "i", "d", "pivot", "common")
    a, b = (place.select("d", "pivot", *[F.col(c).alias(f"{side}_{c}") for c in ("part", "i", "common")]) for side in "ab")
    order = (F.col("a_part") < F.col("b_part")) | ((F.col("a_part") == F.col("b_part")) & (F.col("a_i") <= F.col("b_i")))
    pairs = a.join(b, ["d", "pivot"]).filter(order & ~F.arrays_overlap("a_common", "b_common"))
    pairs = cut_lineage(pairs.select("pivot", "a_part", "a_i", "b_part", "b_i"), "pairs")
    same = (F.col("a_part") == F.col("b_part")) & (F.col("a_i") == F.col("b_i"))
    loaded = pairs.withColumn("same", same)
    for side in "ab":
        load = blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("part", "i", "n", "cls", "counts", "heads", "vectors")])
        loaded = loaded.join(load, [f"{side}_part", f"{side}_i"])
    return loaded.mapInArrow(_comparer(cosine, shared, tile, kind), "a long, b long, n long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, **options) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors found with that cosine at least), component_id (smallest
    vec_id reachable by links, itself included), kept (vec_id = component_id).

    Vectors that are NULL, empty or zero, or hold NULL or a component that is not finite, and those whose
    squares over- or underflow a double, link with nothing and are their own component. Vectors meet those of their own length only. Equal vectors fold into a class first
    and are linked with each other; rows that repeat a vec_id are vectors of their own; a NULL id takes part, and
    a component has a NULL id only if no other is reached. An empty table gives no rows.

    Lists are cut into blocks, links of a block pair leave it as counts and a spanning forest, so that a group of near
    copies is never expanded into pairs."""
    found = cut_lineage(usable(rows, id_col, vector_col).withColumn("h", F.xxhash64("v")), "vectors")
    able = found.filter(F.col("v").isNotNull())
    grouped = able.groupBy("h", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = cut_lineage(_with_class(grouped), "classes")
    kind = "<f4" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    links = cut_lineage(class_links(classes.select("cls", "v", "n", F.size("v").alias("d")), cosine, kind=kind, **options), "links")
    totals = links.filter(F.col("b").isNull()).groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    roots = cut_lineage(connected_components(links.filter(F.col("b").isNotNull()), "a", "b"), "roots")
    sized = classes.select("cls", "h", "v", "n", "low").join(totals, "cls", "left").join(
        roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    sized = cut_lineage(sized.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1), "sized")
    lowest = cut_lineage(sized.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    done = cut_lineage(sized.join(lowest, "root").select("h", "v", "n_links", "component_id"), "done")
    linked = able.join(done, ["h", "v"]).select("vec_id", "n_links", "component_id")
    alone = found.filter(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", _same("vec_id", "component_id"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _with_class(grouped: DataFrame) -> DataFrame:
    """A number for each distinct vector, the place of its hash among all; equal hashes of different vectors are told apart."""
    rank = F.row_number().over(Window.partitionBy("h").orderBy("v")) - 1
    return grouped.withColumn("cls", F.col("h").bitwiseXOR(rank.cast("long")))

"""SimHash near-dedup over a hierarchical index in Gray order.

Distinct fingerprints are sorted by the rank their bits have in the Gray sequence, where
neighbours share most bits, and cut into blocks. A node of the index holds the bits on which
everything below it agrees (mask and pattern); upper nodes cover 32 nodes of the level below.
The index is joined with itself from the top: a pair of nodes whose common bits already differ
in more places than allowed is pruned with all that lies below. Pairs of blocks that are left are
compared inside one task, again node by node before bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from placeweave.llm.common import joined, text_of, without_rows
from placeweave.llm.components import connected_components
from placeweave.session import cut_lineage

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 3
BLOCK = 4096
LEAF = 32
FANOUT = 32

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SLICE = 1 << 16


def text_fingerprint(text: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a UTF-8 text as a signed number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < words_each:
        starts, ends = [0], [len(line)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        last = np.cumsum(lengths + 1) - 1
        starts = (last - lengths)[: len(words) - words_each + 1].tolist()
        ends = last[words_each - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _SLICE):
        spans = zip(starts[at:at + _SLICE], ends[at:at + _SLICE], strict=True)
        hashes = np.array([digest(line[i:j], HASH_SEED) for i, j in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([text_fingerprint(t) for t in texts.cast(pa.binary()).to_pylist()], type=pa.int64())


def fingerprint(text: str) -> Column:
    return _fingerprint(text_of(text))


def hex16(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def gray_rank(code: Column) -> Column:
    """Place of a code in the reflected binary sequence, ordered as a signed number."""
    rank = code
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _shared(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per run of codes the bits all agree on, and their values."""
    ones, any_ = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    mask = ~(ones ^ any_)
    return mask, ones & mask


_BLOCKS = "part int, i long, mask long, pattern long, codes binary"


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive runs of at most BLOCK codes of one sorted partition."""
    part, i, left = TaskContext.get().partitionId(), 0, np.empty(0, dtype=np.int64)

    def row(codes: np.ndarray) -> pa.RecordBatch:
        mask, pattern = _shared(codes, np.zeros(1, dtype=np.int64))
        columns = [pa.array([part], pa.int32()), pa.array([i], pa.int64()), pa.array(mask, pa.int64()),
                   pa.array(pattern, pa.int64()), pa.array([codes.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "i", "mask", "pattern", "codes"])

    for batch in batches:
        left = np.concatenate([left, batch.column(0).to_numpy(zero_copy_only=False)])
        while len(left) >= BLOCK:
            yield row(left[:BLOCK])
            left, i = left[BLOCK:], i + 1
    if len(left):
        yield row(left)


def _build_blocks(codes: DataFrame) -> DataFrame:
    """The lowest level: blocks of the Gray order with consecutive numbers ``node``."""
    ordered = (codes.select("code", gray_rank(F.col("code")).alias("rank"))
               .repartitionByRange("rank").sortWithinPartitions("rank").select("code"))
    blocks = cut_lineage(ordered.mapInArrow(_cut_blocks, _BLOCKS), "blocks")
    ahead = (blocks.groupBy("part").agg(F.count("*").alias("n"))
             .withColumn("ahead", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "ahead"))
    return blocks.join(ahead, "part").select((F.col("ahead") + F.col("i")).alias("node"), "mask", "pattern", "codes")


def _upper(nodes: DataFrame) -> DataFrame:
    """The level above: 32 nodes become one that keeps the bits on which they agree."""
    differ = F.bit_or("pattern").bitwiseXOR(F.bit_and("pattern"))
    return (nodes.groupBy(F.floor(F.col("node") / FANOUT).alias("node"))
            .agg(F.bit_and("mask").bitwiseAND(F.bitwise_not(differ)).alias("mask"), F.bit_or("pattern").alias("_any"))
            .select("node", "mask", F.col("_any").bitwiseAND(F.col("mask")).alias("pattern")))


def _near_blocks(blocks: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose common bits differ in at most max_bits places."""
    levels = [cut_lineage(blocks.select("node", "mask", "pattern"), "level")]
    while levels[-1].count() > 1:
        levels.append(cut_lineage(_upper(levels[-1]), "level"))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        up = F.floor(F.col("node") / FANOUT)
        one = level.select(up.alias("a"), F.col("node").alias("_a"), F.col("mask").alias("_ma"), F.col("pattern").alias("_pa"))
        two = level.select(up.alias("b"), F.col("node").alias("_b"), F.col("mask").alias("_mb"), F.col("pattern").alias("_pb"))
        common = F.col("_ma").bitwiseAND(F.col("_mb"))
        apart = F.bit_count(F.col("_pa").bitwiseXOR(F.col("_pb")).bitwiseAND(common))
        pairs = (pairs.join(one, "a").join(two, "b").filter((F.col("_a") <= F.col("_b")) & (apart <= max_bits))
                 .select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        pairs = cut_lineage(pairs, "pairs")
    return pairs


def _merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Puts the ends of the given links under one smallest label, in place."""
    while len(left):
        left, right = label[left], label[right]
        apart = left != right
        left, right = left[apart], right[apart]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while not np.array_equal(below := label[label], label):
            label[:] = below


def block_links(a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks (or within one, given twice): code pairs.

    Leaves of 32 codes are pruned by their shared bits first. Links are folded into labels piece
    by piece, so a block of near copies yields as many rows as it has codes, not all its pairs."""
    codes, mine = np.concatenate([a, b]), len(a)
    a, b = a.view(np.uint64), b.view(np.uint64)  # bits of signed numbers are counted by absolute value
    starts_a, starts_b = np.arange(0, len(a), LEAF), np.arange(0, len(b), LEAF)
    (mask_a, pattern_a), (mask_b, pattern_b) = _shared(a, starts_a), _shared(b, starts_b)
    apart = np.bitwise_count((pattern_a[:, None] ^ pattern_b[None, :]) & mask_a[:, None] & mask_b[None, :])
    near_a, near_b = np.nonzero(apart <= max_bits)
    label = np.arange(len(codes))
    if mine == len(b) and np.array_equal(a, b):
        label[mine:] = np.arange(mine)
        keep = near_a <= near_b
        near_a, near_b = near_a[keep], near_b[keep]
    at = np.arange(LEAF)
    for lo in range(0, len(near_a), 256):
        i = np.minimum(near_a[lo:lo + 256, None] * LEAF + at, len(a) - 1)
        j = np.minimum(near_b[lo:lo + 256, None] * LEAF + at, len(b) - 1)
        pair, x, y = np.nonzero(np.bitwise_count(a[i][:, :, None] ^ b[j][:, None, :]) <= max_bits)
        _merge(label, i[pair, x], j[pair, y] + mine)
    tied = np.nonzero(label != np.arange(len(codes)))[0]
    left, right = codes[tied], codes[label[tied]]
    apart = left != right
    return left[apart], right[apart]


def _comparer(max_bits: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (np.frombuffer(x.as_py(), dtype=np.int64) for x in (one, two))
                left, right = block_links(a, b, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])
    return compare


def near_links(codes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all distinct codes at most ``max_bits`` apart, directly or in steps."""
    blocks = cut_lineage(_build_blocks(codes), "blocks")
    pairs = _near_blocks(blocks, max_bits)
    one = blocks.select(F.col("node").alias("a"), F.col("codes").alias("codes_a"))
    two = blocks.select(F.col("node").alias("b"), F.col("codes").alias("codes_b"))
    both = pairs.join(one, "a").join(two, "b").select("codes_a", "codes_b")
    return both.mapInArrow(_comparer(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, sig (128-bit hash of the text), code, root
    (a code that stands for the component), component_id.

    Words are lower-cased in ASCII; shingles are three words, repeats included; a shorter text is
    one shingle, a text without words (NULL, empty, white space) has code zero, which links like
    any other. component_id is the smallest id that steps of at most 3 differing bits reach; NULL
    only where all ids reached are NULL. Rows that repeat an id each keep their own row.

    Equal codes fold into one before the index, a block of near copies leaves a spanning
    forest, and components run on codes that have a link at all."""
    prints = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text_of(text_col))).alias("sig"),
                                     fingerprint(text_col).alias("code")), "prints")
    codes = cut_lineage(prints.groupBy("code").agg(F.min("doc_id").alias("low")), "codes")
    roots = cut_lineage(connected_components(near_links(codes), "a", "b"), "roots")
    tied = codes.join(roots, codes.code == roots.node).select("code", "root", "low")
    lowest = cut_lineage(tied.groupBy("root").agg(F.min("low").alias("_low")), "lowest")
    moved = tied.join(lowest, "root").select("code", "root", F.col("_low").alias("low"))
    alone = (codes.join(roots, codes.code == roots.node, "left_anti")
             .select("code", F.col("code").alias("root"), "low"))
    classes = cut_lineage(moved.unionByName(alone), "classes")
    return prints.join(classes, "code").select("doc_id", "sig", "code", "root", F.col("low").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, the one with the smallest id, with all its columns.

    Of rows that share this id the one with the smallest content hash stays, once."""
    rows = cut_lineage(near_duplicates(docs, id_col, text_col), "near")
    lowest = (rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
              .groupBy("root", "doc_id", "sig").agg(F.count("*").alias("n")))
    kept = cut_lineage(lowest.groupBy("root").agg(F.min(F.struct("sig", "doc_id", "n")).alias("k")).select("k.*"), "kept")
    dropped = joined(rows.select("doc_id", "sig"), kept, ["doc_id", "sig"], "left_anti").distinct()
    return without_rows(docs, id_col, F.unhex(F.md5(text_of(text_col))), dropped, kept.filter(F.col("n") > 1))

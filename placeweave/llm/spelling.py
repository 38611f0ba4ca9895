"""Spelling variants by neighbourhoods that Bloom filters guide.

Two words are near if one edit of one letter makes one of the other. All edits of a word that delete a
letter, or replace one by a later one, are hashed in bulk and probed against blocked Bloom
filters, one or more for each word length. What the filters let through is a row of four
numbers; rows meet the vocabulary by hash and are kept only if the edit spelled out equals the word found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.llm.common import text_of
from placeweave.session import cut_lineage

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS, MIN_COUNT, TIMES = 7, 2, 10
#: One run in so many loses a letter.
ERASE_EACH = 31
#: Words from this length on share a shard, so that the number of shards is bounded.
LAST_SHARD = 64
#: Words of one filter, bits for each, and the bytes of all filters that are broadcast at once.
SLICE_WORDS, WORD_BITS, ROUND_BYTES = 1 << 20, 20, 64 << 20
#: Words that one probing task takes.
TASK_WORDS = 20_000

_LANES = 8
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)
_BASE = 0x9E3779B97F4A7C15
_LETTER = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_CELLS = 1 << 18


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (word) per run of letters with at least seven code points after one in 31 lost a letter."""
    longest = F.regexp_extract_all(text_of(text_col), F.lit(LETTERS + "{%d,}" % MIN_LETTERS), F.lit(0))
    runs = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(longest).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), F.col("run")))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(h % ERASE_EACH == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= MIN_LETTERS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    factors = np.full(n, _BASE, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length and their letters as a matrix, a bounded number of letters at a time."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(lengths):
        places = np.nonzero(lengths == length)[0]
        step = max(1, _CELLS // int(length))
        for lo in range(0, len(places), step):
            some = places[lo:lo + step]
            flat = "".join([words[i] for i in some]).encode("latin-1")
            yield some, np.frombuffer(flat, dtype=np.uint8).reshape(len(some), -1)


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes: a sum over letters, so that the hash of an edit follows from that of the word."""
    out = np.zeros(len(words), dtype=np.uint64)
    for places, letters in by_length(words):
        out[places] = _mixed((_LETTER[letters] * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64))
    return out


@F.arrow_udf(T.LongType())
def _word_hash(words: pa.Array) -> pa.Array:
    return pa.array(hashes(words.to_pylist()).view(np.int64), type=pa.int64())


def _cells(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The first lane of a hash's block, and the bits that choose a place in each lane."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return block.astype(np.int64) * _LANES, h.astype(np.uint32)


def blocked_filter(h: np.ndarray) -> np.ndarray:
    """A Bloom filter in blocks of eight 32-bit lanes; a hash sets one bit in each lane of one block."""
    blocks = max(1, -(-len(h) * WORD_BITS // (32 * _LANES)))
    lanes = np.zeros(blocks * _LANES, dtype=np.uint32)
    first, low = _cells(h, blocks)
    for i in range(_LANES):
        np.bitwise_or.at(lanes, first + i, np.uint32(1) << ((low * _SALTS[i]) >> np.uint32(27)))
    return lanes


def _held(lanes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that a filter may hold; lane by lane, those left only."""
    first, low = _cells(h, len(lanes) // _LANES)
    left = np.arange(len(h))
    for i in range(_LANES):
        ok = (lanes[first + i] >> ((low * _SALTS[i]) >> np.uint32(27))) & np.uint32(1) == 1
        first, low, left = first[ok], low[ok], left[ok]
    return left


class Shard:
    """The filters of one length that a round has, by slice, and the letters of their words."""

    def __init__(self, slices: int):
        self.slices, self.filters, self.letters = slices, {}, b""

    def held(self, h: np.ndarray) -> np.ndarray:
        if self.slices == 1:
            return _held(self.filters[0], h)
        slot = (h % np.uint64(self.slices)).astype(np.int64)
        found = []
        for i, lanes in self.filters.items():
            mine = np.nonzero(slot == i)[0]
            found.append(mine[_held(lanes, h[mine])])
        return np.concatenate(found)


def probes(letters: np.ndarray, shards: dict[int, Shard]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Edits that the filters let through: rows of the matrix, hash of the edit, place, new letter (0: deleted)."""
    n, length = letters.shape
    powers = _powers(length)
    parts = _LETTER[letters] * powers
    whole = parts.sum(axis=1, dtype=np.uint64)
    shorter, same = shards.get(min(length - 1, LAST_SHARD)), shards.get(min(length, LAST_SHARD))
    if shorter:
        upto = np.cumsum(parts, axis=1, dtype=np.uint64)
        back = np.uint64(pow(_BASE, -1, 1 << 64))
        fresh = np.ones(letters.shape, dtype=bool)  # of equal neighbours the first stands for all
        fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
        at = np.flatnonzero(fresh)
        h = _mixed((upto - parts + (whole[:, None] - upto) * back).ravel()[at])
        hit = shorter.held(h)
        yield at[hit] // length, h[hit], at[hit] % length, 0
    if same:
        rest = whole[:, None] - parts
        spread = np.broadcast_to(powers, letters.shape)
        for letter in same.letters:
            later = letters < letter
            h = _mixed(rest[later] + _LETTER[letter] * spread[later])
            hit = same.held(h)
            if len(hit):
                at = np.flatnonzero(later)[hit]
                yield at // length, h[hit], at % length, letter


_EDITS = "source long, found long, place int, letter int"


def _prober(shards):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, own = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for places, letters in by_length(words):
                for rows, h, at, letter in probes(letters, shards.value):
                    columns = [pa.array(own[places[rows]], pa.int64()), pa.array(h.view(np.int64), pa.int64()),
                               pa.array(at, pa.int32()), pa.array(np.full(len(at), letter), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["source", "found", "place", "letter"])
    return probe


def _build_filter(table: pa.Table) -> pa.Table:
    words = "".join(table.column("word").to_pylist()).encode("latin-1")
    letters = bytes(np.nonzero(np.bincount(np.frombuffer(words, dtype=np.uint8), minlength=256))[0].tolist())
    lanes = blocked_filter(table.column("h").to_numpy().view(np.uint64))
    return pa.table({"shard": table.column("shard")[:1], "slice": table.column("slice")[:1],
                     "lanes": pa.array([lanes.tobytes()], pa.binary()), "letters": pa.array([letters], pa.binary())})


def _slice_of(slices: dict[int, int]) -> Column:
    """The slice of a hash in its shard, as the probing side works it out from unsigned hashes."""
    n = F.element_at(F.create_map(*[F.lit(x) for item in slices.items() for x in item]), F.col("shard"))
    low, high = F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32)
    return ((high % n * (F.lit(1 << 32) % n) + low % n) % n).cast("int")


def near_pairs(vocabulary: DataFrame, slice_words: int = SLICE_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Each pair of near words once, with the counts of both: a, a_n, b, b_n.

    ``vocabulary`` is a written table (word, n, h, shard) without repeated words. A filter holds about ``slice_words``
    words; filters are broadcast in rounds of ``round_bytes`` (at least one filter), each round probing only the
    lengths that it can answer for, so what is broadcast is bounded however large the vocabulary is."""
    sizes = {r.shard: r.n for r in vocabulary.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return vocabulary.select(*[F.col(c).alias(x) for x, c in (("a", "word"), ("a_n", "n"), ("b", "word"), ("b_n", "n"))])
    slices = {shard: -(-n // slice_words) for shard, n in sorted(sizes.items())}
    built = (vocabulary.withColumn("slice", _slice_of(slices)).groupBy("shard", "slice")
             .applyInArrow(_build_filter, "shard int, slice int, lanes binary, letters binary"))
    built = cut_lineage(built, "filters")
    rounds: list[list[tuple[int, int]]] = [[]]
    room = round_bytes
    for shard, count in slices.items():
        size = sizes[shard] * WORD_BITS // 8 // count
        for i in range(count):
            if rounds[-1] and size > room:
                rounds.append([])
                room = round_bytes
            rounds[-1].append((shard, i))
            room -= size
    tasks = max(1, -(-sum(sizes.values()) // TASK_WORDS))
    words = vocabulary.select("word", "h", "shard").repartition(tasks)
    found = None
    for mine in rounds:
        edits = cut_lineage(_round(words, built, mine, slices), "edits")
        found = edits if found is None else found.unionByName(edits)
    known = vocabulary.select("h", "word", "n")
    met = found.join(known.select(F.col("h").alias("found"), F.col("word").alias("b"), F.col("n").alias("b_n")), "found")
    met = met.join(known.select(F.col("h").alias("source"), F.col("word").alias("a"), F.col("n").alias("a_n")), "source")
    put = F.when(F.col("letter") == 0, "").otherwise(F.char("letter"))
    spelled = F.concat(F.col("a").substr(F.lit(1), F.col("place")), put, F.col("a").substr(F.col("place") + 2, F.length("a")))
    return met.filter(spelled == F.col("b")).select("a", "a_n", "b", "b_n")


def _round(words: DataFrame, built: DataFrame, mine: list[tuple[int, int]], slices: dict[int, int]) -> DataFrame:
    """The edits that the filters of one round let through."""
    shards: dict[int, Shard] = {}
    named = F.struct("shard", "slice").isin([F.struct(F.lit(s), F.lit(i)) for s, i in mine])
    for row in built.filter(named).collect():
        shard = shards.setdefault(row.shard, Shard(slices[row.shard]))
        shard.filters[row.slice] = np.frombuffer(bytes(row.lanes), dtype=np.uint32)
        shard.letters = bytes(sorted(set(shard.letters) | set(row.letters)))
    asked = sorted({s for s in shards} | {s + 1 for s in shards if s < LAST_SHARD})
    sent = words.sparkSession.sparkContext.broadcast(shards)
    return words.filter(F.col("shard").isin(asked)).select("word", "h").mapInArrow(_prober(sent), _EDITS)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters (ASCII and U+00C0 to U+00FF) of whole texts, lower-cased in ASCII, with at least
    seven code points and two occurrences; one run in 31, chosen by a checksum of id and run, loses a letter
    first. ``form`` is the near word of largest n (ties: the smallest by code points), if it has ten
    times the word's n at least; ``root`` is where following forms ends.

    NULL and empty texts have no words; a NULL id counts as an empty one; rows that repeat id and
    text count each; an empty table gives no rows. A word of any length has all its edits probed. Counts fold in the map tasks, so a word of any frequency is
    one row per task; a word has as many near words as it has edits at most."""
    counts = word_runs(docs, id_col, text_col).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)
    shard = F.least(F.length("word"), F.lit(LAST_SHARD)).cast("int")
    vocabulary = cut_lineage(counts.select("word", "n", _word_hash("word").alias("h"), shard.alias("shard")), "words")
    pairs = near_pairs(vocabulary, **options)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    strong = -F.col("best.m") >= TIMES * F.col("n")
    rows = cut_lineage(vocabulary.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")), "forms")
    roots = _roots(rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """Follows forms to the end, twice as far in each round. A form has ten times the count, so no chain
    is longer than the number of digits of the largest count."""
    now = cut_lineage(links, "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(now.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return now

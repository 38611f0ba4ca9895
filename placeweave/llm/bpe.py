"""Byte-pair encoding with forced boundaries.

A pair of bytes that stands side by side in no token of the vocabulary can never be joined, so a
text may be cut there: its fragments are encoded one by one and their ids follow one another.
Fragments are mostly words and marks that repeat, so a bounded memory of them saves most merging.

The cuts must not change how the splitting pattern sees a text. It looks ahead only from white
space and treats an apostrophe by what follows it, so no cut stands after white space, before an
apostrophe or inside a character; at all others both sides split as they do together.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm.common import text_of

# fixed value: how the byte-level tokenizer splits a text before merging
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACES = np.array([9, 10, 11, 12, 13, 32])
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Fragments remembered in one Python worker; beyond it the memory starts anew.
REMEMBERED = 600_000
#: Words up to this many bytes are merged together and remembered.
SHORT = 64
#: Bytes of text worked on at once.
AT_ONCE = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class Memory:
    """Ids of fragments of up to 15 bytes, looked up in bulk.

    A fragment is two numbers, its bytes and its length, so two fragments are never taken for one another.
    They lie in an open table; a place holds where in ``pool`` the ids begin and how many they are."""

    LONGEST = 15

    def __init__(self, entries: int):
        self.entries, self.bits = entries, (2 * entries).bit_length()
        self.pool = np.empty(4 * entries, dtype="<i4")
        self.clear()

    def clear(self) -> None:
        self.words = np.zeros((2, 1 << self.bits), dtype=np.uint64)
        self.start, self.count = np.zeros(1 << self.bits, dtype=np.int32), np.zeros(1 << self.bits, dtype=np.int32)
        self.held = self.used = 0

    @staticmethod
    def keys(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The two numbers of each fragment of ``data``."""
        whole = np.ndarray((len(data) + 9,), dtype="<u8", buffer=data + bytes(16), strides=(1,))
        masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
        tail = whole[starts + 8 * (lengths > 8)] & masks[np.clip(lengths - 8, 0, 7)]
        return np.stack([whole[starts] & masks[np.minimum(lengths, 8)], tail | lengths.astype(np.uint64) << np.uint64(56)])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[0] ^ (keys[1] << np.uint64(7)) ^ (keys[1] >> np.uint64(9))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each fragment, -1 where it is not known."""
        at = self._home(keys)
        out = np.where((self.words[0][at] == keys[0]) & (self.words[1][at] == keys[1]), at, -1)
        left = np.nonzero((out < 0) & (self.count[at] > 0))[0]
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            here = at[left]
            same = (self.words[0][here] == keys[0][left]) & (self.words[1][here] == keys[1][left])
            out[left[same]] = here[same]
            left = left[~same & (self.count[here] > 0)]
        return out

    def write(self, ids: np.ndarray) -> int:
        """Puts ids behind those in use, without keeping them; where they begin."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool) + len(ids), dtype="<i4")])
        self.pool[self.used:self.used + len(ids)] = ids
        return self.used

    def learn(self, fragments: dict[bytes, bytes]) -> None:
        """Keeps the ids of new fragments."""
        lengths = np.fromiter(map(len, fragments), dtype=np.int64, count=len(fragments))
        keys = self.keys(b"".join(fragments), np.cumsum(lengths) - lengths, lengths)
        counts = np.fromiter(map(len, fragments.values()), dtype=np.int64, count=len(fragments)) // 4
        first = self.write(np.frombuffer(b"".join(fragments.values()), dtype="<i4"))
        starts = first + np.cumsum(counts) - counts
        self.used += int(counts.sum())
        self.held += len(fragments)
        at, left = self._home(keys), np.arange(len(fragments))
        while len(left):
            free = left[self.count[at[left]] == 0]
            places, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.words[:, places] = keys[:, put]
            self.start[places], self.count[places] = starts[put], counts[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)


class Tokenizer:
    """Encodes and decodes by the vocabulary of a byte-level tokenizer file."""

    def __init__(self, spec: str):
        read = json.loads(spec)
        model, before = read["model"], read["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before["add_prefix_space"] or read["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space is handled")
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.tokens = {i: token for token, i in self.ids.items()}
        self.special = {x["content"].encode(): x["id"] for x in read["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in read["added_tokens"]):
            raise ValueError("added tokens that strip or need whole words are not handled")
        self.tokens |= {i: token for token, i in self.special.items()}
        self._special = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")") if self.special else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        coded = [tuple(bytes(letters[c] for c in half) for half in m) for m in pairs]
        self.merges = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(coded)}
        self.made = np.array([self.ids[a + b] for a, b in coded], dtype=np.int64)
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs, self.ranks = (np.array(x, dtype=np.int64) for x in zip(*sorted(self.merges.items()), strict=True))
        self.split = regex.compile(SPLIT)
        cuts = np.ones((256, 256), dtype=bool)
        for token in self.ids:
            codes = np.frombuffer(token, dtype=np.uint8)
            cuts[codes[:-1], codes[1:]] = False
        cuts[_SPACES] = False
        cuts[:, ord("'")] = False
        cuts[:, 0x80:0xC0] = False
        self.cuts, self._flat_cuts = cuts, cuts.ravel()
        self.cuts_after_ascii = cuts.copy()
        self.cuts_after_ascii[128:] = False
        self.memory, self.long = Memory(REMEMBERED), {}
        self._forget()

    def _forget(self) -> None:
        """Only the special tokens stay known."""
        alone = {f: np.array([i], dtype="<i4").tobytes() for f, i in self.special.items()}
        self.memory.clear()
        self.memory.learn({f: ids for f, ids in alone.items() if len(f) <= Memory.LONGEST})
        self.long = {f: ids for f, ids in alone.items() if len(f) > Memory.LONGEST}

    def _rank(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Ranks of neighbours, one past the last rank where they do not merge."""
        key = one << 32 | two
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], len(self.made))

    def _merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many short words at once: every round merges the best pair of each word."""
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ids = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = np.full(len(ids), len(self.made))
        ranks[:-1] = np.where(owner[1:] == owner[:-1], self._rank(ids[:-1], ids[1:]), len(self.made))
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.concatenate([[0], np.nonzero(owner[1:] != owner[:-1])[0] + 1])
            best = np.minimum.reduceat(ranks << 32 | np.arange(len(ids)), starts)
            live = best >> 32 < len(self.made)
            if 4 * live.sum() <= 3 * len(live):
                stay = np.repeat(live, np.diff(starts, append=len(ids)))
                done_ids.append(ids[~stay])
                done_owner.append(owner[~stay])
                ids, owner, ranks = ids[stay], owner[stay], ranks[stay]
                continue
            at = best[live] & 0xFFFFFFFF
            ids[at] = self.made[ranks[at]]
            stay = np.ones(len(ids), dtype=bool)
            stay[at + 1] = False
            ids, owner, ranks = ids[stay], owner[stay], ranks[stay]
            at -= np.arange(len(at))
            for i in (at[at > 0] - 1, at):
                j = np.minimum(i + 1, len(ids) - 1)
                ranks[i] = np.where((owner[i] == owner[j]) & (i < j), self._rank(ids[i], ids[j]), len(self.made))
        ids, owner = np.concatenate([*done_ids, ids]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
        data = ids[order].astype("<i4").tobytes()
        return [data[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def _merge_long(self, word: bytes) -> bytes:
        """The same merges from a heap, for words so long that a round each would be slow."""
        ids = self.bytes[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (rank := self.merges.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            rank, i, one, two = heapq.heappop(heap)
            j = after[i]
            if ids[i] != one or j < 0 or ids[j] != two:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], dtype="<i4").tobytes()

    def _learn(self, fragments: set[bytes]) -> dict[bytes, bytes]:
        """Ids of fragments not met before. Plain ASCII words are one word for the pattern, too."""
        plain = [f for f in fragments if len(f) <= SHORT and (f.isalpha() or f[:1] == b" " and f[1:].isalpha())]
        split = {f: [w.encode() for w in self.split.findall(f.decode())] for f in fragments.difference(plain)}
        words = {w for ws in split.values() for w in ws}
        short = [*plain, *(w for w in words if len(w) <= SHORT)]
        known = dict(zip(short, self._merge_many(short), strict=True)) if short else {}
        known |= {w: self._merge_long(w) for w in words if len(w) > SHORT}
        out = {f: known[f] for f in plain}
        return out | {f: b"".join([known[w] for w in ws]) for f, ws in split.items()}

    def _cut(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Texts one behind the other, where their fragments end, and how many fragments end with each text.

        Every certain boundary is a cut, and so are the ends of texts; special tokens stand by themselves."""
        parts = [self._special.split(t) if self._special else [t] for t in texts]
        flat = [p for ps in parts for p in ps]
        data = b"".join(flat)
        codes = np.frombuffer(data, dtype=np.uint8)
        cuts = np.zeros(len(data) + 1, dtype=bool)
        cuts[1:-1] = self._flat_cuts[codes[:-1].astype(np.int64) << 8 | codes[1:]] if len(data) else False
        end = 0
        for part in flat:
            start, end = end, end + len(part)
            if part in self.special:
                cuts[start + 1:end] = False
            elif _WIDE_SPACE.search(part):
                cuts[start + 1:end] = self.cuts_after_ascii[codes[start:end - 1], codes[start + 1:end]]
            cuts[end] = True
        cuts[0] = False
        stops = np.cumsum([sum(map(len, ps)) for ps in parts])
        return data, np.nonzero(cuts)[0], np.cumsum(cuts)[stops]

    def _encode_some(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.memory.held > REMEMBERED or len(self.long) > REMEMBERED:
            self._forget()
        memory = self.memory
        data, ends, last = self._cut(texts)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        lengths = ends - starts
        small = np.nonzero(lengths <= Memory.LONGEST)[0]
        keys = memory.keys(data, starts[small], lengths[small])
        at = memory.find(keys)
        missed = np.nonzero(at < 0)[0]
        bounds = zip(starts[small[missed]].tolist(), ends[small[missed]].tolist(), strict=True)
        new = {data[i:j] for i, j in bounds}
        large = np.nonzero(lengths > Memory.LONGEST)[0]
        spelled = [data[i:j] for i, j in zip(starts[large].tolist(), ends[large].tolist(), strict=True)]
        learned = self._learn(new | {f for f in spelled if f not in self.long})
        if new:
            memory.learn({f: learned[f] for f in new})
            at[missed] = memory.find(keys[:, missed])
        begin, count = np.empty(len(ends), dtype=np.int64), np.empty(len(ends), dtype=np.int64)
        begin[small], count[small] = memory.start[at], memory.count[at]
        if spelled:
            self.long |= {f: ids for f, ids in learned.items() if Memory.LONGEST < len(f) <= SHORT}
            found = [self.long[f] if f in self.long else learned[f] for f in spelled]
            count[large] = [len(ids) // 4 for ids in found]
            begin[large] = memory.write(np.frombuffer(b"".join(found), dtype="<i4")) + np.cumsum(count[large]) - count[large]
        upto = np.cumsum(count)
        ids = memory.pool[np.repeat(begin - upto + count, count) + np.arange(upto[-1] if len(upto) else 0)]
        stops = np.concatenate([[0], upto])[last].tolist()
        return [ids[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts; a special token's string in a text is that token.

        Texts are taken in slices of about a megabyte, so that their fragments stay few."""
        out: list[np.ndarray] = []
        some: list[bytes] = []
        size = 0
        for i, text in enumerate(texts):
            some.append(text)
            size += len(text)
            if size >= AT_ONCE or i == len(texts) - 1:
                out += self._encode_some(some)
                some, size = [], 0
        return out

    def encode(self, data: bytes) -> np.ndarray:
        return self.encode_batch([data])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", errors="replace")


def worker_tokenizer(spec) -> Tokenizer:
    """One tokenizer per Python worker, kept with the broadcast value, which outlives a task."""
    if "tokenizer" not in vars(spec):
        vars(spec)["tokenizer"] = Tokenizer(spec.value)
    return vars(spec)["tokenizer"]


def tokenizer_spec(spark: SparkSession, path: str):
    """The tokenizer file (a fixed few MB, whatever the data) as a broadcast value."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _ids_of(tokenizer: Tokenizer, texts: pa.Array) -> pa.ListArray:
    """Ids of a batch. A few texts at a time leave Arrow, so that a batch is not held twice as objects."""
    ids = []
    for lo in range(0, len(texts), 256):
        ids += tokenizer.encode_batch(texts.slice(lo, 256).cast(pa.binary()).to_pylist())
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, "<i4")])))


def _texts_of(tokenizer: Tokenizer, ids: pa.ListArray) -> pa.Array:
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    ends = ends - ends[0]
    return pa.array([tokenizer.decode(flat[i:j].tolist()) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def encoder(spec):
    """A column function text -> array of ids. NULL and empty texts have no ids."""
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _ids_of(worker_tokenizer(spec), texts)
    return lambda column: encode(text_of(column))


def decoder(spec):
    """A column function array of ids -> text. Bytes that are no UTF-8 become the replacement sign."""
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return _texts_of(worker_tokenizer(spec), ids)
    return lambda column: decode(F.coalesce(F.col(column), F.array().cast("array<int>")))


def round_trip(docs: DataFrame, spec, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and the text ``decoded`` from them, both from one Python worker per task.

    The same as ``decoded(encoded(docs))``, which needs a second worker and a second copy of the ids."""
    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(texts: pa.Array) -> pa.Array:
        tokenizer = worker_tokenizer(spec)
        ids = _ids_of(tokenizer, texts)
        return pa.StructArray.from_arrays([ids, _texts_of(tokenizer, ids)], ["ids", "decoded"])
    return docs.select("*", both(text_of(text_col)).alias("_both")).select("*", "_both.ids", "_both.decoded").drop("_both")


def joined_ids(ids: str) -> Column:
    """Decimal ids with commas between."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")


def encoded(docs: DataFrame, spec, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids. Extra columns stay; ``out`` must be a new name.

    NULL and empty texts have no ids. Rows are independent: repeated rows and ids stay as they are."""
    return docs.select("*", encoder(spec)(text_col).alias(out))


def decoded(rows: DataFrame, spec, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; NULL ids give an empty text."""
    return rows.select("*", decoder(spec)(ids_col).alias(out))

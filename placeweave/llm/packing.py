"""Packing of token ids into rows of fixed length, best fit decreasing.

Texts longer than a row are split into full rows and a rest, without losing an id. Rests and short
texts are packed in groups of bounded size: the longest first, each into the open row whose
free space is the least that suffices. A segment tree over free space finds that row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.llm import bpe
from placeweave.llm.common import text_of
from placeweave.session import cut_lineage

LENGTH = 4096
#: Ids that one group holds on average; groups, not documents, are what a task packs at once.
GROUP_IDS = 4 << 20
#: Ids of the byte vocabulary: the 256 bytes and the end of a text.
BYTE_END = 256
#: The token that ends a text.
TEXT_END = "<|endoftext|>"


class FreeSpace:
    """Which amounts of free space open rows have, as a segment tree of the largest amount below each node."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.held = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _set(self, space: int, held: bool) -> None:
        at = space + self.size
        self.held[at] = held
        while at > 1:
            at //= 2
            held = self.held[2 * at] or self.held[2 * at + 1]
            if self.held[at] == held:
                break
            self.held[at] = held

    def put(self, row: int, space: int) -> None:
        self.rows[space].append(row)
        if len(self.rows[space]) == 1:
            self._set(space, True)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the smallest free space of at least ``least``, and that space."""
        at = least + self.size
        while not self.held[at]:
            while at % 2:
                at //= 2
            if at == 0:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.held[2 * at] else 2 * at + 1
        space = at - self.size
        row = self.rows[space].pop()
        if not self.rows[space]:
            self._set(space, False)
        return row, space


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers: items by falling length (then number), each into the tightest row."""
    rows: list[list[int]] = []
    free = FreeSpace(length)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = free.take(lengths[item]) if lengths[item] < length else None
        row, space = found or (len(rows), length)
        if not found:
            rows.append([])
        rows[row].append(item)
        if space > lengths[item]:
            free.put(row, space - lengths[item])
    return rows


def byte_ids(text: bytes) -> bytes:
    """Little-endian 16-bit ids of a UTF-8 text: its bytes and an end id."""
    return np.append(np.frombuffer(text, dtype=np.uint8).astype("<u2"), BYTE_END).astype("<u2").tobytes()


def token_ids(spec, end: str):
    """A function from texts to their tokens' little-endian 16-bit ids, each with the id of the token ``end`` behind them."""
    def all_ids(texts: list[bytes]) -> list[bytes]:
        tokenizer = bpe.worker_tokenizer(spec)
        if max(tokenizer.tokens) > 0xFFFF:
            raise ValueError("the tokenizer has ids above 16 bits")
        last = np.array([tokenizer.special[end.encode()]], dtype="<u2").tobytes()
        return [ids.astype("<u2").tobytes() + last for ids in tokenizer.encode_batch(texts)]
    return all_ids


_PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
                        T.StructField("ids", T.BinaryType())])
_ROWS = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("n_ids", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("pieces", T.ArrayType(T.IntegerType())),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("ids", T.BinaryType()),
    T.StructField("position_ids", T.BinaryType())])


def _piece_rows(docs: list, pieces: list, parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(parts, pa.binary())],
                                      ["doc_id", "piece", "ids"])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about a megabyte each."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // bpe.AT_ONCE
    ends = [*(np.nonzero(np.diff(part))[0] + 1).tolist(), len(texts)]
    return zip([0, *ends], ends, strict=False)


def _splitter(length: int, all_ids):
    """Pieces of at most ``length`` ids, a few megabytes at a time; ``all_ids`` makes the ids of a list of texts."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 2 * length
        for batch in batches:
            values = batch.column(1).cast(pa.binary())
            docs, pieces, parts, size = [], [], [], 0
            for lo, hi in _slices(values):
                some = [value or b"" for value in values.slice(lo, hi - lo).to_pylist()]
                for doc, data in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), all_ids(some), strict=True):
                    for i, at in enumerate(range(0, len(data), step)):
                        docs.append(doc)
                        pieces.append(i)
                        parts.append(data[at:at + step])
                    size += len(data)
                    if size > 4 << 20:
                        yield _piece_rows(docs, pieces, parts)
                        docs, pieces, parts, size = [], [], [], 0
            yield _piece_rows(docs, pieces, parts)
    return split


def _packer(length: int, pad: int):
    def pack(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
        table = table.take(order)
        docs, pieces = table.column("doc_id").to_pylist(), table.column("piece").to_pylist()
        parts = table.column("ids").to_pylist()
        rows = best_fit([len(p) // 2 for p in parts], length)
        out: dict[str, list] = {f.name: [] for f in _ROWS}
        for number, items in enumerate(rows):
            lengths = [len(parts[i]) // 2 for i in items]
            used = sum(lengths)
            places = np.zeros(length, dtype="<i4")
            places[:used] = np.concatenate([np.arange(n) for n in lengths])
            out["shard"].append(shard)
            out["row"].append(number)
            out["n_ids"].append(used)
            out["doc_ids"].append([docs[i] for i in items])
            out["pieces"].append([pieces[i] for i in items])
            out["cu_seqlens"].append([0, *np.cumsum(lengths).tolist()])
            out["ids"].append(b"".join(parts[i] for i in items) + np.full(length - used, pad, dtype="<u2").tobytes())
            out["position_ids"].append(places.tobytes())
        kinds = {"shard": pa.int64(), "row": pa.int32(), "n_ids": pa.int32(), "doc_ids": pa.list_(pa.int64()),
                 "pieces": pa.list_(pa.int32()), "cu_seqlens": pa.list_(pa.int32()), "ids": pa.binary(), "position_ids": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})
    return pack


def pack(rows: DataFrame, ids_col: str, id_col: str = "doc_id", length: int = LENGTH, group_ids: int = GROUP_IDS,
         pad: int = 0) -> DataFrame:
    """Packed rows of ``length`` ids: shard, row, n_ids, doc_ids, pieces, cu_seqlens, ids, position_ids.

    ``ids_col`` holds 16-bit little-endian ids; so does ``ids``, a line of the shard's id matrix, filled up with
    ``pad``. ``cu_seqlens`` starts at 0 and ends at n_ids; ``position_ids`` (32 bits) starts at 0 in each segment. A segment is
    named by its document and its piece number there; pieces in order give the document's ids again.

    Pieces, not documents, are dealt to groups by a hash, so one very long text spreads over
    them, and so do rows equal in all columns, by their place in the written pieces. NULL and empty id columns have no piece; rows that repeat an id are packed each; an empty table gives no rows."""
    total = rows.agg(F.sum(F.octet_length(ids_col))).first()[0] or 0
    ids = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    pieces = cut_lineage(ids.mapInArrow(_splitter(length, list), _PIECES), "pieces")
    return _packed(pieces, max(1, -(-total // (2 * group_ids))), length, pad)


def _packed(pieces: DataFrame, groups: int, length: int, pad: int) -> DataFrame:
    """Written pieces, packed in groups. The place in its file tells equal rows apart, so that many of them do not meet in one group."""
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids", "_metadata.row_index"), F.lit(groups))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(_packer(length, pad), _ROWS)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as files, one folder per shard, lines in order."""
    packed.repartition("shard").sortWithinPartitions("shard", "row").write.partitionBy("shard").parquet(path)


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
               group_ids: int = GROUP_IDS) -> DataFrame:
    """Texts as byte ids with an end id each, packed. Sizes for the groups come from the texts' lengths; NULL counts as empty."""
    total = docs.agg(F.sum(F.octet_length(text_of(text_col)) + 1)).first()[0] or 0
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = cut_lineage(texts.mapInArrow(_splitter(length, lambda some: map(byte_ids, some)), _PIECES), "pieces")
    return _packed(pieces, max(1, -(-total // group_ids)), length, 0)


def pack_tokens(docs: DataFrame, spec, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                group_ids: int = GROUP_IDS, end: str = TEXT_END) -> DataFrame:
    """Texts as token ids of a tokenizer (``bpe.tokenizer_spec``) with its ``end`` token each, packed. NULL counts as empty.

    Texts are encoded once, where they are split; the pieces are written, as the number of groups needs their number of ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = cut_lineage(texts.mapInArrow(_splitter(length, token_ids(spec, end)), _PIECES), "tokens")
    total = pieces.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    return _packed(pieces, max(1, -(-total // (2 * group_ids))), length, 0)

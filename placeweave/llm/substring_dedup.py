"""Substring dedup by spans of sentences that stand elsewhere before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.llm.common import first_places, joined, later_occurrences, merged_spans, text_of
from placeweave.session import cut_lineage

#: Sentences of more words are cut after commas and after words chosen by their bytes, one in four.
LONG = 12
#: A span is the shortest run of this many sentences or more that has this many words or more. A repeated passage of over
#: fifty words holds such a run wherever it starts, as a sentence and the run's last one seldom pass twelve words each.
RUN_SENTENCES, RUN_WORDS = 2, 25
#: Bytes of text worked on at once.
AT_ONCE = 1 << 20


def _members(marks: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(marks)] = True
    return table


_SPACE, _STOP, _PAUSE = _members(b" \t\n\r\x0b\x0c"), _members(b".!?"), _members(b",;:")


def sentences(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last word and number of words of each sentence.

    A sentence ends after a word that ends in a stop, at a line break and with the text. Where a long one
    is cut depends on its words alone, so a passage is cut alike wherever it stands."""
    data = np.frombuffer(text, dtype=np.uint8)
    space = np.concatenate([[True], _SPACE[data], [True]])
    starts = np.nonzero(space[:-2] & ~space[1:-1])[0]
    ends = np.nonzero(~space[1:-1] & space[2:])[0] + 1
    if not len(starts):
        return starts, ends, starts
    lines = np.cumsum(data == 10, dtype=np.int32)
    last = data[ends - 1]
    stop = _STOP[last]
    stop[:-1] |= lines[starts[1:] - 1] > lines[ends[:-1] - 1]
    stop[-1] = True
    number = np.concatenate([[0], np.cumsum(stop)[:-1]])
    long = np.bincount(number)[number] > LONG
    chosen = np.add.reduceat(np.where(space[1:-1], 0, data).astype(np.uint32), starts) % 4 == 0
    cut = np.nonzero(stop | long & (_PAUSE[last] | chosen))[0]
    words = np.diff(cut, prepend=-1)
    return starts[cut - words + 1], ends[cut], words


def spans_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of texts: number of the text, first byte and byte after (up to the next sentence) in it, and a row of two
    64-bit hashes for each.

    From every sentence on it is the shortest run inside its text that is long enough; hashed are its bytes from the
    first word to the last. Texts are worked on together, a line break between them."""
    joined = b"\n".join(texts)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, ends, words = sentences(joined)
    text = np.searchsorted(begin, starts, side="right") - 1
    upto = np.cumsum(words)
    after = np.searchsorted(upto, upto - words + RUN_WORDS) + 1
    after = np.maximum(after, np.arange(len(words)) + RUN_SENTENCES)
    whole = after <= len(words)
    whole[whole] = text[after[whole] - 1] == text[:len(whole)][whole]
    first, after, text = starts[whole], after[whole], text[whole]
    digest = xxhash.xxh3_128_digest
    hashes = b"".join([digest(joined[i:j]) for i, j in zip(first.tolist(), ends[after - 1].tolist(), strict=True)])
    stop = np.minimum(np.append(starts, len(joined))[after], begin[text + 1] - 1)
    return text, first - begin[text], stop - begin[text], np.frombuffer(hashes, dtype="<i8").reshape(-1, 2)


_SPANS = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("mark", T.LongType()), ("start", T.IntegerType()), ("end", T.IntegerType()),
    ("h1", T.LongType()), ("h2", T.LongType()))])


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flat span rows from (doc_id, mark, text); a few documents at a time, so that batches stay small."""
    for batch in batches:
        ids, marks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        texts = batch.column(2).cast(pa.binary())
        lo = 0
        while lo < len(texts):
            some, size = [], 0
            while lo + len(some) < len(texts) and size < AT_ONCE:
                some.append(texts[lo + len(some)].as_py())
                size += len(some[-1])
            text, first, after, hashes = spans_of(some)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(text + lo)), pa.array(marks[text + lo], pa.int64()), pa.array(first.astype("i4")),
                 pa.array(after.astype("i4")), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())],
                ["doc_id", "mark", "start", "end", "h1", "h2"])
            lo += len(some)


@F.arrow_udf(T.StringType())
def _cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, removed in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True):
        at, parts = 0, []
        for span in removed or []:
            parts.append(text[at:span["start"]])
            at = span["end"]
        out.append((b"".join(parts) + text[at:]).decode("utf-8", errors="replace"))
    return pa.array(out, pa.string())


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (what is left), n_removed (bytes), spans (removed byte ranges).

    Every run of sentences is hashed and met globally; the first place of a hash, by id (NULL last), content and
    offset, stays, and all sentences under any later place go, also where it overlaps the first. Texts too short
    for a span, NULL (as empty) and empty ones stay. Rows that repeat id and text count as one document and
    come out alike. Ids are whole numbers.

    What moves first is one 64-bit hash per span, folded in the map tasks; only spans whose hash
    occurs again go on with 128 bits and their places. Both joins are split where a hash is hot."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("mark"),
                       text_of(text_col).alias("text"))
    spans = rows.mapInArrow(_span_rows, _SPANS)
    often = spans.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select("h1")
    often = cut_lineage(often, "hashes")
    again = cut_lineage(spans.join(often, "h1", "left_semi"), "spans")
    repeated = cut_lineage(first_places(again), "repeated")
    covered = cut_lineage(merged_spans(later_occurrences(again, repeated), ["doc_id", "mark"]), "covered")
    found = joined(rows, covered, ["doc_id", "mark"], "left", merge=True)
    removed = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0).cast("long"),
                          lambda a, s: a + s["end"] - s["start"])
    left = F.when(F.col("spans").isNotNull(), _cut_out("text", "spans")).otherwise(F.col("text"))
    return found.select("doc_id", left.alias("text"), removed.alias("n_removed"),
                        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))

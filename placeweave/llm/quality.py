"""Quality by attention over passages, learned from document labels.

A document is a bag of passages of fixed length. A passage is encoded by how kinds of
characters follow one another in it; a small network maps the encoding to a vector, a gated
attention weighs the vectors of a document, and the weighted mean is scored. Only labels of whole
documents are known, so the weights of passages are learned with the rest, by gradient descent.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from placeweave.llm.common import text_of

#: Bytes in a passage.
PASSAGE = 512
#: The labelled documents to learn from: at most so many, in hash order, of texts up to so many bytes, together up to so many.
#: All passages of each are read.
SAMPLE_DOCS, SAMPLE_TEXT, SAMPLE_BYTES = 4000, 1 << 20, 64 << 20
ACCEPT = 0.7
_KINDS = 8
_STEPS = _KINDS * _KINDS
_SIZE = _STEPS + 2
_SLICE = 4 << 20


def _kind_table() -> np.ndarray:
    """Kind of each byte: other mark, lower, upper, digit, space, line break, sentence mark, beyond ASCII."""
    table = np.zeros(256, dtype=np.uint8)
    for kind, members in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                          (3, b"0123456789"), (4, b" \t\x0b\x0c"), (5, b"\r\n"), (6, b".,;:!?'\"()-")):
        table[list(members)] = kind
    table[128:] = 7
    return table


_TABLE = _kind_table()


def passage_counts(text: bytes) -> np.ndarray:
    """Per passage how often each kind of character follows each, how many words repeat the word
    before, and how many words start; one row of zeros for an empty text."""
    if len(text) < 2:
        return np.zeros((1, _SIZE), dtype=np.float64)
    parts = []
    for lo in range(0, len(text) - 1, _SLICE):
        kinds = _TABLE[np.frombuffer(text[lo:lo + _SLICE + 1], dtype=np.uint8)]
        steps = kinds[:-1].astype(np.int64) * _KINDS + kinds[1:]
        passages = (len(steps) + PASSAGE - 1) // PASSAGE
        at = np.arange(len(steps)) // PASSAGE * _STEPS
        parts.append(np.bincount(at + steps, minlength=passages * _STEPS).reshape(passages, _STEPS))
    steps = np.concatenate(parts)
    words = text.split()
    again = np.fromiter(map(operator.eq, words[1:], words), dtype=np.int64, count=max(0, len(words) - 1))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    at = np.minimum((np.cumsum(lengths + 1) - lengths - 1) // PASSAGE, len(steps) - 1)
    count = np.bincount(at, minlength=len(steps))
    repeated = np.bincount(at[1:], weights=again, minlength=len(steps))
    return np.concatenate([steps, repeated[:, None], count[:, None]], axis=1).astype(np.float64)


def encoded(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares, so that rare steps count and length does not."""
    steps, repeated, words = counts[:, :_STEPS], counts[:, _STEPS:-1], counts[:, -1:]
    length = np.maximum(steps.sum(axis=1, keepdims=True), 1.0)
    return np.sqrt(np.concatenate([steps / length, repeated / np.maximum(words, 1.0), words / length], axis=1))


@dataclass(frozen=True)
class Model:
    """Weights of the network; ``prior`` alone is the score when labels of both kinds were lacking."""

    prior: float
    weights: dict[str, np.ndarray] | None = None

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.weights is None or not bags:
            return np.full(len(bags), self.prior)
        starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return _forward(self.weights, np.concatenate(bags), starts)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(starts, append=len(x))
    h = np.tanh(x @ w["H"] + w["h"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(h * a[:, None], starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "sizes": sizes}


def _gradients(w: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, starts)
    d = (f["p"] - y) / len(y)
    dz = np.repeat(d[:, None] * w["c"][None, :], f["sizes"], axis=0)
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"]))
    dt = de[:, None] * w["a"][None, :] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * w["a"][None, :] * f["t"] * f["g"] * (1 - f["g"])
    dh = (dz * f["a"][:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    return {"H": x.T @ dh, "h": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "d": d.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40,
        batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Learns by Adam on the log loss; the same input gives the same model."""
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    if len(set(labels.tolist())) < 2:
        return Model(prior)
    rng = np.random.default_rng(seed)
    shapes = {"H": (_SIZE, hidden), "h": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "a": (gate,),
              "c": (hidden,), "d": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "hd" else np.zeros(s) for k, s in shapes.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            chosen = order[lo:lo + batch]
            some = [bags[i] for i in chosen]
            starts = np.cumsum([0, *(len(b) for b in some[:-1])])
            step += 1
            for k, g in _gradients(w, np.concatenate(some), starts, labels[chosen]).items():
                g = g + decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(prior, w)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


@F.arrow_udf(T.BinaryType())
def _counts(texts: pa.Array) -> pa.Array:
    return pa.array([passage_counts(text).astype("<u2").tobytes() for text in texts.cast(pa.binary()).to_pylist()], pa.binary())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_docs: int = SAMPLE_DOCS, sample_text: int = SAMPLE_TEXT, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from all passages of a bounded sample of the labelled documents that are not held out.

    The bounds make the labels small enough to broadcast to the texts, and the sample to bring to the driver (a
    passage of 512 bytes takes 132, so 17 MB at most). Labels that are NULL or neither 0 nor 1, and ids without a
    document are passed over; of several labels of one id the larger counts; of several texts the one whose counts have the smallest hash."""
    usable = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
              .groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    rows = (docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).filter(F.octet_length("text") <= sample_text)
            .join(F.broadcast(usable), "doc_id")
            .select("doc_id", "label", F.octet_length("text").cast("long").alias("size"), _counts("text").alias("counts"))
            .groupBy("doc_id", "label").agg(F.min_by(F.struct("counts", "size"), F.sha2("counts", 256)).alias("c")))
    upto = F.sum("c.size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = (rows.withColumn("upto", upto).filter(F.col("upto") <= sample_bytes)
            .select("doc_id", "label", F.col("c.counts").alias("counts")).collect())
    rows.sort(key=lambda r: r.doc_id)
    bags = [encoded(np.frombuffer(r.counts, dtype="<u2").reshape(-1, _SIZE).astype(np.float64)) for r in rows]
    return fit(bags, np.array([r.label for r in rows], dtype=np.float64)) if rows else Model(0.5)


def scorer(model: Model):
    """A column function text -> score. Every passage of the whole text is read."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out, bags, size = [], [], 0
        for text in texts.cast(pa.binary()).to_pylist():
            bags.append(encoded(passage_counts(text)))
            size += len(bags[-1])
            if size > 8192:
                out.append(model.scores(bags))
                bags, size = [], 0
        out.append(model.scores(bags))
        return pa.array(np.round(np.concatenate(out), 6), pa.float64())
    return lambda column: score(text_of(column))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "quality", threshold: float = ACCEPT, **bounds: int) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    NULL and empty texts are scored as one passage without content. Learning needs no more than
    both kinds of labels; without them the share of ones (0.5 if there is no label) is every score."""
    model = learn(docs, labels, id_col, text_col, label_col, **bounds)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       scorer(model)(text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", threshold: float = ACCEPT, **bounds: int) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    model = learn(docs, labels, id_col, text_col, label_col, **bounds)
    rows = docs.select(F.struct("*").alias("_row"), scorer(model)(text_col).alias("_score"))
    return rows.filter(F.col("_score") >= threshold).select("_row.*")

"""Byte-pair encoding against the tokenizers library, and packing as a round trip."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from placeweave.llm import bpe, packing
from placeweave.llm.queries import QUERIES

PARTS = [*"aàb1²Ⅳ ~'!sdtmlvre\n\t\r\xa0 é漢字🙂‍\x00\x1c\x85", "<|endoftext|>", "'s", "  ", "\n\n", "'ll", " the", "ing", "ñ."]


@pytest.fixture(scope="module")
def pair(tokenizer_file):
    with open(tokenizer_file, encoding="utf-8") as file:
        return bpe.Tokenizer(file.read()), Library.from_file(tokenizer_file)


def test_random_texts(pair):
    mine, library = pair
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for text, ids in zip(texts, mine.encode_batch([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and mine.decode(want) == library.decode(want, skip_special_tokens=False) == text


def test_long_words(pair):
    mine, library = pair
    rng = random.Random(2)
    for letters in ("abcde", "a", "é", "漢a1"):
        text = "".join(rng.choice(letters) for _ in range(3000))
        assert mine.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_starts_anew(pair, monkeypatch):
    mine, library = pair
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for text in ("one two three four", "five <|endoftext|> six", "one two"):
        assert mine.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, docs, documents, tokenizer_file):
    spec = bpe.tokenizer_spec(spark, tokenizer_file)
    library = Library.from_file(tokenizer_file)
    rows = documents.select("doc_id", "text").unionByName(docs([(-1, None), (-2, ""), (None, "x"), (-1, None)]).select("doc_id", "text"))
    found = bpe.decoded(bpe.encoded(rows, spec), spec).collect()
    assert len(found) == rows.count()
    for r in found:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.encoded(docs([]), spec).count() == 0
    together = bpe.round_trip(rows, spec).collect()
    assert sorted(map(repr, together)) == sorted(map(repr, found))


def test_best_fit():
    rng = random.Random(4)
    for length in (1, 7, 64, 100):
        lengths = [rng.randint(1, length) for _ in range(300)]
        space, where = [], {}
        for item in sorted(range(300), key=lambda i: (-lengths[i], i)):
            fits = [r for r, s in enumerate(space) if s >= lengths[item]]
            if fits:
                best = min(space[r] for r in fits)
                row = [r for r in fits if space[r] == best][0]
            else:
                space.append(length)
                row = len(space) - 1
            where[item] = row
            space[row] -= lengths[item]
        rows = packing.best_fit(lengths, length)
        assert len(rows) == len(space) and sorted(i for r in rows for i in r) == list(range(300))
        assert all(sum(lengths[i] for i in r) <= length for r in rows)
        assert sorted(length - sum(lengths[i] for i in r) for r in rows) == sorted(space)


def test_packed_texts_come_back(docs):
    rng = random.Random(6)
    rows = [(i, "é" * rng.randint(0, 90)) for i in range(60)] + [(100, None), (101, ""), (102, "long " * 500), (60, "twice")]
    packed = packing.pack_texts(docs(rows), length=128, group_ids=1000).collect()
    assert len({r.shard for r in packed}) > 1
    pieces = {}
    for r in packed:
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == len(places) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids
        assert (ids[r.n_ids:] == 0).all() and (places[r.n_ids:] == 0).all()
        for doc, piece, lo, hi in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert places[lo:hi].tolist() == list(range(hi - lo))
            pieces[doc, piece] = ids[lo:hi].tolist()
    for doc, text in rows:
        whole = [x for (d, _), p in sorted(pieces.items()) if d == doc for x in p]
        assert whole == [*(text or "").encode(), packing.BYTE_END]
    assert packing.pack_texts(docs([])).count() == 0


def test_pack_ids_column(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytes(range(20))), (2, b""), (3, None), (None, b"ab"), (1, b"cd")], "doc_id long, ids binary")
    packed = packing.pack(rows, "ids", length=4)
    packing.write_packed(packed, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert back.select(F.sum("n_ids")).first()[0] == 12


def test_packed_tokens(spark, docs, tokenizer_file):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long words " * 500)]
    spec, library = bpe.tokenizer_spec(spark, tokenizer_file), Library.from_file(tokenizer_file)
    packed = packing.pack_tokens(docs(rows), spec, length=128, group_ids=1000).collect()
    assert len({r.shard for r in packed}) > 1
    pieces = {}
    for r in packed:
        ids = np.frombuffer(r.ids, "<u2")
        for doc, piece, lo, hi in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            pieces[doc, piece] = ids[lo:hi].tolist()
    end = library.token_to_id(packing.TEXT_END)
    for doc, text in rows:
        whole = [x for (d, _), p in sorted(pieces.items()) if d == doc for x in p]
        assert whole == [*library.encode(text or "", add_special_tokens=False).ids, end]
    assert packing.pack_tokens(docs([]), spec).count() == 0


def test_packing_query_packs_tokens(spark, documents, tokenizer_file):
    library = Library.from_file(tokenizer_file)
    want = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in documents.select("text").collect())
    assert QUERIES["op10_token_packing"](spark, "/root/testdata/sf0.001").agg(F.sum("n_ids")).first()[0] == want

"""Exact, near, line and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from placeweave.llm import exact_dedup, line_dedup, simhash, substring_dedup
from placeweave.llm.components import connected_components


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


# ---------------------------------------------------------------- exact dedup

CASES = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (4, None), (2, ""), (7, " "), (3, "a\tb"), (None, "z"), (8, "z"), (None, "q"),
         (None, "q"), (11, "\xa0x"), (12, "x")]


def exact_rows(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in frame.collect()), key=repr)


def test_exact_groups(docs):
    want = []
    for text in {normal(t) for _, t in CASES}:
        ids = [i for i, t in CASES if normal(t) == text]
        keep = min((i for i in ids if i is not None), default=None)
        left = 1
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            want.append((i, keep, len(ids), i == keep and left > 0, hashlib.sha256(text.encode()).hexdigest()))
            left -= i == keep
    assert exact_rows(exact_dedup.duplicate_groups(docs(CASES))) == sorted(want, key=repr)


def test_exact_collisions_are_told_apart(docs):
    found = exact_dedup.duplicate_groups(docs(CASES), hash_of=lambda c: F.lit(b"same"))
    assert exact_rows(found) == exact_rows(exact_dedup.duplicate_groups(docs(CASES)))


def test_exact_drop_keeps_columns_and_one_of_each(docs):
    kept = exact_dedup.drop_exact_duplicates(docs(CASES))
    assert kept.columns == docs([]).columns
    texts = [normal(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({normal(t) for _, t in CASES})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 3, 7, 8, 9, 11, 12]


def test_exact_empty_table(docs):
    assert exact_dedup.duplicate_groups(docs([])).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs([])).count() == 0


# ---------------------------------------------------------------- components

@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)]
    edges += [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in root}
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {(r.node, r.root) for r in found} == want and len({r.node for r in found}) == len(found)


# ---------------------------------------------------------------- SimHash

def slow_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(codes):
    """Smallest id reachable per row of (id, code)."""
    group = {c: c for _, c in codes}
    distinct = sorted(group)

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                group[find(a)] = find(b)
    low = {}
    for i, c in codes:
        if i is not None:
            low[find(c)] = min(low.get(find(c), i), i)
    return [(i, c, low.get(find(c))) for i, c in codes]


def test_near_duplicates(docs, documents):
    base = documents.filter(F.length("text") > 1500).orderBy("doc_id").first().text
    words = base.split()
    edits = [(1000 + i, " ".join(words[:i] + ["x"] + words[i + 1:])) for i in range(0, 30)]
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()] + edits
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One TWO"), (2004, "one two"), (None, "one  two"), (None, "q"), (1000, "other text")]
    want = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    found = simhash.near_duplicates(docs(rows)).select("doc_id", simhash.hex16(F.col("code")).alias("f"), "component_id")
    assert sorted(((r.doc_id, int(r.f, 16), r.component_id) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_near_links_over_many_blocks(spark, monkeypatch):
    """A ball of near copies, random codes and chains, with blocks small enough for three levels."""
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 2**63))
    codes = {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (700, 2))}
    codes |= {int(x) for x in rng.integers(0, 2**64, 1500, dtype=np.uint64)}
    for start in list(codes)[:100]:
        codes |= {start ^ 7, start ^ 63, start ^ (0xF << 60)}
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "FANOUT", 4)
    signed = [(c - 2**64 if c >= 2**63 else c,) for c in codes]
    links = simhash.near_links(spark.createDataFrame(signed, "code long"))
    roots = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    want = slow_components([(c, c & (2**64 - 1)) for (c,) in signed])
    groups, mine = {}, {}
    for c, _, low in want:
        groups.setdefault(low, set()).add(c)
        mine.setdefault(roots.get(c, c), set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_gray_rank_orders_the_gray_sequence(spark):
    codes = [i ^ (i >> 1) for i in range(64)]
    ranks = spark.createDataFrame([(c,) for c in codes], "c long").select(simhash.gray_rank(F.col("c")).alias("r")).collect()
    assert [r.r + 2**63 for r in ranks] == list(range(64))


def test_near_drop(docs):
    rows = [(4, "a b c d"), (2, "A b  c D"), (9, "something else entirely here"), (2, "A b  c D"), (2, "a b c d"), (None, "n"), (None, "n")]
    kept = simhash.drop_near_duplicates(docs(rows))
    assert kept.columns == docs([]).columns
    assert sorted(map(repr, [(r.doc_id) for r in kept.collect()])) == ["2", "9", "None"]
    assert simhash.drop_near_duplicates(docs([])).count() == 0


# ---------------------------------------------------------------- lines

def slow_lines(rows):
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, xxh_signed(r[1] or "")))
    for i, text in order:
        lines = (text or "").split("\n")
        for at in range(len(lines) - 2):
            window = tuple(lines[at:at + 3])
            if any(x.strip(" \t\n\x0b\x0c\r") for x in window):
                seen.setdefault(window, (i, text or "", at))
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = {k for at in range(len(lines) - 2) if any(x.strip(" \t\n\x0b\x0c\r") for x in lines[at:at + 3])
                and seen[tuple(lines[at:at + 3])] != (i, text or "", at) for k in (at, at + 1, at + 2)}
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return sorted(out, key=repr)


def xxh_signed(text):
    value = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return value - 2**64 if value >= 2**63 else value


LINES = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "a\nb\nc\nd\n"), (3, "a\nb\nc\nd\n"), (4, "k\nk\nk\nk\nk\nk"), (5, None), (6, ""),
         (7, "a\nb"), (8, "\n\n\n\n"), (9, "\n\n\n \n"), (None, "q\na\nb\nc\nr"), (10, "b\nc\nd\ny\na\nb\nc"), (3, "c\nb\na\nc\nb\na"),
         (11, "\t\n \t\n\r\n\t"), (12, "\t\n \t\n\r\n\t"), (13, "\t\n \t\nz\n\t"), (14, "\t\n \t\nz\n\t")]


def test_lines(docs):
    found = line_dedup.drop_repeated_lines(docs(LINES)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found), key=repr) == slow_lines(LINES)
    assert line_dedup.drop_repeated_lines(docs([])).count() == 0


def test_lines_random(docs):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for i in range(120)]
    found = line_dedup.drop_repeated_lines(docs(rows)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found), key=repr) == slow_lines(rows)


# ---------------------------------------------------------------- sentence spans

def slow_spans(rows):
    seen = {}
    spans = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, xxh_signed(r[1] or ""))):
        _, first, after, hashes = substring_dedup.spans_of([(text or "").encode()])
        spans[(i, text or "")] = [(int(a), int(b), tuple(h)) for a, b, h in zip(first, after, hashes.tolist(), strict=True)]
        for start, _, h in spans[(i, text or "")]:
            seen.setdefault(h, (i, text or "", start))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = {k for start, end, h in spans[(i, text or "")] if seen[h] != (i, text or "", start)
                for k in range(start, end)}
        out.append((i, bytes(x for k, x in enumerate(data) if k not in gone).decode(), len(gone)))
    return sorted(out, key=repr)


def test_substring(docs, documents):
    rng = random.Random(2)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    passage = " ".join(rows[3][1].split()[:90])
    rows += [(5000 + i, " ".join([f"w{rng.random()}" for _ in range(9)] + [passage] + [f"v{rng.random()}." for _ in range(9)]))
             for i in range(5)]
    rows += [(6000, None), (6001, ""), (6002, "one. two. three."), (None, passage), (7000, passage), (7000, passage), (7000, "x " + passage)]
    found = {}
    result = substring_dedup.drop_repeated_spans(docs(rows)).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in result), key=repr) == slow_spans(rows)
    found = {r.doc_id: r for r in result}
    assert all(len(found[5000 + i].text.split()) < 18 + 40 for i in range(5))
    assert found[6002].text == "one. two. three."
    assert substring_dedup.drop_repeated_spans(docs([])).count() == 0


@pytest.mark.parametrize("text", ["", "a", "a.b c", "One two. Three!\nFour", "word " * 50, " é ü.\n\n x? y ", "...", "\n", "a, b c d " * 9])
def test_sentences_cover_the_words(text):
    data = text.encode()
    starts, ends, words = substring_dedup.sentences(data)
    parts = [data[i:j] for i, j in zip(starts, ends, strict=True)]
    assert [len(p.split()) for p in parts] == words.tolist() and b" ".join(parts).split() == data.split()


def test_sentence_ends():
    text = b"One two. Three! Four\nfive 3.5 six? " + b"w1 w2 " * 10
    starts, ends, _ = substring_dedup.sentences(text)
    assert [text[i:j] for i, j in zip(starts, ends, strict=True)][:4] == [b"One two.", b"Three!", b"Four", b"five 3.5 six?"]


def test_spans_are_the_shortest_long_enough_runs(monkeypatch):
    monkeypatch.setattr(substring_dedup, "RUN_WORDS", 10)
    text = b"a b c. d e f g. h i j k l. m n. o."
    texts, first, after, _ = substring_dedup.spans_of([b"x y.", text, b"", text])
    assert texts.tolist() == [1, 1, 3, 3]
    assert [text[i:j] for i, j in zip(first, after, strict=True)] == 2 * [text[:27], text[7:32]]

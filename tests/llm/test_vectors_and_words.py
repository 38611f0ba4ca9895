"""Spelling variants, near vectors and whitening against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeweave.llm import pivots, spelling, whitening

# ---------------------------------------------------------------- spelling

FALL = str.maketrans(spelling.UPPER, spelling.LOWER)


def slow_words(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def slow_variants(rows):
    words = slow_words(rows)
    by_size = collections.defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    out, form = {}, {}
    for w, n in words.items():
        close = [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best
        out[w] = [form.get(w), w, n, len(close), words[best] if w in form else None]
    for w, row in out.items():
        while row[1] in form:
            row[1] = form[row[1]]
    return {w: tuple(row) for w, row in out.items()}


def variants(df, **options):
    rows = spelling.spelling_variants(df, **options).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_agree_with_all_pairs(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = slow_variants(rows)
    assert variants(documents) == want and len(want) > 1000


@pytest.mark.parametrize("options", [{}, {"slice_words": 4, "round_bytes": 30}, {"slice_words": 7, "round_bytes": 100}])
def test_variants_of_odd_texts(docs, options):
    wave = "colorédne"
    long = "".join(chr(97 + (i * i) % 26) for i in range(90))
    rows = [(i, " ".join([wave] * 9 + ["letters"] * 5)) for i in range(20)]
    rows += [(100 + i, f"{wave[:-1]} {wave}x {wave[:3]}z{wave[4:]} lettrs lettters lettets LETTERS Étranger étranger") for i in range(4)]
    rows += [(200 + i, f"{long} {long[:40]}{long[41:]} {long[:50]}Q{long[51:]} {long[:63]} {long[:64]} {long[:65]}") for i in range(3)]
    rows += [(7, "aaaaaaaa aaaaaaa aaaaaaaaa " * 30), (7, "aaaaaaaa aaaaaaa aaaaaaaaa " * 30), (None, "aaaaaaab aaaaaaab caaaaaaa"), (8, None), (9, ""),
             (10, "x1 y2 seven7letters under_scored words"), (11, "abcdefg " * 50_000), (12, "abcdefh abcdefh abcdeg abcdeg abcdefgh " * 20)]
    got = variants(docs(rows), **options)
    assert got == slow_variants(rows)
    assert any(r[0] for r in got.values()) and any(r[3] > 2 for r in got.values())


def test_forms_are_followed_to_the_end(docs):
    rows = [(i, "sternly " * 2 + "sternlz " * 30 + "sternmz " * 400) for i in range(0, 3)]
    got = variants(docs(rows))
    assert got == slow_variants(rows)
    assert {got[w][1] for w in ("sternly", "sternlz")} == {"sternmz"} and got["sternly"][0] == "sternlz"


def test_no_words(docs):
    assert variants(docs([])) == {} and variants(docs([(1, None), (2, "a bb"), (3, "oneword")])) == {}


def test_filters_hold_what_they_were_built_from():
    words = [f"word{i}é" for i in range(5000)]
    h = spelling.hashes(words)
    assert len(set(h.tolist())) == 5000
    lanes = spelling.blocked_filter(h)
    assert len(spelling._held(lanes, h)) == 5000
    others = spelling.hashes([f"other{i}" for i in range(20000)])
    assert len(spelling._held(lanes, others)) < 200


# ---------------------------------------------------------------- near vectors

def slow_near(rows, cosine=0.9):
    able = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    root = list(range(len(rows)))
    links = [0] * len(rows)
    unit = {i: np.array(rows[i][1], dtype=float) / np.linalg.norm(rows[i][1]) for i in able}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for x in able:
        for y in able:
            if x < y and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= cosine:
                links[x] += 1
                links[y] += 1
                a, b = sorted((top(x), top(y)))
                root[b] = a
    low = collections.defaultdict(list)
    for i in range(len(rows)):
        low[top(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return collections.Counter((rows[i][0], links[i], least[top(i)], rows[i][0] == least[top(i)]) for i in range(len(rows)))


def vectors(spark, rows, kind="float"):
    full = [(i, v, "mine", -1) for i, v in rows]
    return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, kept string, n_links int")


def found_near(df, **options):
    return collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(df, **options).collect())


def groups(seed, sizes, d=24, noise=0.07):
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        middle = rng.normal(size=d)
        middle /= np.linalg.norm(middle)
        out += [(middle + rng.normal(0, noise, d)).astype(np.float32).tolist() for _ in range(size)]
    return [(i, v) for i, v in enumerate(out)]


def test_index_finds_the_links(spark):
    rows = groups(1, [150, 40, 9, 5, 2, *[1] * 200])
    want = slow_near(rows)
    got = found_near(vectors(spark, rows), block=32, tile=16)
    links = sum(n * c for (_, n, _, _), c in want.items())
    assert links > 5000 and sum(n * c for (_, n, _, _), c in got.items()) >= 0.98 * links
    exact = {r[0]: r[1] for r in want}
    assert all(r[1] <= exact[r[0]] for r in got)
    assert {r[0]: r[2] for r in got} == {r[0]: r[2] for r in want}


def test_a_group_with_a_third_of_all_rows(spark):
    rows = groups(2, [400, *[1] * 800], noise=0.05)
    got, want = found_near(vectors(spark, rows), block=64, tile=32), slow_near(rows)
    assert got == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.4]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]), (8, [nan, 1.0]),
            (9, [inf, 1.0]), (10, [1.0]), (11, [-5.0]), (12, [3.0]), (None, [1.0, 0.0]), (None, [0.0, -1.0]), (3, [0.0, 1.0]),
            (3, [0.0, 1.0]), (13, [0.0, -1.0]), (14, [-0.0, 1.0])]
    for kind in ("float", "double"):
        assert found_near(vectors(spark, rows, kind)) == slow_near(rows)
    assert found_near(vectors(spark, [])) == collections.Counter()
    assert found_near(vectors(spark, [(5, None)])) == {(5, 0, 5, True): 1}
    assert pivots.near_vectors(vectors(spark, rows)).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_pivots_lie_apart():
    unit = pivots.units(np.random.default_rng(3).normal(size=(700, 3)))
    kept = pivots.apart(unit, 0.9)
    near = unit[kept] @ unit[kept].T - np.eye(len(kept)) >= 0.9
    assert not near.any() and (unit @ unit[kept].T >= 0.9 - 1e-12).any(axis=1).all()


# ---------------------------------------------------------------- whitening

def slow_whitened(vectors_in):
    x = np.floor(64 * np.array(vectors_in, dtype=float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(axis=1), centred, values[::-1], axes[:, ::-1]


def check_whitened(spark, rows, components=32):
    found = whitening.whitened(vectors(spark, rows, "double"), components=components).toPandas()
    n, deviation, centred, values, axes = slow_whitened([v for _, v in rows])
    some = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(found) == n * some and set(found.n) == {n} and found.identity_error.max() <= 1e-9
    assert np.allclose(found.groupby("component").explained.first(), values[:some] / values.sum(), rtol=1e-9)
    wide = found.pivot(index="vec_id", columns="component", values="whitened")
    assert (found.groupby("vec_id").deviation.first().loc[[i for i, _ in rows]].to_numpy() == deviation).all()
    return wide.loc[[i for i, _ in rows]].to_numpy(), (centred @ axes[:, :some]) / np.sqrt(values[:some])


def test_whitening_agrees_with_eigenvectors(spark):
    rng = np.random.default_rng(4)
    spread = rng.normal(size=(300, 40)) * np.linspace(1, 30, 40)
    got, want = check_whitened(spark, [(i, v.tolist()) for i, v in enumerate(spread)])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8


def test_whitening_of_dependent_and_equal_dimensions(spark):
    rng = np.random.default_rng(5)
    base = np.floor(rng.normal(0, 20, size=(60, 3)))
    rows = [(i, [a, b, c, a, 7.0, -b]) for i, (a, b, c) in enumerate(base.tolist())]
    got, want = check_whitened(spark, rows)
    assert got.shape[1] == 3
    equal = [(i, [float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)]) for i in range(8)]  # one deviation, three times
    got, _ = check_whitened(spark, equal)
    assert got.shape[1] == 3 and np.abs(got.T @ got / 8 - np.eye(3)).max() < 1e-9
    few = [(i, rng.normal(0, 9, 10).tolist()) for i in range(4)]
    assert check_whitened(spark, few, components=2)[0].shape[1] == 2


def test_whitening_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (None, [0.0, 5.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [None, 1.0]),
            (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.0])]
    found = whitening.whitened(vectors(spark, rows)).collect()
    assert collections.Counter(r.vec_id for r in found) == {1: 2, 2: 4, None: 2, 9: 2} and {r.n for r in found} == {5}
    for none in ([], [(1, None)], [(1, [2.0, 1.0])], [(i, [2.0, 1.0]) for i in range(5)]):
        out = whitening.whitened(vectors(spark, none))
        assert out.count() == 0 and [c for c, _ in out.dtypes] == [f.split()[0] for f in whitening._OUT.format("long").split(", ")]


def test_whitening_of_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = whitening.whitened(rows).groupBy("component").agg(
        F.count("*").alias("n"), F.avg("whitened").alias("m"), F.var_pop("whitened").alias("v")).collect()
    assert len(found) == 32 and all(r.n == 500 and abs(r.m) < 1e-9 and abs(r.v - 1) < 1e-9 for r in found)

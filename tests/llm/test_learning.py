"""Quality, mixing, pseudonyms, top-k and the pipeline."""

import datetime
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from placeweave.llm import mixing, pseudonyms, quality, topk

# ---------------------------------------------------------------- quality


def test_gradients():
    rng = np.random.default_rng(0)
    x, starts, y = rng.random((7, quality._SIZE)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    shapes = {"H": (quality._SIZE, 3), "h": (3,), "V": (3, 2), "U": (3, 2), "a": (2,), "c": (3,), "d": (1,)}
    w = {k: rng.normal(0, 0.5, s) for k, s in shapes.items()}

    def loss():
        p = quality._forward(w, x, starts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    for k, g in quality._gradients(w, x, starts, y).items():
        for at in [tuple(rng.integers(0, n) for n in w[k].shape) for _ in range(4)]:
            w[k][at] += 1e-6
            high = loss()
            w[k][at] -= 2e-6
            low = loss()
            w[k][at] += 1e-6
            assert abs((high - low) / 2e-6 - g[at]) < 1e-5


def test_held_out_accuracy(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    found = quality.scored(read("documents"), read("labels")).collect()
    labels = {r.doc_id: r.quality for r in read("labels").collect()}
    assert len(found) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    test = [r for r in found if r.held_out and r.doc_id in labels]
    assert len(test) > 60 and sum(r.predicted == labels[r.doc_id] for r in test) / len(test) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_quality_odd_input(spark, docs):
    rows = [(1, None), (2, ""), (3, "x"), (None, "y z"), (3, "again"), (4, "long " * 30000)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 5), (77, 0)], "doc_id long, quality int")
    for labels in (none, odd):
        found = quality.scored(docs(rows), labels).collect()
        assert sorted(r.doc_id or 0 for r in found) == [0, 1, 2, 3, 3, 4] and {r.score for r in found} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    assert quality.keep_good(docs(rows), ones).columns == docs([]).columns
    assert quality.scored(docs([]), ones).count() == 0


def test_repeated_ids_are_learned_once(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels: seen.append((bags, labels)) or quality.Model(0.5))
    rows = [(i, f"Text {i}. " + "word, " * k + "end" * (k + i)) for i in range(12) for k in range(6)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    for some in (rows, rows[::-1]):
        quality.learn(docs(some), labels, sample_docs=12)
    learned = labels.filter(~quality.held_out(F.col("doc_id"))).count()
    (bags, truth), (again, same) = seen
    assert len(bags) == len(again) == learned and truth.tolist() == same.tolist()
    assert all(np.array_equal(a, b) for a, b in zip(bags, again, strict=True))


def test_all_passages_of_the_sample_are_learned(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels: seen.append(bags) or quality.Model(0.5))
    rows = [(i, f"{i} " + "word " * 20_000) for i in range(20)] + [(99, "far too long " * 90_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    learned = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2]
    quality.learn(docs(rows), labels)
    quality.learn(docs(rows), labels, sample_bytes=250_000)
    assert [len(b) for b in seen[0]] == [-(-(100_000 + len(str(i))) // 512) for i in learned] and len(seen[1]) == 2


def test_passages_read_whole_texts():
    text = b"word " * 5000
    counts = quality.passage_counts(text)
    assert counts[:, :quality._STEPS].sum() == len(text) - 1 and counts[:, -1].sum() == 5000 and counts[:, -2].sum() == 4999


# ---------------------------------------------------------------- mixing

def slow_targets(totals):
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        free = [s for s in names if s not in full]
        rest = sum(totals.values()) - sum(3 * totals[s] for s in full)
        level = rest / sum(weight[s] for s in free) if free else 0
        target = {s: 3 * totals[s] if s in full else level * weight[s] for s in names}
        more = {s for s in free if target[s] > 3 * totals[s]}
        if not more:
            return target
        full |= more


def test_mix(docs):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 40)), s) for i, s in enumerate(
        ["a"] * 900 + ["b"] * 20 + ["c"] * 300 + [None] * 60 + [""] * 50 + ["é"] * 3 + ["Z"] * 200)]
    rows += [(5, "w w", "a"), (None, "n n", "b"), (9999, None, "c")]
    found = mixing.mix_sizes(docs(rows), block_words=500).collect()
    assert len(found) == len(rows)
    size = lambda t: len((t or "").split())
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    target = slow_targets(totals)
    assert sorted((r.size, r.source_size) for r in found) == sorted((size(t), totals[s]) for _, t, s in rows)
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in found:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size and len(r.shards) >= r.taken // max(r.size, 1)
        assert all(0 <= x < 64 for x in r.shards)
        if r.doc_id is not None:
            assert r.target == pytest.approx(target[source[r.doc_id]])
        taken[source.get(r.doc_id, "b")] = taken.get(source.get(r.doc_id, "b"), 0) + r.taken
    for s, words in taken.items():
        assert abs(words - target[s]) <= 20, (s, words, target[s])
    again = mixing.mix_sizes(docs(rows[::-1]), block_words=500).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_split_is_exact_and_random(spark, docs):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(4000)]
    plan = mixing.plan_mix(docs(rows), block_words=50)
    shards = [x for r in plan.blocks.collect() for x in r.shards]
    counts = np.bincount(shards, minlength=64)
    assert counts.sum() == sum(len(r.shards) for r in plan.blocks.collect()) and counts.max() - counts.min() <= 2
    per_source = np.array([np.bincount([x for r in plan.blocks.filter(F.col("number") == n).collect() for x in r.shards], minlength=64)
                           for n in (0, 1)])
    assert per_source.std(axis=1).min() > 0.3  # drawn, not dealt in turn


def test_mix_rows_and_empty(docs):
    rows = [(i, "w " * 5, "ab"[i % 10 == 0]) for i in range(200)]
    sizes = {r.doc_id: r.taken // 5 for r in mixing.mix_sizes(docs(rows)).collect()}
    mixed = mixing.mix(docs(rows), shard_col="shard")
    assert mixed.columns == [*docs([]).columns, "shard"]
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in sizes.items() if n}
    assert mixing.mix_sizes(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0


def test_rows_without_an_id_are_mixed(docs):
    rows = [(None, f"a{i} " + "x " * 99, "a") for i in range(200)] + [(i, "y " * 100, "b") for i in range(200)]
    taken = {}
    for r in mixing.mix_sizes(docs(rows)).collect():
        taken[r.target] = taken.get(r.target, 0) + r.taken
    assert len(taken) == 2 and all(abs(t - n) <= 100 for t, n in taken.items())


@pytest.mark.parametrize("first", [0, 1000, 2000, 3000])
@pytest.mark.parametrize("block_words", [700, 100_000])
def test_long_documents_are_stepped_over(docs, first, block_words):
    rows = [(first, "w " * 60_000, "a")] + [(first + i, "w " * 500, "a") for i in range(1, 41)]
    rows += [(first + 100 + i, f"b{i} " * 300, "b") for i in range(50)]
    sums = {}
    for r in mixing.mix_sizes(docs(rows), block_words=block_words).collect():
        assert r.taken <= 3 * r.size and len(r.shards) == r.taken // r.size
        taken, _ = sums.get(r.source_size, (0, 0))
        sums[r.source_size] = taken + r.taken, r.target
    assert abs(sums[80_000][0] - sums[80_000][1]) < (500 if sums[80_000][1] % 60_000 <= 20_000 else 60_000)
    assert abs(sums[15_000][0] - sums[15_000][1]) <= 150


def test_what_is_left_does_not_fit(docs):
    """With one id throughout, lengths far apart and small blocks, each source ends by its shortest document not taken."""
    rng = np.random.default_rng(4)
    rows = [(7, f"{i} " + "w " * int(rng.geometric(.01)), "abc"[i % 3]) for i in range(900)] + [(7, "0 " + "w " * 30_000, "b")]
    found = mixing.mix_sizes(docs(rows), block_words=900).collect()
    assert len(found) == len(rows)
    for size in {r.source_size for r in found}:
        own = [r for r in found if r.source_size == size]
        most = max(r.taken // r.size for r in own)
        left = min((r.size for r in own if r.taken // r.size < most), default=1)
        assert abs(sum(r.taken for r in own) - own[0].target) < left
        assert all(len(r.shards) == r.taken // r.size for r in own)


def test_more_words_make_more_shards(docs):
    rows = [(i, "x " * 100, "a") for i in range(600)]
    few, many = (mixing.mix_sizes(docs(rows), block_words=200, shard_words=w) for w in (10_000, 100))
    top = lambda df: max(s for r in df.collect() for s in r.shards)
    assert top(few) < 64 <= top(many) < 4096


# ---------------------------------------------------------------- pseudonyms

def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def changed(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.found) for r in pseudonyms.pseudonymised(rows, key).orderBy("doc_id").collect()]


def test_pseudonyms_keep_formats(spark):
    found = changed(spark, [
        "mail bob.smith9@mail7.example.com, and", "at 10.0.0.255. x", "4111111111111111 or 4111111111111112", "4111-1111-1111-1111",
        "call +1 (017) 555-7713 (212) 555-0000", "on 2024-02-29, 31/12/1999, 12/31/1999, 2023-02-30", "ssn 123-45-6789 000-12-3456",
        "999.1.1.1 1.2.3.4.5 x4111111111111111", None, "", "nothing here"])
    assert re.fullmatch(r"mail [a-z]{3}\.[a-z]{5}\d@mail7\.example\.com, and", found[0][0]) and "bob.smith9" not in found[0][0]
    address = re.fullmatch(r"at (\d+)\.(\d+)\.(\d+)\.(\d+)\. x", found[1][0])
    assert all(int(x) < 256 for x in address.groups()) and "10.0.0.255" not in found[1][0]
    card, wrong = found[2][0].split(" or ")
    assert luhn(card) and card != "4111111111111111" and wrong == "4111111111111112" and found[2][1] == 1
    assert found[3][0].replace("-", "") == card and re.fullmatch(r"\d{4}(-\d{4}){3}", found[3][0])
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} \(\d{3}\) \d{3}-\d{4}", found[4][0]) and found[4][1] == 2
    iso, day, month, bad = found[5][0][3:].split(", ")
    assert datetime.date.fromisoformat(iso) and bad == "2023-02-30" and found[5][1] == 3
    assert datetime.datetime.strptime(day, "%d/%m/%Y") == datetime.datetime.strptime(month, "%m/%d/%Y")
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4} 000-12-3456", found[6][0]) and found[6][1] == 1
    assert found[7] == ("999.1.1.1 1.2.3.4.5 x4111111111111111", 0)
    assert found[8:] == [("", 0), ("", 0), ("nothing here", 0)]


def test_pseudonyms_of_phones_and_short_dates(spark):
    phones = ["(212) 555-0000", "212-555-0000", "212.555.0000", "212 555 0000", "1-212-555-0000", "+1-212-555-0000", "+44 20 7946 0958",
              "+442079460958", "+49 (30) 1234567", "+353 1 234 5678", "(212)555.0000"]
    found = changed(spark, [f"call {p}, or" for p in phones])
    for phone, (text, n) in zip(phones, found, strict=True):
        assert n == 1 and phone not in text and re.sub(r"\d", "0", text) == re.sub(r"\d", "0", f"call {phone}, or")
    digits = [re.sub(r"\D", "", t)[-10:] for t, _ in found]
    assert len({digits[i] for i in (0, 1, 2, 3, 4, 5, 10)}) == 1 and found[6][0].startswith("call +44 ") and found[9][0].startswith("call +353 ")
    dates = changed(spark, ["3/5/2021", "03/05/2021", "2021-5-3", "1.12.1999", "5/31/2021", "31/2/2021"])
    parts = [[int(x) for x in re.split(r"[-/.]", t)] for t, _ in dates]
    assert [n for _, n in dates] == [1, 1, 1, 1, 1, 0] and parts[0] == parts[1] == parts[2][::-1] != [3, 5, 2021]
    assert all(datetime.date(*reversed(p)) for p in (parts[0], parts[3])) and datetime.date(parts[4][2], *parts[4][:2])


def test_pseudonyms_behind_marks(spark):
    found = changed(spark, ["end.4111111111111111", "no-4111111111111111", "_4111111111111111", "%10.1.2.3", "+4111111111111111",
                            "on.2024-02-29", "7.4111111111111111", "12-4111111111111111"])
    assert [n for _, n in found] == [1] * 6 + [0] * 2 and "4111111111111111" not in "".join(t for t, _ in found[:6])


def test_pseudonyms_are_permutations_under_a_key(spark):
    dates = [(datetime.date(1900, 1, 1) + datetime.timedelta(days=d)).isoformat() for d in range(0, 73049, 61)]
    for values in (dates, [f"{a}.0.0.{b}" for a in range(1, 20) for b in range(20)], [f"{a:03d}-01-{b:04d}" for a in (1, 665, 667, 899) for b in range(1, 60)]):
        new = [t for t, n in changed(spark, values) if n == 1]
        assert len(set(new)) == len(values) and set(new) != set(values)
    assert changed(spark, ["2020-01-01 2020-01-01"])[0][0].split()[0] == changed(spark, ["x 2020-01-01"])[0][0].split()[1]
    assert changed(spark, ["4111111111111111"]) != changed(spark, ["4111111111111111"], "other")


def test_pseudonyms_over_documents(documents):
    found = {r.doc_id: r for r in pseudonyms.pseudonymised(documents, "k").collect()}
    for r in documents.collect():
        mails = set(re.findall(r"(?<![\w.])[\w.]+@mail\d\.example\.com", r.text))
        cards = {c for c in re.findall(r"(?<![\w.])\d{16}(?!\d)", r.text) if luhn(c)}
        assert not any(x in found[r.doc_id].text for x in mails | cards)
        if not re.search(r"\d", r.text):
            assert found[r.doc_id].text == r.text


# ---------------------------------------------------------------- top-k

def slow_top(rows, k):
    v = [(i, np.floor(256 * np.array(x, dtype=float)).astype(int)) for i, x in rows if i is not None and x and None not in x
         and np.isfinite(np.array(x, dtype=float)).all()]
    out = []
    for at, (q, x) in enumerate(v):
        if q % 50 == 0:
            scores = sorted((-int(x @ y), c) for other, (c, y) in enumerate(v) if other != at and len(x) == len(y))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out)


def run_top(frame, **options):
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0, **options)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 8).round(1).tolist()) for i in range(400)]
    rows += [(450, None), (451, [1.0, None] * 4), (452, [float("nan")] * 8), (453, [float("inf")] * 8), (None, [0.1] * 8),
             (500, [0.0] * 8), (550, [1.0, 2.0]), (551, [2.0, 1.0]), (600, [])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    want = slow_top([(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows], 5)
    assert run_top(frame) == want and run_top(frame, block=50, batch=3) == want
    twice = rows + rows
    assert run_top(frame.unionByName(frame)) == slow_top([(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x])
                                                          for i, x in twice], 5)
    several = [(50, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (2, [0.1, 0.0]), (50, [2.0, 0.0])]
    found = run_top(spark.createDataFrame(several, "vec_id long, embedding array<double>"))
    assert found == slow_top(several, 5) and found[0][2:] == (50, 131072) and (50, 2, 1, 58880) in found
    assert run_top(frame.filter("false")) == []


def test_top_k_of_large_numbers_and_skewed_data(spark):
    rows = [(i, [float(2 ** 21 + i), -1.0]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run_top(frame) == slow_top(rows, 5)
    lists = topk.Lists(np.arange(5000), np.arange(5000), np.outer(np.arange(5000), np.ones(4)).astype(float))
    ids, scores = lists.top(-1, np.ones(4), 3)
    assert ids.tolist() == [4999, 4998, 4997]


def feistel(symbols, key):
    """The network of the docstring in plain Python: (value, range) pairs to values."""
    half = len(symbols) // 2
    sides = [list(symbols[:half]), list(symbols[half:])]
    for turn in range(pseudonyms.ROUNDS):
        mine, other = sides[turn % 2], sides[1 - turn % 2]
        told = ",".join([*(str(v) for v, _ in other), str(len(mine))])
        for i, (v, n) in enumerate(mine):
            digest = hashlib.sha256("|".join([key, str(turn), told, str(i), str(n)]).encode()).hexdigest()
            mine[i] = ((v + int(digest[:12], 16)) % n, n)
    return [v for side in sides for v, _ in side]


def by_character(value, key, check=False):
    solid = [c for c in value if c.isalnum()]
    base = [48 if c.isdigit() else 97 if c.islower() else 65 for c in solid]
    symbols = [(ord(c) - b, 10 if b == 48 else 26) for c, b in zip(solid, base)]
    new = feistel(symbols[:-1] if check else symbols, key)
    if check:
        doubled = [d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(new))]
        new.append(-sum(doubled) % 10)
    put = iter(chr(v + b) for v, b in zip(new, base))
    return "".join(next(put) if c.isalnum() else c for c in value)


def plain_date(value, order, key):
    mark, parts = re.search("[-/.]", value)[0], re.split("[-/.]", value)
    try:
        day = datetime.date(**{name: int(p) for name, p in zip(order, parts)})
    except ValueError:
        return None
    if not 1900 <= day.year <= 2099:
        return None
    start, (one, two) = datetime.date(1900, 1, 1), pseudonyms._DAYS
    high, low = divmod((day - start).days, two)
    high, low = feistel([(high, one), (low, two)], f"{key}|date")
    new = start + datetime.timedelta(days=high * two + low)
    wide = {"year": 4, "month": 2, "day": 2}
    return mark.join(str(getattr(new, name)).zfill(1 if len(p) == 1 else wide[name]) for name, p in zip(order, parts))


def plain_pseudonym(value, key):
    kind = next(k for k in ("email", "ip", "iso_date", "day_first", "ssn", "phone", "card")
                if re.fullmatch(pseudonyms._KINDS[k], value, re.ASCII))
    if kind == "email":
        name, _, domain = value.partition("@")
        return by_character(name, f"{key}|mail") + "@" + domain
    if kind == "ip":
        octets = [int(o) for o in value.split(".")]
        return ".".join(map(str, feistel([(o, 256) for o in octets], f"{key}|ip"))) if max(octets) < 256 else None
    if kind == "iso_date":
        return plain_date(value, ("year", "month", "day"), key)
    if kind == "day_first":
        return plain_date(value, ("day", "month", "year"), key) or plain_date(value, ("month", "day", "year"), key)
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        a, g, n = feistel([(areas.index(area), 898), (group - 1, 99), (serial - 1, 9999)], f"{key}|ssn")
        return f"{areas[a]:03d}-{g + 1:02d}-{n + 1:04d}"
    if kind == "phone":
        code = re.match(r"(?:\+\d{1,3}(?=[-. (])|\+\d{1,2}|1(?=[-. (]))? ?", value)[0]
        return code + by_character(value[len(code):], f"{key}|phone")
    digits = [int(c) for c in value if c.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return by_character(value, f"{key}|card", check=True) if sum(doubled) % 10 == 0 else None


def plain_texts(rows, key):
    out = []
    for id_, text in rows:
        found = 0

        def put(m):
            nonlocal found
            new = plain_pseudonym(m[0], key)
            found += new is not None
            return m[0] if new is None else new
        new = re.sub(pseudonyms._ANY, put, text or "", flags=re.ASCII)
        out.append((id_, new, found))
    return sorted(out, key=repr)


def test_pseudonyms_against_plain_python(spark, docs, documents):
    rng = np.random.default_rng(6)
    made = ["4111 1111 1111 1111", "4111 1111 1111 1112", "378282246310005", "999.1.1.1", "10.0.255.1", "2021-02-30", "29.02.2000",
            "12/31/1999", "3/5/2021", "1899-12-31", "078-05-1120", "666-05-1120", "665-99-9999", "+44 20 7946 0958", "1-212-555-0000",
            "(212) 555-0000", "A.b-9@mail.example.org", "x@y.z"]
    made += [f"{rng.integers(1, 13)}/{rng.integers(1, 32)}/{rng.integers(1890, 2110)}" for _ in range(40)]
    made += [f"{a:03d}-{g:02d}-{n:04d}" for a, g, n in rng.integers((0, 0, 0), (1000, 100, 10000), (40, 3))]
    rows = [(i, f"before {v}, after") for i, v in enumerate(made)]
    rows += [(None, "id-less 10.0.0.1"), (900, None), (901, ""), (902, "none"), (903, "same 10.0.0.1"), (903, "same 10.0.0.1"),
             (904, "mail a.b@c.de " * 3000 + "end 4111111111111111")]
    rows += [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = sorted(map(tuple, pseudonyms.pseudonymised(docs(rows), "k").collect()), key=repr)
    assert got == plain_texts(rows, "k")
    assert sum(n for _, _, n in got) > 3000
    assert pseudonyms.pseudonymised(docs([]), "k").collect() == []


# ---------------------------------------------------------------- pipeline

def test_pipeline_against_its_stages(spark):
    sf_dir = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sizes[0] < spark.read.parquet(f"{sf_dir}/documents.parquet").count() and sizes[1] < sizes[0] and sizes[2] <= sizes[1]
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, last))


def test_pipeline_of_odd_rows(spark, docs, tmp_path, tokenizer_file):
    """NULL and empty texts, NULL ids and sources, repeated rows, a long text and clashing columns; then empty tables."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.source) for r in given]
    rows += [rows[0], rows[0], (None, "words without an id", "s"), (None, "words without an id", "s"), (5001, None, "s"), (5002, "", None),
             (5003, " \t\n", "s"), (5004, "long words " * 50_000, "s")]
    full = docs(rows)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for name, table in (("full", full), ("empty", full.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        (labels if name == "full" else labels.limit(0)).write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    kept = full
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path / "full")).collect(), full.schema)
        assert kept.columns == full.columns, name
        assert kept.exceptAll(before).count() == 0 or name == "mix", name  # whole rows, none made up
        assert kept.distinct().exceptAll(before.distinct()).count() == 0, name
    out = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    known = Tokenizer.from_file(tokenizer_file)
    texts = {r.doc_id: r.text or "" for r in kept.collect()}
    assert len(out) == kept.count() and {r.doc_id for r in out} == set(texts)
    for r in out[:40]:
        assert r.n_tokens == len(r.ids) and list(r.ids) == known.encode(texts[r.doc_id], add_special_tokens=False).ids

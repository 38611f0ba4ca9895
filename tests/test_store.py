"""The keyed store: what a change touches, what readers see, what one key costs."""

import os

import pytest
from pyspark.sql import functions as F

from placeweave.operators.keys import nest_by_key
from placeweave.sources.documents import read_posts, write_documents
from placeweave.sources.store import KeyedStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "s"), "slug string, n int", "slug", buckets=4)


def frame(spark, data):
    return spark.createDataFrame(data, "slug string, n int")


def test_replace_remove_and_earlier_states(spark, store):
    assert rows(store.read()) == [] and store.read().columns == ["slug", "n"] and store.commits() == []
    store.replace(frame(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)]))
    store.replace(frame(spark, [("a", 9), ("c", 4)]))
    now = [("a", 9), ("b", 3), ("c", 4), (None, 4), (None, 5)]
    assert rows(store.read()) == now
    store.replace(frame(spark, [("a", 9), ("c", 4)]))
    assert rows(store.read()) == now
    store.replace(frame(spark, [(None, 6)]).select("slug"))
    assert rows(store.read([None])) == [(None, None)] and rows(store.read(["a", "zz", None])) == [("a", 9), (None, None)]
    store.remove(frame(spark, [("b", 0), ("nothing", 0), (None, 0)]))
    assert rows(store.read()) == [("a", 9), ("c", 4)] and rows(store.read([])) == []
    store.remove(store.read())
    assert rows(store.read()) == [] and len(store.commits()) == 6
    assert rows(store.read(commit=1)) == now
    with pytest.raises(ValueError):
        store.read(commit=17)


def test_untouched_buckets_keep_their_files(spark, store):
    store.replace(frame(spark, [(f"k{i}", i) for i in range(40)]))
    before, state = files(store.root), store.state()
    store.replace(frame(spark, [("k7", 70)]))
    changed = [b for b, v in store.state().items() if state[b] != v]
    assert len(changed) == 1 and before < files(store.root)
    added = files(store.root) - before
    assert all(f"_bucket={changed[0]}" in f for f in added)
    assert rows(store.read()) == rows(frame(spark, [(f"k{i}", 70 if i == 7 else i) for i in range(40)]))


def test_a_broken_change_is_never_seen(spark, store, monkeypatch):
    store.replace(frame(spark, [("a", 1), ("b", 2)]))
    broken = frame(spark, [("a", 5)]).withColumn("n", F.raise_error("lost").cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.replace(broken)
    assert rows(store.read()) == [("a", 1), ("b", 2)]
    commit = f"{store.root}/commits/1"
    frame(spark, []).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(commit)
    assert store.commits() == [0] and rows(store.read()) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        store.replace(frame(spark, [("a", 7)]))  # another writer has this number
    assert rows(store.read()) == [("a", 1), ("b", 2)]


def _scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    node = leaves.apply(0)
    return node.metrics().apply("numFiles").value(), node.metrics().apply("numOutputRows").value()


def test_one_key_of_many_reads_little(spark, tmp_path):
    many = spark.range(200_000).select(F.concat(F.lit("key"), (F.col("id") % 50_000).cast("string")).alias("slug"), F.col("id").cast("int").alias("n"))
    store = KeyedStore(spark, str(tmp_path / "s"), "slug string, n int", "slug", buckets=8, options={"parquet.block.row.count.limit": "1000"})
    store.replace(many)
    folders = {d for d, _, names in os.walk(f"{store.root}/data") if any(f.endswith(".parquet") for f in names)}
    assert len(folders) == 8  # fifty thousand keys, eight folders
    one = store.read(["key123"])
    assert sorted(r.n for r in one.collect()) == [123, 50_123, 100_123, 150_123]
    opened, read = _scanned(store.read(["key123"]))
    assert opened <= 4 and read < 25_000 / 2  # a part of one bucket's row groups
    assert _scanned(store.read(["no such key"]))[1] < 25_000 / 2


def test_documents_are_cut_by_bytes(spark, tmp_path):
    posts = spark.range(300).select(
        F.when(F.col("id") < 200, "long").otherwise("short").alias("slug"), F.col("id").cast("string").alias("id"), F.col("id").alias("at"),
        F.when(F.col("id") < 200, F.repeat(F.lit("words "), 2000)).otherwise("few").alias("title"))
    equal = posts.filter("id = 7").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(60)))).drop("_")
    posts = posts.unionByName(equal)
    nested = nest_by_key(posts, ["slug"], "id", "at", ["id", "title"], document_bytes=100_000)
    sizes = nested.select("slug", "part", F.octet_length(F.to_json("posts")).alias("b"), F.size("posts").alias("n")).collect()
    assert max(r.b for r in sizes) <= 100_000 + 2 * 12_100 and len({(r.slug, r.part) for r in sizes}) == len(sizes)
    assert sum(r.n for r in sizes) == 360 and sum(r.slug == "short" for r in sizes) == 1
    write_documents(nested, str(tmp_path / "d"))
    back, rejects = read_posts(spark, str(tmp_path / "d"))
    assert rejects.count() == 0 and rows(back.select("slug", "post_id", "title")) == rows(posts.select("slug", "id", "title"))

import gzip
import json

import pytest
from pyspark.sql import functions as F

from placeweave import fixed
from placeweave.operators.keys import drop_full_keys, nest_by_key, replace_keys, todo_keys
from placeweave.session import cut_lineage, spread
from placeweave.sources import schemas
from placeweave.sources.documents import (
    read_key_config, read_keyed_texts, read_posts, read_texts, shred_listing, write_documents, write_texts)
from placeweave.sources.regions import read_regions
from placeweave.sources.tables import (
    has_quoted_newlines, read_csv, read_optional, read_snapshots, table_exists, write_csv, write_table)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_csv_by_name_with_missing_values(spark, tmp_path):
    (tmp_path / "l.csv").write_text('slug,name,extra,community_area_number,subreddit\n'
                                    'a,"A, ""x""\nline",1, 07 ,NA\nb,,2,x,r/b\n')
    got = rows(read_csv(spark, str(tmp_path / "l.csv"), schemas.LOOKUP))
    assert got == [(7, 'A, "x"\nline', "a", None, None), (None, None, "b", None, "r/b")]


def test_gzip_snapshots(spark, tmp_path):
    for day, text in (("2025-06-17", "one"), ("2025-09-22", "two\nlines")):
        with gzip.open(tmp_path / f"{day}.csv.gz", "wt") as f:
            f.write(f'listing_id,id,date,reviewer_id,comments\n5,1,2025-01-02,9,"{text}"\n')
    paths = {d: str(tmp_path / f"{d}.csv.gz") for d in ("2025-06-17", "2025-09-22")}
    got = read_snapshots(spark, paths, schemas.REVIEWS, partitions=3)
    assert got.dtypes[1] == ("date", "date")
    assert [(r.listing_id, r.comments, r.snapshot_date) for r in got.orderBy("snapshot_date").collect()] == [
        (5, "one", "2025-06-17"), (5, "two\nlines", "2025-09-22")]


def test_posts_defaults_empty_and_broken(spark, tmp_path):
    post = {"id": "p1", "title": None, "selftext": "hi", "score": 3.0, "num_comments": "x", "subreddit": "s"}
    (tmp_path / "a.json").write_text(json.dumps({"slug": "a", "name": "A", "sources": [], "posts": [post, {}]}, indent=2))
    (tmp_path / "b.json").write_text('{"slug": "b", "posts": []}')
    (tmp_path / "c.json").write_text('{"slug": "c", "posts": [')
    (tmp_path / "d.txt").write_text("not read")
    posts, rejects = read_posts(spark, str(tmp_path))
    assert rows(posts) == [("a", "p1", "", "hi", 3, None, "s"), ("a", None, "", "", 0, 0, None)]
    assert [r.file.endswith("c.json") for r in rejects.collect()] == [True]


def test_large_keys_become_several_documents(spark, tmp_path):
    posts = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("slug"),
                                     F.col("id").cast("string").alias("id"), F.col("id").alias("at"))
    nested = nest_by_key(posts, ["slug"], "id", "at", ["id"], per_document=100)
    assert nested.filter("slug = 'cold'").count() == 1
    assert nested.filter("slug = 'hot'").count() == 9
    assert nested.agg(F.max(F.size("posts"))).first()[0] < 200
    write_documents(nested, str(tmp_path / "out"))
    back, rejects = read_posts(spark, str(tmp_path / "out"))
    assert rejects.count() == 0
    assert rows(back.select("slug", "post_id")) == rows(posts.select("slug", "id"))


def test_payloads(spark):
    good = json.dumps({"data": {"children": [{"data": {"id": "a", "score": None}}, {"data": {"title": "t", "score": 7}}]}})
    df = spark.createDataFrame([(1, good), (2, "{"), (3, '{"data": {}}'), (4, None)], "k int, payload string")
    got = [(r.k, r.position, r.id, r.title, r.score) for r in shred_listing(df, "payload", ["k"]).orderBy("position").collect()]
    assert got == [(1, 0, "a", "", 0), (1, 1, None, "t", 7)]


def test_key_config(spark, tmp_path):
    keys = [{"slug": "a", "name": "A", "search_term": "a city", "subreddits": ["A"]},
            {"slug": "b", "name": "B", "search_term": "b city", "search_terms": [], "subreddits": []},
            {"slug": "c", "name": "C", "search_terms": ["c1", "c2"]}]
    (tmp_path / "c.json").write_text(json.dumps({"min_posts_threshold": 15, "neighborhoods": keys}, indent=1))
    got = {r.slug: (r.search_terms, r.subreddits) for r in read_key_config(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"a": (["a city"], ["A"]), "b": (["b city"], []), "c": (["c1", "c2"], [])}


def test_texts(spark, tmp_path):
    (tmp_path / "loop.txt").write_text("# Loop\n\nA  place.\n")
    (tmp_path / "skip.md").write_text("no")
    assert rows(read_texts(spark, str(tmp_path))) == [("loop", "# Loop A place.")]
    df = spark.createDataFrame([("a", "x\n\ny"), ("b", "z")], "slug string, prompt string")
    write_texts(df, str(tmp_path / "out"))
    assert rows(read_keyed_texts(spark, str(tmp_path / "out"))) == [("a", "x y"), ("b", "z")]


@pytest.mark.parametrize("name", ["area_numbe", "community_area_number"])
def test_regions(spark, tmp_path, name):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [{"properties": {name: "7"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring, ring], [ring]]}},
                {"properties": {name: "8"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]
    (tmp_path / "r.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    edges = read_regions(spark, str(tmp_path / "r.geojson"))
    got = rows(edges.groupBy("community_area_number", "polygon", "ring").count())
    assert got == [(7, 0, 0, 3), (7, 0, 1, 3), (7, 1, 0, 3), (8, 0, 0, 3)]
    assert tuple(edges.filter("community_area_number = 8").orderBy("x1", "y1").first()[3:]) == (0, 0, 1, 0)


def test_optional_tables_and_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_optional(spark, path) is None
    assert read_optional(spark, path, "slug string, word string").columns == ["slug", "word"]
    write_table(spark.range(3), path)
    write_table(spark.range(9), path, mode="ignore")
    assert read_optional(spark, path).count() == 3


def test_keyed_work(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "slug string, n int")
    new = spark.createDataFrame([("a", 9), ("c", 4)], "slug string, n int")
    assert rows(replace_keys(old, new, "slug")) == [("a", 9), ("b", 3), ("c", 4)]
    assert rows(replace_keys(replace_keys(old, new, "slug"), new, "slug")) == [("a", 9), ("b", 3), ("c", 4)]
    assert rows(drop_full_keys(old, "slug", 2)) == [("b", 3)]
    assert rows(todo_keys(new, old, "slug")) == [("c",)]


def test_lineage_is_cut_and_scans_are_spread(spark):
    df = cut_lineage(spark.range(10).selectExpr("id", "id % 2 = 0 as even", "array(id) as ids"))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().analyzed().toString()
    assert spread(df.coalesce(1), "id").rdd.getNumPartitions() == 8
    asked = spark.conf.get("spark.placeweave.scan.partitions")
    spark.conf.unset("spark.placeweave.scan.partitions")
    assert spread(spark.range(0, 100, 1, 3), "id").rdd.getNumPartitions() == 3
    spark.conf.set("spark.placeweave.scan.partitions", asked)


def test_word_lists():
    assert len(fixed.DOMAIN_STOPWORDS) == 32 and len(fixed.HOSPITALITY_STOPWORDS) == 22
    assert len(fixed.CATEGORY_PATTERNS) == 9


def test_headers_count_by_path(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,x\n")
    (tmp_path / "two.csv").write_text("b,a\ny,2\n")
    got = read_csv(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")], "a int, b string")
    assert rows(got) == [(1, "x"), (2, "y")]
    for multi in (True, False):
        with pytest.raises(Exception, match="header|Header"):
            read_csv(spark, str(tmp_path), "a int, b string", quoted_newlines=multi).collect()


def test_written_spaces_stay(spark, tmp_path):
    write_csv(spark.createDataFrame([("  pad  ", "x")], "a string, b string").coalesce(1), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["a,b", "  pad  ,x"]


def test_half_written_stage_is_not_there(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    assert not table_exists(spark, path) and read_optional(spark, path) is None
    write_table(spark.range(3), path)
    assert table_exists(spark, path) and read_optional(spark, path).count() == 3


def test_no_snapshots_are_an_empty_table(spark):
    got = read_snapshots(spark, {}, schemas.REVIEWS)
    assert got.columns == ["listing_id", "date", "reviewer_id", "comments", "snapshot_date"] and got.count() == 0


def test_files_without_line_breaks_in_fields_are_split(spark, tmp_path):
    lines = ["a,b", *[f'{i},"say ""{i}"", then"' for i in range(2000)]]
    whole, broken = tmp_path / "whole.csv", tmp_path / "broken.csv"
    whole.write_text("\n".join(lines))
    broken.write_text("\n".join([*lines, '7,"two', 'lines"', '8,"and', '', '""more"""']))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert not has_quoted_newlines(spark, str(whole)) and has_quoted_newlines(spark, str(broken))
        split = read_csv(spark, str(whole), "a int, b string")
        assert split.rdd.getNumPartitions() > 5
        assert sorted(r.a for r in split.filter(F.col("b") == F.format_string('say "%d", then', "a")).collect()) == list(range(2000))
        rows = read_csv(spark, str(broken), "a int, b string")
        assert rows.count() == 2002 and {r.b for r in rows.collect()} >= {"two\nlines", 'and\n\n"more"'}
        both = read_csv(spark, [str(whole), str(broken)], "a int, b string")
        assert both.count() == 4002
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

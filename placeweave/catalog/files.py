"""Readers and writers: tables written to the shared folder in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from placeweave.catalog.base import query, table
from placeweave.operators.keys import nest_by_key
from placeweave.plans.feeds import one_place
from placeweave.session import scratch_path
from placeweave.sources import schemas
from placeweave.sources.documents import (
    read_key_config, read_keyed_texts, read_posts, read_texts, write_documents, write_texts)
from placeweave.sources.regions import read_regions
from placeweave.sources.store import KeyedStore
from placeweave.sources.tables import (
    read_csv, read_optional, read_snapshots, read_table, write_bundle, write_csv, write_table)


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment,
       c_acctbal, CASE WHEN c_nationkey < 3 THEN NULL ELSE c_nationkey END AS nation,
       'line one' || chr(10) || 'said "' || c_name || '", twice' AS note, CAST(NULL AS VARCHAR) AS absent
FROM customer
""")
def csv_round_trip(spark, sf):
    """Quotes, commas and line breaks in fields; NA and empty as missing; a number that is none; a lacking
    column; two folders whose headers have another order."""
    paths = [scratch_path(spark, "csv"), scratch_path(spark, "csv")]
    people = table(spark, sf, "customer")
    written = people.select(
        F.concat(F.lit('line one\nsaid "'), "c_name", F.lit('", twice')).alias("note"),
        F.when(col("c_mktsegment") == "BUILDING", "NA").otherwise(col("c_mktsegment")).alias("segment"),
        F.when(col("c_nationkey") < 3, "none").otherwise(col("c_nationkey").cast("string")).alias("nation"),
        "c_acctbal", "c_custkey")
    write_csv(written.filter(col("c_custkey") % 2 == 0), paths[0])
    write_csv(written.filter(col("c_custkey") % 2 == 1).select(*reversed(written.columns)), paths[1])
    return read_csv(spark, paths, "c_custkey bigint, segment string, c_acctbal double, nation int, note string, "
                                 "absent string")


@query("""
SELECT o_orderkey AS listing_id, CAST(o_orderdate AS DATE) AS date, o_custkey AS reviewer_id, o_orderpriority AS comments,
       '2025-06-17' AS snapshot_date FROM orders
UNION ALL
SELECT o_orderkey, CAST(o_orderdate AS DATE), o_custkey, o_orderstatus, '2025-09-22' FROM orders WHERE o_orderstatus <> 'P'
""")
def gzip_snapshots(spark, sf):
    """Two dated gzip CSV copies stacked with their dates."""
    orders = table(spark, sf, "orders").select(
        col("o_orderkey").alias("listing_id"), col("o_orderdate").cast("date").alias("date"),
        col("o_custkey").alias("reviewer_id"), "o_orderpriority", "o_orderstatus")
    paths = {"2025-06-17": scratch_path(spark, "early"), "2025-09-22": scratch_path(spark, "late")}
    early = orders.withColumnRenamed("o_orderpriority", "comments").drop("o_orderstatus")
    late = orders.filter(col("o_orderstatus") != "P").withColumnRenamed("o_orderstatus", "comments").drop("o_orderpriority")
    for df, path in zip((early, late), paths.values()):
        df.write.option("header", True).option("compression", "gzip").csv(path)
    return read_snapshots(spark, paths, schemas.REVIEWS, partitions=8)


@query("""
SELECT event_type AS slug, CAST(event_id AS VARCHAR) AS post_id, 'user ' || user_id AS title, '' AS selftext,
       CAST(floor(value) AS INTEGER) AS score, 0 AS num_comments, CAST(NULL AS VARCHAR) AS subreddit FROM events
""")
def posts_round_trip(spark, sf):
    """Nested JSON documents per event type, about five hundred posts each, read back as post rows."""
    path = scratch_path(spark, "posts")
    posts = table(spark, sf, "events").select(
        col("event_type").alias("slug"), col("event_id").cast("string").alias("id"),
        F.concat(F.lit("user "), col("user_id").cast("string")).alias("title"), F.floor("value").alias("score"), "event_id")
    write_documents(nest_by_key(posts, ["slug"], "id", "event_id", ["id", "title", "score"],
                                per_document=500), path)
    return read_posts(spark, path)[0]


@query("""
SELECT 'post' AS kind, n_name AS id, count(*) AS n FROM nation GROUP BY 2
UNION ALL SELECT 'reject', '{"slug": "x", "posts": [{' || r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 2
""")
def rejected_posts(spark, sf):
    """A broken document beside each good one: the good are read, the broken set aside whole."""
    path = scratch_path(spark, "rejects")
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), col("n_regionkey") == col("r_regionkey"))
    good = nations.select(F.to_json(F.struct(F.array(F.struct(col("n_name").alias("id"))).alias("posts"))).alias("value"),
                          "n_nationkey", F.lit("good").alias("kind"))
    bad = nations.select(F.concat(F.lit('{"slug": "x", "posts": [{'), "r_name").alias("value"), "n_nationkey",
                         F.lit("bad").alias("kind"))
    good.unionByName(bad).repartition("kind", "n_nationkey").write.partitionBy("kind", "n_nationkey").text(path)
    posts, rejects = read_posts(spark, path, glob="*.txt")
    ids = posts.select(F.lit("post").alias("kind"), col("post_id").alias("id"))
    records = rejects.select(F.lit("reject").alias("kind"), F.rtrim(F.regexp_replace("record", "\\s+$", "")).alias("id"))
    return ids.unionByName(records).groupBy("kind", "id").agg(F.count("*").alias("n"))


@query("""
SELECT 'src' || c_nationkey AS slug, 'Notes of ' || c_nationkey || ': ' || n || ' customers' AS ai_summary
FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
""")
def keyed_texts(spark, sf):
    """One text per nation, with blank lines that reading squishes."""
    path = scratch_path(spark, "texts")
    counts = table(spark, sf, "customer").groupBy(col("c_nationkey").cast("string").alias("k")).agg(F.count("*").alias("n"))
    write_texts(counts.select(F.concat(F.lit("src"), "k").alias("slug"), F.concat(
        F.lit("Notes of "), "k", F.lit(":\n\n  "), col("n").cast("string"), F.lit(" customers")).alias("prompt")), path)
    return read_keyed_texts(spark, path)


@query("""
WITH b AS (SELECT label, min(embedding[1]) AS x0, max(embedding[1]) AS x1, min(embedding[2]) AS y0, max(embedding[2]) AS y1
           FROM embeddings GROUP BY 1),
c AS (SELECT label, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1 FROM b)
SELECT label + 1 AS community_area_number, polygon, CAST(4 AS BIGINT) AS edges,
       round(x0 + polygon * 2, 8) AS left_edge, round(y1, 8) AS top_edge
FROM c CROSS JOIN (VALUES (0), (1)) p(polygon) WHERE polygon = 0 OR label >= 5
""")
def geojson_round_trip(spark, sf):
    """Bounding boxes as GeoJSON features, half of them of two polygons, under either property name."""
    path = scratch_path(spark, "regions")
    box = table(spark, sf, "embeddings").groupBy("label").agg(*[
        f(col("embedding")[i].cast("double")).alias(n)
        for f, i, n in [(F.min, 0, "x0"), (F.max, 0, "x1"), (F.min, 1, "y0"), (F.max, 1, "y1")]])

    def ring(shift):
        x0, x1, y0, y1 = col("x0") + shift, col("x1") + shift, col("y0"), col("y1")
        return F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])

    number = (col("label") + 1).cast("string")
    one, two = F.to_json(F.array(ring(0))), F.to_json(F.array(F.array(ring(0)), F.array(ring(2))))
    several = col("label") >= 5
    shape = F.concat(F.lit('{"type": "'), F.when(several, "MultiPolygon").otherwise("Polygon"),
                     F.lit('", "coordinates": '), F.when(several, two).otherwise(one), F.lit("}"))
    name = F.when(several, "area_numbe").otherwise("community_area_number")
    feature = F.concat(F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"'), name,
                       F.lit('": "'), number, F.lit('"}, "geometry": '), shape, F.lit("}]}"))
    box.select(feature.alias("value"), "label").repartition("label").write.partitionBy("label").text(path)
    edges = read_regions(spark, f"{path}/*")
    return edges.groupBy("community_area_number", "polygon").agg(
        F.count("*").alias("edges"), F.round(F.min("x1"), 8).alias("left_edge"), F.round(F.max("y2"), 8).alias("top_edge"))


@query("""
WITH t AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'src' || n_nationkey AS slug, n_name AS name,
       CASE WHEN n_nationkey < 10 THEN lower(n_name) || ' city' ELSE lower(n_name) || ',' || lower(r_name) END AS terms,
       CASE WHEN n_nationkey < 20 THEN r_name ELSE '' END AS sources, 15 AS min_posts_threshold
FROM t
""")
def key_config(spark, sf):
    """A key configuration with single terms, term lists and lacking source lists."""
    path = scratch_path(spark, "config")
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), col("n_regionkey") == col("r_regionkey"))
    n = col("n_nationkey")
    key = F.struct(
        F.concat(F.lit("src"), n.cast("string")).alias("slug"), col("n_name").alias("name"),
        F.concat(F.lower("n_name"), F.lit(" city")).alias("search_term"),
        F.when(n >= 10, F.array(F.lower("n_name"), F.lower("r_name"))).when(n >= 5, F.array().cast("array<string>"))
        .alias("search_terms"), F.when(n < 20, F.array("r_name")).alias("subreddits"))
    document = F.struct(F.lit(15).alias("min_posts_threshold"), F.lit("city").alias("primary_subreddit"),
                        F.array(key).alias("neighborhoods"))
    nations.select(F.to_json(document).alias("value"), "n_nationkey").repartition("n_nationkey").write.partitionBy(
        "n_nationkey").text(path)
    return read_key_config(spark, f"{path}/*").select(
        "slug", "name", F.array_join("search_terms", ",").alias("terms"), F.array_join("subreddits", ",").alias("sources"),
        "min_posts_threshold")


@query("""
SELECT 'orders' AS part, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'priorities', o_orderpriority, count(*) FROM orders GROUP BY 2
""")
def stage_tables(spark, sf):
    """A bundle of two datasets, one of them rebuilt by force and then left alone by a write
    that skips what exists, one absent and one that was not written to its end; all read back."""
    root = scratch_path(spark, "stages")
    orders = table(spark, sf, "orders")
    by_status = orders.groupBy(col("o_orderstatus").alias("key")).agg(F.count("*").alias("n"))
    by_priority = orders.groupBy(col("o_orderpriority").alias("key")).agg(F.count("*").alias("n"))
    write_bundle({"orders": by_priority, "priorities": by_priority}, root)
    write_table(by_status, f"{root}/orders", mode="overwrite")
    write_table(by_status.filter(F.lit(False)), f"{root}/orders", mode="ignore")
    absent = read_optional(spark, f"{root}/nothing", "part string, key string, n bigint")
    by_status.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/half")
    half = read_optional(spark, f"{root}/half", "part string, key string, n bigint")
    parts = [read_table(spark, f"{root}/{name}").select(F.lit(name).alias("part"), "key", "n")
             for name in ("orders", "priorities")]
    return parts[0].unionByName(parts[1]).unionByName(absent).unionByName(half)


@query("""
SELECT doc_id, source, CAST(length(text) AS INTEGER) AS chars FROM documents
""")
def partitioned_table(spark, sf):
    """A table partitioned by its key, so that reading one key lists one folder."""
    path = scratch_path(spark, "partitioned")
    write_table(table(spark, sf, "documents").select("doc_id", "source", "text").repartition("source", F.pmod("doc_id", F.lit(4))),
                path, partition_by=["source"])
    return read_table(spark, path).select("doc_id", "source", F.length("text").alias("chars"))


@query("""
SELECT o_orderpriority || ' ' || o_orderstatus || ': ' || count(*) || ' orders' AS ai_summary, CAST(1 AS BIGINT) AS files
FROM orders GROUP BY o_orderpriority, o_orderstatus
""")
def text_files(spark, sf):
    """One text file per priority and status, keyed by file name; the keys are held against the paths."""
    path = scratch_path(spark, "files")
    groups = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    text = F.concat("o_orderpriority", F.lit("\n\n "), "o_orderstatus", F.lit(":  "), col("n").cast("string"),
                    F.lit(" orders\n"))
    groups.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    files = read_texts(spark, path)
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
              .select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("slug")))
    names = listed.groupBy("slug").agg(F.count("*").alias("files"))
    return files.join(names, "slug").select("ai_summary", "files")


@query("""
SELECT doc_id, source, md5(text) AS digest FROM documents WHERE source = 'src3'
""")
def single_key(spark, sf):
    """All rows of one key out of a store: one bucket is opened, however many keys there are."""
    store = KeyedStore(spark, scratch_path(spark, "keyed"), "doc_id bigint, source string, digest string", "source", buckets=16, order=["doc_id"])
    store.replace(table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("digest")))
    return store.read(["src3"])


@query("""
SELECT doc_id, source, md5(text) AS digest FROM documents WHERE source = 'src3'
""")
def single_folder(spark, sf):
    """The same from a table partitioned by key, for few keys: one folder is read."""
    path = scratch_path(spark, "keyed")
    write_table(table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
                .repartition("source", F.pmod("doc_id", F.lit(4))), path, partition_by=["source"])
    return one_place(read_table(spark, path).withColumnRenamed("source", "slug"), "src3").withColumnRenamed("slug", "source")

"""Key sets, logs, nested documents and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from placeweave.catalog.base import query, table
from placeweave.operators.checks import Accounting
from placeweave.operators.keys import drop_full_keys, full_keys, nest_by_key, replace_keys, todo_keys
from placeweave.operators.ranking import latest_per_key
from placeweave.plans.collection import Collection, collect_posts, collected, collection_documents, keys_in
from placeweave.session import scratch_path
from placeweave.sources import schemas
from placeweave.sources.documents import shred_listing
from placeweave.sources.store import KeyedStore
from placeweave.sources.tables import read_table, write_table


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
""", name="todo_keys")
def keys_to_do(spark, sf):
    done = table(spark, sf, "orders").filter(col("o_orderstatus") == "F").select(col("o_custkey").alias("c_custkey"))
    return todo_keys(table(spark, sf, "customer"), done, "c_custkey")


@query("""
WITH new AS (SELECT o_custkey, count(*) AS post_count, 'new' AS status FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
     old AS (SELECT o_custkey, count(*) AS post_count, 'old' AS status FROM orders GROUP BY 1)
SELECT * FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new) UNION ALL SELECT * FROM new
""")
def log_upsert(spark, sf):
    """A log kept in a store: the second batch replaces its own keys there, and readers get the whole."""
    orders = table(spark, sf, "orders")
    store = KeyedStore(spark, scratch_path(spark, "log"), "o_custkey bigint, post_count bigint, status string", "o_custkey", buckets=8)

    def log(df, status):
        return df.groupBy("o_custkey").agg(F.count("*").alias("post_count")).withColumn("status", F.lit(status))

    store.replace(log(orders, "old"))
    store.replace(log(orders.filter(col("o_orderpriority") == "1-URGENT"), "new"))
    return store.read()


@query("""
WITH new AS (SELECT o_custkey, count(*) AS post_count, 'new' AS status FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
     old AS (SELECT o_custkey, count(*) AS post_count, 'old' AS status FROM orders GROUP BY 1)
SELECT * FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new) UNION ALL SELECT * FROM new
""")
def log_merge(spark, sf):
    """The same on frames, nothing stored."""
    orders = table(spark, sf, "orders")

    def log(df, status):
        return df.groupBy("o_custkey").agg(F.count("*").alias("post_count")).withColumn("status", F.lit(status))

    return replace_keys(log(orders, "old"), log(orders.filter(col("o_orderpriority") == "1-URGENT"), "new"), "o_custkey")


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) < 12)
""")
def recollect(spark, sf):
    """Full keys removed from a store, so that they are collected anew; what is left is also what a frame without them holds."""
    store = KeyedStore(spark, scratch_path(spark, "full"), "o_orderkey bigint, o_custkey bigint", "o_custkey", buckets=8)
    store.replace(table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
    store.remove(full_keys(store.read(), "o_custkey", 12))
    return store.read()


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) < 12)
""")
def recollect_rows(spark, sf):
    """The same on a frame."""
    return drop_full_keys(table(spark, sf, "orders"), "o_custkey", 12).select("o_orderkey", "o_custkey")


def _landed(spark, sf):
    """Events as collected posts: purchases are the primary source, views the fallback, the
    other types dedicated sources, in an order of their own; a day is a post, so sources overlap."""
    kind = F.when(col("event_type") == "purchase", "primary").when(
        col("event_type") == "view", "fallback").otherwise("dedicated")
    return table(spark, sf, "events").select(
        col("user_id").cast("string").alias("slug"), kind.alias("source_kind"), col("event_type").alias("source_name"),
        F.when(col("event_type") == "signup", 0).when(col("event_type") == "error", 1).otherwise(2).alias("source_no"),
        F.lit("new").alias("feed"), F.lit(1).alias("feed_no"), col("event_id").alias("position"),
        F.date_format("ts", "yyyy-MM-dd").alias("id"))


def _pages(spark, sf):
    """The same as landed pages of listings, a block of events each."""
    landed = _landed(spark, sf).withColumn("page", F.floor(col("position") / 500).cast("int"))
    post = F.struct("id", col("source_name").alias("title"), col("position").alias("score"))
    child = F.struct("position", F.struct(post.alias("data")).alias("child"))
    pages = landed.groupBy(*schemas.PAGE_KEYS).agg(F.sort_array(F.collect_list(child)).alias("c"))
    payload = F.to_json(F.struct(F.struct(F.transform("c", lambda x: x["child"]).alias("children")).alias("data")))
    return pages.select(*schemas.PAGE_KEYS, payload.alias("payload"))


# a cap that most users reach, a threshold below it, and the posts that make a key large
CAP, AT_LEAST, RECOLLECT = 13, 12, 25

_SQL_USED = f"""
capped AS (SELECT * FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= {CAP}),
served AS (SELECT user_id FROM capped WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= {AT_LEAST}),
used AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS id,
           CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 4 WHEN 'signup' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS r
         FROM capped WHERE event_type <> 'view' OR user_id NOT IN (SELECT user_id FROM served)),
kept AS (SELECT * FROM used QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY r, event_id) = 1)"""


@query(f"""
WITH {_SQL_USED}
SELECT CAST(user_id AS VARCHAR) AS slug, id, event_type AS source_name, event_id AS position FROM kept
""")
def collected_posts(spark, sf):
    return collect_posts(_landed(spark, sf), AT_LEAST, CAP).select("slug", "id", "source_name", "position")


@query(f"""
WITH {_SQL_USED},
stored AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 15),
c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1),
k AS (SELECT user_id, count(*) AS n FROM kept GROUP BY 1),
heads AS (SELECT user_id, string_agg(DISTINCT 'r/' || event_type, ',' ORDER BY 'r/' || event_type DESC) AS s
          FROM events WHERE event_type IN ('click', 'signup') GROUP BY 1)
SELECT CAST(c.user_id AS VARCHAR) AS slug, 'user ' || c.user_id AS name,
       coalesce(stored.n, k.n) AS post_count,
       CASE WHEN stored.n IS NOT NULL THEN 'r/stored' ELSE
         heads.s || CASE WHEN p > 0 THEN ',r/purchase' ELSE '' END || CASE WHEN p < {AT_LEAST} THEN ',r/view' ELSE '' END END AS sources,
       CASE WHEN stored.n IS NOT NULL THEN 'skipped' ELSE 'collected' END AS status
FROM c LEFT JOIN k USING (user_id) LEFT JOIN heads USING (user_id) LEFT JOIN stored USING (user_id)
""")
def key_sources(spark, sf):
    events = table(spark, sf, "events")
    named = col("user_id").cast("string").alias("slug")
    already = (events.filter(col("event_type") == "error").groupBy("user_id").agg(F.count("*").alias("post_count"))
               .filter(col("post_count") >= 15).select(
                   named, F.concat(F.lit("user "), col("user_id").cast("string")).alias("name"), "post_count",
                   F.lit("r/stored").alias("sources")))
    return collected(_landed(spark, sf), _key_config(spark, sf), already)["log"]


def _key_config(spark, sf):
    """One row per user with its dedicated sources and the rules of collection."""
    events = table(spark, sf, "events")
    order = F.when(col("event_type") == "signup", 0).otherwise(1)
    named = F.sort_array(F.collect_set(F.when(col("event_type").isin("click", "signup"), F.struct(order.alias("n"), "event_type"))))
    return events.groupBy("user_id").agg(F.transform(named, lambda s: s["event_type"]).alias("subreddits")).select(
        col("user_id").cast("string").alias("slug"), F.concat(F.lit("user "), col("user_id").cast("string")).alias("name"),
        "subreddits", F.lit("purchase").alias("primary_subreddit"), F.lit("view").alias("fallback_subreddit"),
        F.lit(AT_LEAST).alias("min_posts_threshold"), F.lit(CAP).alias("max_posts"))


@query(f"""
WITH {_SQL_USED},
k AS (SELECT user_id, count(*) AS n FROM kept GROUP BY 1),
p AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, bool_or(event_type = 'signup') AS s,
             bool_or(event_type = 'click') AS c FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS slug, 'user ' || user_id AS name, n AS post_count,
       concat_ws(',', CASE WHEN s THEN 'r/signup' END, CASE WHEN c THEN 'r/click' END, CASE WHEN p > 0 THEN 'r/purchase' END,
                 CASE WHEN p < {AT_LEAST} THEN 'r/view' END) AS sources,
       CASE WHEN user_id % 2 = 0 THEN 'skipped' ELSE 'collected' END AS status
FROM p JOIN k USING (user_id)
""")
def collection_store(spark, sf):
    """Collected in two runs over one store of documents: the second finds what the first has written."""
    landed, config = _landed(spark, sf), _key_config(spark, sf)
    kept = KeyedStore(spark, scratch_path(spark, "store"), "slug string, name string, sources array<string>, part int, "
                      "posts array<struct<id: string, title: string>>", "slug", buckets=8, order=["part"])

    def store(done):
        kept.replace(collection_documents(done["posts"].withColumn("title", col("source_name")), done["sources"], ["id", "title"], per_document=7))

    store(collected(landed, config.filter(col("slug").cast("long") % 2 == 0)))
    second = collected(landed, config, keys_in(kept.read()))
    store(second)
    found = keys_in(kept.read())
    return found.join(second["log"].select("slug", "status"), "slug").select("slug", "name", "post_count", "sources", "status")


@query(f"""
WITH {_SQL_USED},
k AS (SELECT user_id, count(*) AS n FROM kept GROUP BY 1),
p AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, bool_or(event_type = 'signup') AS s,
             bool_or(event_type = 'click') AS c FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS slug, 'user ' || user_id AS name, n AS post_count,
       concat_ws(',', CASE WHEN s THEN 'r/signup' END, CASE WHEN c THEN 'r/click' END, CASE WHEN p > 0 THEN 'r/purchase' END,
                 CASE WHEN p < {AT_LEAST} THEN 'r/view' END) AS sources,
       CASE WHEN user_id % 2 = 0 AND n < {RECOLLECT} THEN 'skipped' ELSE 'collected' END AS status
FROM p JOIN k USING (user_id)
""")
def collection_stage(spark, sf):
    """From landed pages to documents and log: half the keys first, then all, the large ones anew."""
    pages, config = _pages(spark, sf), _key_config(spark, sf)
    stage = Collection(spark, scratch_path(spark, "collection"), buckets=8, per_document=7)
    stage.collect(pages, config.filter(col("slug").cast("long") % 2 == 0))
    return stage.collect(pages, config, RECOLLECT)


@query(f"""
WITH {_SQL_USED}
SELECT CAST(user_id AS VARCHAR) AS slug, id AS post_id, event_type AS title, CAST(event_id AS INTEGER) AS score FROM kept
""")
def stored_posts(spark, sf):
    """The posts that the collection stores, read back from its documents."""
    stage = Collection(spark, scratch_path(spark, "collection"), buckets=8, per_document=7)
    stage.collect(_pages(spark, sf), _key_config(spark, sf))
    return stage.posts().select("slug", "post_id", "title", "score")


@query("""
WITH valid AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')
SELECT 'raw' AS stage, count(*) AS n FROM orders UNION ALL SELECT 'valid', count(*) FROM valid
UNION ALL SELECT 'unique', count(DISTINCT o_custkey) FROM valid
UNION ALL SELECT 'placed', count(DISTINCT o_custkey) FROM valid JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20
""")
def stage_accounting(spark, sf):
    """Rows in and out of the steps of one stage, counted while the stage is written, not apart, and kept as a table."""
    steps = Accounting("orders")
    counted = steps.count
    raw = counted(table(spark, sf, "orders"), "raw")
    valid = counted(raw.filter(col("o_orderstatus") != "P"), "valid")
    unique = counted(latest_per_key(valid, ["o_custkey"], "o_orderdate", ["o_orderkey"]), "unique")
    homes = table(spark, sf, "customer").filter(col("c_nationkey") < 20).select(col("c_custkey").alias("o_custkey"))
    write_table(counted(unique.join(homes, "o_custkey"), "placed"), scratch_path(spark, "counted"))
    path = scratch_path(spark, "accounting")
    write_table(steps.table(spark), path)
    return read_table(spark, path).select(col("step").alias("stage"), col("rows").alias("n"))


@query("""
SELECT conv_id, turn, role, text, strlen(text) AS bytes FROM conversations
""")
def nested_posts(spark, sf):
    """Turns nested per conversation, at most a few per document, and exploded back."""
    turns = table(spark, sf, "conversations")
    nested = nest_by_key(turns, ["conv_id"], "turn", "turn", ["turn", "role", "text"], per_document=3)
    return nested.select("conv_id", F.inline("posts")).select(
        "conv_id", "turn", "role", "text", F.octet_length("text").cast("long").alias("bytes"))


@query("""
SELECT event_id // 100 AS page, CAST(event_id % 100 AS INTEGER) AS position, CAST(event_id AS VARCHAR) AS id,
       CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS title, '' AS selftext,
       CAST(CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS INTEGER) AS score, 0 AS num_comments,
       CAST(NULL AS DOUBLE) AS created_utc, event_type AS subreddit
FROM events
""")
def listing_shred(spark, sf):
    """Events packed into listing payloads of a hundred, with absent fields and broken pages, and shredded."""
    post = F.struct(
        col("event_id").alias("id"), F.when(col("event_type") != "error", col("event_type")).alias("title"),
        F.when(col("event_type") != "view", col("user_id")).alias("score"), col("event_type").alias("subreddit"))
    child = F.struct((col("event_id") % 100).alias("at"), F.struct(post.alias("data")).alias("child"))
    pages = table(spark, sf, "events").groupBy(F.floor(col("event_id") / 100).alias("page")).agg(
        F.sort_array(F.collect_list(child)).alias("c"))
    payload = F.to_json(F.struct(F.struct(F.transform("c", lambda x: x["child"]).alias("children")).alias("data")))
    whole = pages.select("page", payload.alias("payload"))
    broken = pages.select("page", F.lit('{"data": {"kids').alias("payload"))
    return shred_listing(whole.unionByName(broken), "payload", ["page"]).select(
        "page", "position", "id", "title", "selftext", "score", "num_comments", "created_utc", "subreddit")


@query("""
SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2
""")
def event_props(spark, sf):
    k = F.from_json("props", "k int")["k"].alias("k")
    return table(spark, sf, "events").select("event_type", k).groupBy("event_type", "k").agg(F.count("*").alias("n"))

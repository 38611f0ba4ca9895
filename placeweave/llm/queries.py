"""The corpus queries over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm import (
    bpe, exact_dedup, line_dedup, mixing, packing, pivots, pseudonyms, quality, simhash, spelling, substring_dedup, topk, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeated_spans(table(spark, sf_dir, "documents"))


@query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op2_exact_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.i <> c.i),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex16(F.col("code")).alias("fingerprint"), "component_id")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


# the splitting tree over two levels of eight, as ranks by the same random bits
ORACLES["op5_mix_sources"] = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
numbers AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM totals),
weights AS (SELECT *, number % 3 + 1 AS weight FROM numbers),
-- the sources that stay full are those with the least size per weight
levels AS (
  SELECT *, sum(source_size) OVER ()
           - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, number
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY source_size / weight, number
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weights),
level AS (
  SELECT rest, weights FROM levels WHERE 3 * source_size >= rest::DOUBLE * weight / weights
  ORDER BY source_size / weight, number LIMIT 1),
targets AS (
  SELECT w.*, least((3 * source_size)::DOUBLE, l.rest::DOUBLE * weight / l.weights::DOUBLE) AS target FROM weights w, level l),
sources AS (
  SELECT *, target - passes * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INT AS passes,
               greatest(1, ceil(source_size / 100000)::BIGINT) AS n_blocks FROM targets)),
placed AS (
  SELECT d.*, s.number, s.source_size, s.target, s.passes, s.rest, ((d.key >> 30) * s.n_blocks) >> 30 AS block
  FROM sizes d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
alike AS (SELECT number, block, key, rest, sum(size) AS words FROM placed WHERE size > 0 GROUP BY ALL),
running AS (SELECT *, sum(words) OVER (PARTITION BY number ORDER BY key) AS upto FROM alike),
edges AS (
  SELECT number, max(block) FILTER (WHERE start < rest) AS last_block
  FROM (SELECT *, sum(words) OVER (PARTITION BY number ORDER BY block) - words AS start
        FROM (SELECT number, block, rest, sum(size) AS words FROM placed GROUP BY ALL)) WHERE words > 0 GROUP BY number),
gaps AS (
  SELECT r.*, e.last_block,
         rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY number), 0) AS gap
  FROM running r JOIN edges e USING (number) WHERE rest > 0),
lasts AS (
  SELECT number, any_value(last_block) AS last_block, any_value(gap) AS gap,
         max(key) FILTER (WHERE block = last_block AND upto <= rest) AS last_key
  FROM gaps GROUP BY number),
behind AS (
  SELECT a.*, gap, sum(words) OVER (PARTITION BY number ORDER BY words, key) AS filled
  FROM alike a JOIN lasts l USING (number) WHERE block > last_block OR (block = last_block AND key > coalesce(last_key, -1))),
fills AS (
  SELECT number, block, key FROM behind WHERE filled <= gap OR (filled - words <= gap AND words < 2 * (gap - (filled - words)))),
counted AS (
  SELECT p.*, p.passes + CASE WHEN p.block < last_block OR (p.block = last_block AND p.key <= last_key) OR f.key IS NOT NULL
                              THEN 1 ELSE 0 END AS times
  FROM placed p LEFT JOIN lasts l USING (number) LEFT JOIN fills f ON f.number = p.number AND f.key = p.key),
owned AS (SELECT number, block, max(times) AS draws FROM counted GROUP BY ALL),
draws AS (SELECT number, block, unnest(range(0, draws)) AS pass FROM owned),
bits AS (
  SELECT *, ('0x' || substr(md5(concat_ws(':', 'mix', 0, number, block, pass)), 1, 15))::BIGINT AS r0,
         ('0x' || substr(md5(concat_ws(':', 'mix', 1, number, block, pass)), 1, 15))::BIGINT AS r1 FROM draws),
first AS (
  SELECT *, floor((row_number() OVER (ORDER BY r0, number, block, pass) - 1) * 8 / count(*) OVER ())::BIGINT AS node FROM bits),
second AS (
  SELECT *, node * 8 + floor((row_number() OVER (PARTITION BY node ORDER BY r1, number, block, pass) - 1) * 8
                             / count(*) OVER (PARTITION BY node))::BIGINT AS shard FROM first),
shards AS (SELECT number, block, list(shard ORDER BY pass) AS shards FROM second GROUP BY ALL)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * times)::BIGINT AS taken,
       CASE WHEN times > 0 THEN coalesce(s.shards, [])[1:times] ELSE [] END AS shards
FROM counted LEFT JOIN shards s USING (number, block)
"""


#: The key of the registered query; a user of the operator brings a secret one.
PSEUDONYM_KEY = "public example key"


@query
def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op7_exact_dedup"] = r"""
WITH rows AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM rows WINDOW g AS (PARTITION BY norm)
"""


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).drop("spans")


ORACLES["op8_line_dedup"] = r"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
spots AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM rows WHERE len(lines) >= 3),
windows AS (
  SELECT doc_id, i, lines[i] AS a, lines[i + 1] AS b, lines[i + 2] AS c FROM spots
  WHERE regexp_matches(lines[i], '[^\x20\x09-\x0D]') OR regexp_matches(lines[i + 1], '[^\x20\x09-\x0D]')
     OR regexp_matches(lines[i + 2], '[^\x20\x09-\x0D]')),
later AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later),
left_over AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM rows) r
  LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.i = g.i WHERE g.i IS NULL GROUP BY r.doc_id)
SELECT r.doc_id, coalesce(l.text, '') AS text, len(r.lines)::BIGINT AS n_lines,
       len(r.lines)::BIGINT - coalesce(l.n, 0) AS n_removed
FROM rows r LEFT JOIN left_over l USING (doc_id)
"""


@query
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.tokenizer_spec(spark, tokenizer_path())
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), spec).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.joined_ids("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_tokens(table(spark, sf_dir, "documents"), bpe.tokenizer_spec(spark, tokenizer_path()))
    return packed.select("shard", "row", "n_ids", "doc_ids", "pieces", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2("position_ids", 256).alias("position_ids_sha256"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


# near words by equal words with one place masked, and by words that equal another with one letter left out
ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM range(0, 256) r(i))),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each_run AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes
  FROM runs WHERE len(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_transform(range(1, len(bytes), 2), lambda i: ('0x' || substr(bytes, i, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM each_run, crc_table),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len(run))::BIGINT) || substr(run, (h % len(run))::BIGINT + 2) ELSE run END AS word
    FROM hashed) WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
masks AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS mask FROM words, range(1, len(word) + 1) r(i)),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS other FROM masks),
cut AS (SELECT s.word, s.n, w.word AS other, w.n AS m FROM shorter s JOIN words w ON s.other = w.word),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
  UNION ALL SELECT word, other, m FROM cut UNION ALL SELECT other, word, n FROM cut),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (WHERE m = top) AS other
  FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
steps AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT s.word, f.form, step + 1 FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word) r USING (word)
"""


@query
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


# all pairs, and what links reach; for tables as small as those it is run on
ORACLES["op12_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         THEN list_transform(embedding, lambda x: x::DOUBLE) END AS v FROM embeddings),
sized AS (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM v WHERE len(v) > 0),
links AS (
  SELECT a.i AS a, b.i AS b FROM sized a JOIN sized b
  ON a.i <> b.i AND a.size > 0 AND b.size > 0 AND list_dot_product(a.v, b.v) >= 0.9 * a.size * b.size),
reach AS (SELECT i AS a, i AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT r.a, min(v.vec_id) AS component_id FROM reach r JOIN v ON r.b = v.i GROUP BY r.a)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = v.i)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN lowest o ON o.a = v.i
"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))

"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import balancing, filteraudit, fmindex, grammarruns, htmlblocks, hyperminhash, linejoin, maxproduct, packing, ppm, pulearning, warc, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_TWINS: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: a fifth, by the checksum of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    manifest = wavelet.write_shards(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read_shards(spark, manifest).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op5_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op6_fm_index_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = fmindex.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, span: n + (span["end"] - span["start"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query
def op4_ppm_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = ppm.fit(docs.where(~held_out(F.col("doc_id"))))
    return ppm.identify(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL_TWINS["op6_fm_index_decontamination"] = f"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
phrase AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, w[i:i + 9] AS p FROM n),
size AS (SELECT DISTINCT len(p) AS k FROM phrase),
place AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, size WHERE len(w) >= k),
hit AS (SELECT doc_id, i, k, item FROM (SELECT doc_id, i, k, w[i:i + k - 1] AS p FROM place) JOIN phrase USING (p)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op9_hyperminhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, folder, "documents"))


@query
def op7_norm_buckets_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return maxproduct.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


SQL_TWINS["op7_norm_buckets_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op8_warc_index_merge(spark: SparkSession, folder: str) -> DataFrame:
    # the table has no time of capture: a second per page from the start of 2024
    captured = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))
    histories = warc.merge_runs(warc.write_archives(table(spark, folder, "pages"), captured))
    return warc.read_archives(histories, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_TWINS["op8_warc_index_merge"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex),
-- five hexadecimal digits are four of base 32
g AS (SELECT hex, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM f),
b AS (SELECT hex, array_to_string(list_transform(v, lambda x:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x // 32768), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x // 1024) % 32, 1)
  || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x // 32) % 32, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + x % 32, 1)), '') AS payload_digest FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (hex) JOIN b USING (hex)
"""


@query
def op1_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmlblocks.extract(table(spark, folder, "pages"))


@query
def op10_segment_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linejoin.repeated_lines(table(spark, folder, "documents")).drop("digest", "n_chars", "blank")


# DuckDB's levenshtein counts bytes: a pair with other characters is written anew with one byte per
# character of the two lines (127 at most), and is a candidate if its bytes are within four times the threshold
_BYTE_PER_SIGN = "array_to_string(list_transform(string_split({line}, ''), lambda c: chr(list_position(signs, c)::INTEGER)), '')"

SQL_TWINS["op10_segment_line_dedup"] = f"""
WITH l AS (
  SELECT doc_id, CAST(unnest(range(len(s))) AS BIGINT) AS line_no, unnest(s) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), k AS (
  SELECT line, arg_min(doc_id, (doc_id, line_no)) AS class_doc_id, arg_min(line_no, (doc_id, line_no)) AS class_line_no,
         length(line) AS size, strlen(line) = length(line) AS plain
  FROM l GROUP BY line
), c AS (
  SELECT a.line AS x, b.line AS y, a.plain AND b.plain AS plain, (b.class_doc_id, b.class_line_no) < (a.class_doc_id, a.class_line_no) AS y_first
  FROM k a JOIN k b ON b.size BETWEEN a.size - 2 AND a.size + 2 AND a.line < b.line
  WHERE a.size > 2 AND b.size > 2 AND abs(strlen(a.line) - strlen(b.line)) <= 8
    AND levenshtein(a.line, b.line) <= CASE WHEN a.plain AND b.plain THEN 2 ELSE 8 END
), w AS (
  SELECT *, list_distinct(list_concat(string_split(x, ''), string_split(y, ''))) AS signs FROM c
), p AS (
  SELECT x, y, y_first FROM w
  WHERE plain OR levenshtein({_BYTE_PER_SIGN.format(line='x')}, {_BYTE_PER_SIGN.format(line='y')}) <= 2
), n AS (
  SELECT line, count(*) AS links, bool_or(later) AS earlier FROM (SELECT x AS line, y_first AS later FROM p UNION ALL SELECT y, NOT y_first FROM p) GROUP BY line
)
SELECT l.doc_id, l.line_no, class_doc_id, class_line_no, coalesce(n.links, 0) AS links,
       class_doc_id = l.doc_id AND class_line_no = l.line_no AND NOT coalesce(n.earlier, false) AS kept
FROM l JOIN k USING (line) LEFT JOIN n USING (line)
"""


@query
def op3_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learned = ~held_out(F.col("doc_id"))
    model = pulearning.fit(docs.where(learned), labels.where(learned))
    scored = pulearning.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op11_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filteraudit.filter_interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL_TWINS["op11_filter_interactions"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d
), m AS (
  SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         MAP {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
              'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(first < doc_id, false)} AS fails
  FROM w LEFT JOIN m USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before
  FROM o, range(1, 6) r(step)
), t AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS own_fails,
         len(list_filter(before, lambda x: x <> '' AND fails[x])) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) AS n_fails
  FROM c, s
), g AS (
  SELECT part, filter_order, step, own,
         CAST(coalesce(sum(n) FILTER (NOT gone AND NOT own_fails), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (NOT gone AND own_fails), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND own_fails), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (own_fails AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT gone AND own_fails), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (NOT gone AND own_fails), 0) AS BIGINT) AS toxic_lost
  FROM t GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""


@query
def op12_grammar_runs(spark: SparkSession, folder: str) -> DataFrame:
    return grammarruns.periodic_runs(table(spark, folder, "documents"), drilled=True)


@query
def op13_entropy_balanced_mix(spark: SparkSession, folder: str) -> DataFrame:
    return balancing.mix(table(spark, folder, "documents"))

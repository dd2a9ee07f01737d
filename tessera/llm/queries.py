"""The registered queries of this subpackage: thin, each over its whole table, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprints, html_extract, ngram_join, packing, quality, sharding, suffix_dedup, url_filter, vafile

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", path, decoded="decoded", carry=["doc_id"]), path)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op8_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vafile.integer_vectors(table(spark, sf_dir, "embeddings"))
    return vafile.search(rows, rows.where(f"vec_id % {vafile.EVERY} = 0"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages with the day on which each counts as fetched, a rule of its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages and their domains of three labels: which are added, removed and added
    again, and when, is a rule of the name's MD5."""
    host = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    parent = F.when(F.size(labels) > 3, F.array_join(F.slice(labels, F.size(labels) - 2, 3), "."))
    names = host.select(F.explode(F.array_distinct(F.array_compact(F.array("host", parent)))).alias("host")).distinct()
    h = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 6), 16, 10).cast("int")
    rows = names.withColumn("h", h).where("h % 4 = 0")
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("h") % 200 + k).cast("int")).alias("at")
    category = F.concat(F.lit("category-"), (F.col("h") % 5).cast("string"))
    entry = lambda k, action: F.struct(day(k), F.lit(action).alias("action"), category.alias("category"))
    dated = F.when(F.col("h") % 16 == 0, F.array(entry(0, "add"), entry(60, "remove"), entry(120, "add"))).when(F.col("h") % 8 == 0, F.array(entry(0, "add"), entry(60, "remove"))).otherwise(F.array(entry(0, "add")))
    return rows.select("host", F.explode(dated).alias("e")).select("host", "e.at", "e.action", "e.category")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.evaluate(captures(pages), dated_list(pages))
    return judged.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "host", "matched_host", "category", F.col("active_since").cast("string").alias("active_since"), "blocked")


OP9 = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched,
  regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.+$', '') AS host FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM c WHERE host <> ''),
names AS (SELECT host FROM hosts UNION SELECT array_to_string(l[len(l) - 2 : len(l)], '.') FROM hosts WHERE len(l) > 3),
ruled AS (SELECT host, ('0x' || substr(md5(host), 1, 6))::INTEGER AS h FROM names),
entries AS (
  SELECT host, DATE '2024-01-01' + (h % 200) AS day, 'add' AS action, 'category-' || (h % 5) AS category FROM ruled WHERE h % 4 = 0
  UNION ALL SELECT host, DATE '2024-01-01' + (h % 200 + 60), 'remove', 'category-' || (h % 5) FROM ruled WHERE h % 8 = 0
  UNION ALL SELECT host, DATE '2024-01-01' + (h % 200 + 120), 'add', 'category-' || (h % 5) FROM ruled WHERE h % 16 = 0),
spans AS (SELECT *, lead(day) OVER (PARTITION BY host ORDER BY day) AS until FROM entries),
hits AS (SELECT c.page_id, s.host AS matched_host, s.category, s.day,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.host) DESC) AS r
  FROM c JOIN spans s ON (c.host = s.host OR ends_with(c.host, '.' || s.host)) AND s.action = 'add' AND s.day <= c.fetched AND (s.until IS NULL OR c.fetched < s.until))
SELECT c.page_id, c.url, CAST(CAST(c.fetched AS DATE) AS VARCHAR) AS fetched, c.host, h.matched_host, h.category, CAST(CAST(h.day AS DATE) AS VARCHAR) AS active_since, h.matched_host IS NOT NULL AS blocked
FROM c LEFT JOIN hits h ON h.page_id = c.page_id AND h.r = 1"""


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


OP8 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({vafile.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {vafile.EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {vafile.K}"""

QUERIES = {f.__name__: f for f in (op1_bpe, op2_fingerprints, op3_sharding, op4_suffix_dedup, op5_quality, op6_packing, op7_ngram_join, op8_vafile, op9_url_filter, op10_html)}
ORACLES: dict[str, str] = {"op3_sharding": sharding.oracle(), "op8_vafile": OP8, "op9_url_filter": OP9}

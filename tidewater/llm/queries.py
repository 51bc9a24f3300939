"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, embeddings, media, packing, pii, quality, simhash, substring, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.recovered_pages(spark, _table(spark, sf_dir, "pages"))


def warc_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of quarantined bytes of the same damaged crawl."""
    return warc.damaged_crawl(spark, _table(spark, sf_dir, "pages")).where("kind = 'gap'").select("path", "offset", "length", "reason")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded and decoded again."""
    return bpe.decode_documents(bpe.encode_documents(_table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_windows(_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.page_media(_table(spark, sf_dir, "pages"))


def media_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media columns that don't depend on where a payload lies."""
    return op8_media(spark, sf_dir).select("page_id", "digest", "raw_length", "media_type", "language", "charset", "title")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), 0.9)


def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links at a lower threshold, at which small tables hold pairs too."""
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), 0.35)


_CLASSES_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= {}),
reach AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x),
roots AS (SELECT x, min(y) AS y FROM reach GROUP BY x), counts AS (SELECT x, count(*) AS links FROM p GROUP BY x)
SELECT vec_id, least(vec_id, coalesce(roots.y, vec_id)) AS class_id, coalesce(links, 0) AS links
FROM v LEFT JOIN roots ON roots.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""

OP3_SQL = """
SELECT page_id, url, md5(html) AS html_md5, CAST(strlen(html) AS BIGINT) AS html_bytes FROM pages WHERE left(md5(url), 1) <> '0'
"""

MEDIA_SQL = r"""
SELECT page_id, sha256(html) AS digest, CAST(strlen(html) AS BIGINT) AS raw_length, 'text/html' AS media_type,
       regexp_extract(html, '<html[^>]*? lang="([\w-]+)', 1) AS language, regexp_extract(html, '<meta[^>]*? charset="([\w-]+)', 1) AS charset,
       regexp_extract(html, '<title[^>]*>(.*?)</title>', 1) AS title
FROM pages
"""

OP2_SQL = r"""
WITH toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS t
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), wins AS (
  SELECT doc_id, p - 1 AS pos, md5(array_to_string(list_slice(t, p, p + 49), ' ')) AS w
  FROM (SELECT doc_id, t, unnest(range(1, len(t) - 48)) AS p FROM toks WHERE len(t) >= 50)
), hits AS (
  SELECT doc_id, pos, CASE WHEN rn = 1 THEN 'keep' ELSE 'remove' END AS action FROM (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY w) AS n, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS rn FROM wins
  ) WHERE n > 1
), marks AS (
  SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, action ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM hits
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, action ORDER BY pos) AS g FROM marks
)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_token, CAST(max(pos) + 50 AS BIGINT) AS end_token,
       CAST(max(pos) + 50 - min(pos) AS BIGINT) AS n_tokens, action
FROM islands GROUP BY doc_id, action, g
"""

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substring": op2_substring,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_media": op8_media,
    "op9_pii": op9_pii,
    "op10_embeddings": op10_embeddings,
    "warc_gaps": warc_gaps,
    "bpe_round_trip": bpe_round_trip,
    "media_metadata": media_metadata,
    "embedding_neighbours": embedding_neighbours,
}
SQL = {
    "op2_substring": OP2_SQL,
    "op3_warc": OP3_SQL,
    "bpe_round_trip": "SELECT doc_id, text FROM documents",
    "media_metadata": MEDIA_SQL,
    "op10_embeddings": _CLASSES_SQL.format(0.9),
    "embedding_neighbours": _CLASSES_SQL.format(0.35),
}

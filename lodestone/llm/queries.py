"""The operators over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, decontam, language_id, line_dedup, media, mixing, near_dup, pii, suffix_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return got.withColumn("keep", F.lower(F.hex("keep")))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS pos, regexp_replace(parts[i], '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT doc_id, pos, line = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 AS keep FROM l),
r AS (SELECT doc_id, pos, keep, pos - row_number() OVER (PARTITION BY doc_id, keep ORDER BY pos) AS island FROM k),
s AS (SELECT doc_id, keep, min(pos) AS first, count(*) AS n FROM r GROUP BY doc_id, keep, island),
h AS (SELECT doc_id, keep, first, n, CASE WHEN first = 0 AND NOT keep THEN '00' ELSE '' END ||
  CASE WHEN n < 128 THEN printf('%02x', n) WHEN n < 16384 THEN printf('%02x%02x', (n & 127) | 128, n >> 7)
  ELSE printf('%02x%02x%02x', (n & 127) | 128, ((n >> 7) & 127) | 128, n >> 14) END AS code FROM s)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (keep), 0) AS BIGINT) AS n_kept, string_agg(code, '' ORDER BY first) AS keep
FROM h GROUP BY doc_id
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM d)),
m AS (SELECT doc_id, p FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
r AS (SELECT *, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END AS new FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM r)
SELECT doc_id, CAST(min(p) AS BIGINT) AS lo, CAST(max(p) + 50 AS BIGINT) AS hi FROM s GROUP BY doc_id, island
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.rules_from(pages))


OP7_SQL = r"""
WITH RECURSIVE c0 AS (SELECT DISTINCT url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages WHERE url IS NOT NULL),
c AS (SELECT url, lower(regexp_replace(regexp_replace(regexp_extract(bare, '^([^/?]*)', 1), '^.*@', ''), ':\d*$', '')) AS host,
  regexp_replace(CASE WHEN regexp_extract(bare, '^[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(bare, '^[^/?]*([^?]*)', 1) END, '/{2,}', '/', 'g') AS path,
  regexp_extract(bare, '^[^?]*(\?.*)$', 1) AS query FROM c0),
k AS (SELECT DISTINCT expr, kind FROM (
  SELECT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) || '/' AS expr, 1 AS kind FROM c UNION ALL
  SELECT host || '/' || string_split(path, '/')[2] || '/', 2 FROM c WHERE len(string_split(path, '/')) > 2) WHERE expr <> '/'),
r AS (SELECT expr, CASE WHEN md5(expr)[1] IN ('0', '1') THEN 'block' WHEN kind = 2 AND md5(expr)[1] IN ('2', '3', '4') THEN 'allow' END AS action FROM k),
rules AS (SELECT expr, min(action) AS action FROM r WHERE action IS NOT NULL GROUP BY expr),
h AS (SELECT url, path, query, array_to_string(l[i:], '.') AS h, len(l) - i + 1 AS labels FROM (
  SELECT url, path, query, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')))) AS i FROM c)),
p AS (SELECT url, path || query AS p FROM c UNION SELECT url, path FROM c UNION
  SELECT url, array_to_string(s[1:i], '/') || '/' FROM (SELECT url, string_split(path, '/') AS s, unnest(range(1, len(string_split(path, '/')))) AS i FROM c)),
m AS (SELECT h.url, rules.expr, rules.action, row_number() OVER (PARTITION BY h.url ORDER BY labels DESC, length(p) DESC, rules.action) AS n
  FROM h JOIN p USING (url) JOIN rules ON rules.expr = h || p)
SELECT page_id, pages.url, coalesce(action, 'allow') AS action, expr AS rule FROM pages LEFT JOIN m ON m.url = pages.url AND n = 1
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprint(media.clips(table(spark, sf_dir, "embeddings")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
dg AS (SELECT doc_id, p, hash(w[p + 1 : p + 10]) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 9)) AS p FROM d)),
bg AS (SELECT item_id, q, hash(w[q + 1 : q + 10]) AS g FROM (SELECT item_id, w, unnest(range(0, len(w) - 9)) AS q FROM b)),
m AS (SELECT DISTINCT doc_id, item_id, p, q FROM dg JOIN bg USING (g)),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island FROM m)
SELECT doc_id, item_id, CAST(min(p) AS INTEGER) AS doc_start, CAST(min(q) AS INTEGER) AS item_start, CAST(count(*) + 9 AS INTEGER) AS n_words
FROM r GROUP BY doc_id, item_id, p - q, island
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_source_mixing": op2_source_mixing,
    "op3_chat_format": op3_chat_format,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_pii": op8_pii,
    "op9_media_fingerprints": op9_media_fingerprints,
    "op10_decontamination": op10_decontamination,
}
ORACLES = {
    "op2_source_mixing": mixing.mix_sql(),
    "op4_line_dedup": OP4_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op7_url_filter": OP7_SQL,
    "op10_decontamination": OP10_SQL,
}

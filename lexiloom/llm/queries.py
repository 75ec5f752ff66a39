"""The ``opN_*`` queries: each operator on its whole table, and SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import byte_bpe, exact_dedup, language_id, line_dedup, near_dedup, packing, sharding, toxicity, transport_stream, url_filter
from ._common import crc_mod

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SHARD_BYTES = 8 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows go to Python, over all cores even where it is small."""
    return spread(_table(spark, sf_dir, name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _dealt(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity_model(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_dealt(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"), RULES).drop("alias_root")


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.read_media(transport_stream.media_column(_dealt(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _dealt(spark, sf_dir, "documents")
    model = language_id.fit_language_model(docs.where(crc_mod("doc_id", 3) != 1))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_lx_lines").alias("n_lines"), F.col("_lx_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_dealt(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_dealt(spark, sf_dir, "documents")).drop("n_links")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_exact_dedup, op3_byte_bpe, op4_sharding, op5_url_filter, op6_transport_stream, op7_language_id, op8_line_dedup, op9_packing, op10_near_dedup]
    return {f.__name__: f for f in found}


_OP2 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_OP8 = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line,
         translate(trim(unnest(lines), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM docs),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS dropped
  FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP5 = r"""
WITH RECURSIVE pg AS (
  SELECT page_id, regexp_extract(url, '(?s)^([^#]*)', 1) AS src, regexp_extract(url, '(?s)^(.*?):', 1) AS scheme,
         regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS origin, html, url
  FROM pages),
link AS (
  SELECT src, scheme, origin, unnest([
    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*([^"''\s>]+)', 1)]) AS l
  FROM pg WHERE url LIKE '%://%'),
edge AS (
  SELECT DISTINCT src, regexp_extract(CASE WHEN l LIKE '//%' THEN scheme || ':' || l WHEN l LIKE '/%' THEN origin || l ELSE l END, '(?s)^([^#]*)', 1) AS dst
  FROM link WHERE l <> ''),
reach AS (
  SELECT src AS a, src AS b FROM edge UNION SELECT dst, dst FROM edge
  UNION SELECT r.a, e.y FROM reach r JOIN (SELECT src AS x, dst AS y FROM edge UNION SELECT dst, src FROM edge) e ON r.b = e.x),
node AS (SELECT url AS u FROM pg UNION SELECT b FROM reach),
parts AS (
  SELECT u, coalesce(translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM node),
rules(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
ruled AS (
  SELECT u, host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
alias AS (
  SELECT a, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS v
  FROM reach JOIN ruled ON b = u GROUP BY a)
SELECT page_id, host, path, rule, coalesce(verdict, v, 'allow') AS verdict
FROM pg LEFT JOIN ruled ON u IS NOT DISTINCT FROM url LEFT JOIN alias ON a = src
"""


#: Directories of up to 24 bits; a bucket that no bit splits has no place in it.
_OP4 = f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS b,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS BIGINT) AS h FROM documents),
v AS (SELECT doc_id, b, CAST(depth AS INT) AS depth, h >> (60 - depth) AS prefix FROM d, range(25) AS r(depth)),
s AS (SELECT depth, prefix, CAST(sum(b) AS BIGINT) AS shard_bytes FROM v GROUP BY ALL HAVING sum(b) <= {SHARD_BYTES}),
l AS (SELECT doc_id, b, depth, prefix, shard_bytes, row_number() OVER (PARTITION BY doc_id, b ORDER BY depth) AS k FROM v JOIN s USING (depth, prefix))
SELECT doc_id, b AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, 0 AS page, shard_bytes FROM l WHERE k = 1
"""

_OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+') AS w FROM documents),
k AS (SELECT t, w, min(doc_id) AS least, count(*) AS n FROM w GROUP BY ALL),
u AS (SELECT CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE chr(0) || t END AS key, any_value(w) AS w, min(least) AS id, sum(n) AS n FROM k GROUP BY 1),
r AS (SELECT id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM u WHERE len(w) > 0)),
m AS (SELECT id, s, count(*) AS c FROM r GROUP BY ALL),
z AS (SELECT id, sum(c) AS n FROM m GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS c FROM m a JOIN m b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE c >= 0.8 * (x.n + y.n - c)),
g AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
reach AS (SELECT id AS x, id AS y FROM u UNION SELECT reach.x, g.y FROM reach JOIN g ON reach.y = g.x),
c AS (SELECT x AS id, min(y) AS class_id FROM reach GROUP BY x),
f AS (SELECT doc_id, class_id FROM w JOIN u ON u.key = CASE WHEN len(w.w) > 0 THEN array_to_string(w.w, ' ') ELSE chr(0) || w.t END JOIN c ON c.id = u.id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _OP2, "op4_sharding": _OP4, "op5_url_filter": _OP5, "op8_line_dedup": _OP8, "op10_near_dedup": _OP10}

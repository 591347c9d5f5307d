"""The opN queries: thin callables over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, licenses, minhash, mixing, quality, sentencepiece_codec, substring, toxicity, urlfilter, warc
from .common import table

#: The rules of op3.
URL_RULES = (
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
)


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES, "page_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"), window=50)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id").drop("hits")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"), "doc_id", fraction=1.0, max_epochs=3)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 judges by before its learned list: all that SQL can say of it."""
    return quality.statistics(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.failed().alias("base_failed"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of op9's base phrases: all that SQL can say of it."""
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_segments, op2_projected_neighbours, op3_url_filter, op4_sentencepiece, op5_near_duplicates, op6_substring_dedup, op7_quality_rules, op8_toxicity, op9_license_scan, op10_mixing, quality_base, license_base)}

#: A host's and path's longest rule, over the rules written out.
_OP3 = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, verdict, rhost || rpath AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS r
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.r = 1
"""

_OP1 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), first AS (SELECT digest, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > least THEN least END AS refers_to, true AS ok
FROM p LEFT JOIN first ON p.digest = first.digest
"""

_WORDS = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda v: v <> '')"""

_OP5 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM d
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id,
  d.doc_id = (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS kept
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

_OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
keyed AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM wins),
first AS (SELECT k, min(doc_id) AS least FROM keyed GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM keyed JOIN first USING (k) WHERE doc_id > least
), each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
marked AS (SELECT e.doc_id, e.j, e.x, g.j IS NOT NULL AS out FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j),
sums AS (SELECT doc_id, count(*) AS n, sum(CAST(out AS BIGINT)) AS m, coalesce(string_agg(x, ' ' ORDER BY j) FILTER (WHERE NOT out), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""

_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
threes AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
keyed AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM threes),
often AS (SELECT doc_id, k FROM keyed GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM keyed JOIN often USING (doc_id, k)) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id
"""

_LICENSE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '') AS w FROM documents),
phrases(p, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
places AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN phrases ON w[i : i + len(p) - 1] = p),
sums AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM places GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op1_warc_segments": _OP1, "op3_url_filter": _OP3, "op5_near_duplicates": _OP5, "op6_substring_dedup": _OP6, "quality_base": _QUALITY, "license_base": _LICENSE}

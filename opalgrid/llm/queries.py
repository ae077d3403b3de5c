"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opalgrid.llm import decontaminate, licenses, mixing, pii, quality, simhash, substrings, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.listed_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("host_rate")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask(_table(spark, sf_dir, "documents"), count="n_entities").select("doc_id", "text", "n_entities")


def queries() -> dict:
    own = (op1_decontaminate, op2_substring_dedup, op3_toxicity, op4_simhash, op5_url_filter, op6_license_scan, op7_quality_rules, op8_warc, op9_mix, op10_pii_surrogates)
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT l.doc_id, l.r, z.n, i, array_to_string(l.w[i:i + z.n - 1], ' ') AS s
  FROM (SELECT lowered.*, unnest(range(1, len(w) + 1)) AS i FROM lowered) l, (SELECT DISTINCT n FROM windows) z
  WHERE i + z.n - 1 <= len(l.w)),
found AS (SELECT p.r, p.i, p.n, v.item_id FROM places p JOIN windows v ON p.s = v.s AND p.n = v.n),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

OP2_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM again)),
words AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM split)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

OP5_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
    url IS NOT NULL AND strpos(url, '://') > 0 AS good FROM pages),
parts AS (
  SELECT page_id, good, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM cut),
plain AS (
  SELECT *, CASE WHEN good THEN regexp_replace(host, '^(www|m)\.|:(80|443)$', '', 'g') || regexp_replace(path, '/+$|/index\.html?$', '', 'g')
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical_url
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=&]*|ref|fbclid|gclid)=[^&]*$'))), '&') AS q FROM parts)),
listed AS (
  SELECT h || '.example.' || t || '/' || l || '/' || n AS canonical_url
  FROM (SELECT unnest(['spam-farm', 'ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets']) AS h), (SELECT unnest(['com', 'net', 'org']) AS t),
    (SELECT unnest(['de', 'en', 'es', 'fr']) AS l), range(2500) AS r(n)),
ruled AS (
  SELECT page_id, host, path, canonical_url, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM plain)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
  ELSE CASE WHEN canonical_url IN (SELECT canonical_url FROM listed WHERE canonical_url IS NOT NULL) THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled
"""

OP7_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
dups AS (SELECT r, sum(n - 1) AS n_dup_lines FROM lines GROUP BY r),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
many AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
reps AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS k FROM many) GROUP BY r),
base AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN dups USING (r) LEFT JOIN reps USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS d, sum(CAST(base_failed AS BIGINT)) AS f FROM judged GROUP BY source),
corpus AS (SELECT sum(d) AS n, sum(f) / sum(d) AS mean, count(*) AS h, sum(f * f / d) AS ff FROM hosts),
prior AS (
  SELECT mean, least(1000, greatest(1, mean * (1 - mean) / greatest(1e-9, greatest(0, ff / n - mean * mean) - mean * (1 - mean) * h / n) - 1)) AS strength FROM corpus),
bad AS (SELECT source, (f + strength * mean) / (d + strength) >= mean + 0.25 AS host_bad FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_bad AS kept
FROM judged JOIN bad ON judged.source IS NOT DISTINCT FROM bad.source
"""

OP8_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 AND count(*) OVER g > 1 THEN max(page_id) OVER g END AS latest FROM p WINDOW g AS (PARTITION BY d, n >= 1000))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN latest <> page_id THEN latest END AS refers_to
FROM q
"""

OP9_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM totals),
filled AS (
  SELECT *, s * 6 // w AS fills, sum(s) OVER () AS ts, sum(w) OVER () AS tw, coalesce(sum(s) OVER o, 0) AS cs, coalesce(sum(w) OVER o, 0) AS cw
  FROM weighed WINDOW o AS (ORDER BY s * 6 // w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(ts AS DOUBLE) - CAST(2 AS DOUBLE) * CAST(cs AS DOUBLE)) / CAST(tw - cw AS DOUBLE) AS level FROM filled),
chosen AS (SELECT level AS l FROM levels WHERE level * w <= CAST(2 AS DOUBLE) * s ORDER BY fills LIMIT 1),
goals AS (SELECT source, s AS source_size, CASE WHEN l * w > CAST(2 AS DOUBLE) * s THEN CAST(2 AS DOUBLE) * s ELSE w * l END AS target FROM weighed, chosen),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, substr(md5('20240229|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size), 1, 16), doc_id NULLS FIRST) - 1 AS k FROM sized),
steps AS (
  SELECT r.doc_id, r.size, source_size, target, k, CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS rate,
    CAST(CAST('0x' || substr(md5('20240229|' || coalesce('s' || r.source, 'n')), 1, 7) AS BIGINT) AS DOUBLE) / CAST(268435456 AS DOUBLE) AS start
  FROM ranks r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(c * size AS BIGINT) AS taken, CAST(c AS BIGINT) AS copies
FROM (SELECT *, least(floor((k + 1) * rate + start) - floor(k * rate + start), ceil(rate), 2) AS c FROM steps)
"""


def oracle_sql() -> dict:
    return {"op1_decontaminate": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op5_url_filter": OP5_SQL, "op7_quality_rules": OP7_SQL, "op8_warc": OP8_SQL, "op9_mix": OP9_SQL}

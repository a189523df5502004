"""The queries opN_<name> over the driver tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, collocations, exact_dedup, lexical_search, line_dedup, mixing, near_dedup, neighbours, pii, quality, secret_scan, token_counts, url_filter
from citeloom.llm.common import table

#: The rules of the url filter's query.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those that go because an earlier one is equal or near, however short, and the digest of the text that stays."""
    cleaned = line_dedup.line_report(table(spark, sf_dir, "documents"), min_near=1)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    return cleaned.select("doc_id", "n_lines", "n_equal", "n_near", digest)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("__tx")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=4, percent=80).drop("__tx")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("__tx")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(secret_scan.secret_spans(table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page carries the text of the document that its url's last number names; its outcome is bad if that is labelled low quality or toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})[^/]*/?$", 1)
    numbered = pages.select("url", number.alias("number")).filter("number <> ''").select("url", F.col("number").cast("bigint").alias("doc"))
    judged = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    outcomes = numbered.join(judged, F.col("doc") == F.col("doc_id")).select("url", "bad")
    return url_filter.url_verdicts(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_near_dedup": op3_near_dedup,
        "op4_quality": op4_quality,
        "op5_token_counts": op5_token_counts,
        "op6_secret_scan": op6_secret_scan,
        "op7_url_filter": op7_url_filter,
        "op8_neighbours": op8_neighbours,
        "op9_mixing": op9_mixing,
        "op10_bpe_round_trip": op10_bpe_round_trip,
        "op11_collocations": op11_collocations,
        "op12_lexical_search": op12_lexical_search,
        "op13_pii": op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE.replace("MIN_NEAR", "1"),
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op3_near_dedup": near_dedup.ORACLE,
        "op7_url_filter": OP7_SQL,
        "op11_collocations": collocations.ORACLE,
        "op12_lexical_search": lexical_search.ORACLE,
    }


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), judged AS (
  SELECT doc_id, max(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), labelled AS (
  SELECT host, count(*) AS n, sum(bad::INT) AS b
  FROM p JOIN judged ON try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})[^/]*/?$', 1), '') AS BIGINT) = doc_id GROUP BY host
), hosts AS (
  SELECT host, coalesce(n, 0)::DOUBLE AS n, coalesce(b, 0)::DOUBLE AS b,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare
  FROM (SELECT DISTINCT host FROM p) LEFT JOIN labelled USING (host)
), parts AS (
  SELECT *, array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') AS two, regexp_full_match(bare, '[0-9]{1,3}([.][0-9]{1,3}){3}|\[.*\]') AS address FROM hosts
), named AS (
  SELECT *, CASE WHEN address THEN bare WHEN two IN (SUFFIXES) THEN array_to_string(list_slice(string_split(bare, '.'), -3, -1), '.') ELSE two END AS domain,
         CASE WHEN address THEN '[address]' WHEN two IN (SUFFIXES) THEN two ELSE string_split(bare, '.')[-1] END AS suffix FROM parts
), bares AS (SELECT suffix, domain, bare, sum(n) AS n, sum(b) AS b FROM named GROUP BY ALL
), domains AS (SELECT suffix, domain, sum(n) AS n, sum(b) AS b FROM bares GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY ALL
), moments AS (
  SELECT lvl, count(*) FILTER (n > 0)::DOUBLE AS m, sum(n) AS tn, sum(b) AS tb, sum(n * n) AS n2, coalesce(sum(CASE WHEN n > 0 THEN b * b / n END), 0) AS q
  FROM (SELECT 1 AS lvl, n, b FROM suffixes UNION ALL SELECT 2, n, b FROM domains UNION ALL SELECT 3, n, b FROM bares) GROUP BY lvl
), rhos AS (
  SELECT lvl, (q - tn * pr * pr - pr * (1 - pr) * (m - 1)) / nullif(pr * (1 - pr) * (tn - n2 / tn - (m - 1)), 0) AS rho
  FROM (SELECT *, tb / nullif(tn, 0) AS pr FROM moments)
), ks AS (SELECT lvl, CASE WHEN rho > 0 THEN greatest(1.0, least(1000.0, 1 / rho - 1)) ELSE 1000.0 END AS k FROM rhos
), whole AS (SELECT (sum(b) + 1) / (sum(n) + 2) AS mean0, (SELECT k FROM ks WHERE lvl = 1) AS k1, (SELECT k FROM ks WHERE lvl = 2) AS k2, (SELECT k FROM ks WHERE lvl = 3) AS k3 FROM suffixes
), post AS (
  SELECT bares.bare, k3 + bares.n AS total, least(LIFT * mean0, (1 + mean0) / 2) AS most,
         (k3 * ((k2 * ((k1 * mean0 + suffixes.b) / (k1 + suffixes.n)) + domains.b) / (k2 + domains.n)) + bares.b) / (k3 + bares.n) AS mean
  FROM bares JOIN domains USING (suffix, domain) JOIN suffixes USING (suffix), whole
), ruled AS (
  SELECT page_id, host, path, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'www.example.com/en/' THEN 'allow' WHEN 'com/' THEN 'allow' WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block'
            ELSE CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) > most THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled LEFT JOIN post USING (bare)
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in url_filter.SUFFIXES)).replace("LIFT", str(url_filter.LIFT))

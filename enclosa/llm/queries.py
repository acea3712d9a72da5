"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from enclosa.llm.common import Shared, table
from enclosa.llm.decontamination import leaks
from enclosa.llm.language_id import fit as fit_language
from enclosa.llm.language_id import language_id
from enclosa.llm.license_scan import license_scan
from enclosa.llm.packing import pack_documents
from enclosa.llm.quality_ranker import fit as fit_ranker
from enclosa.llm.quality_ranker import rank_quality
from enclosa.llm.quality_rules import weak_supervision
from enclosa.llm.set_join import near_duplicates
from enclosa.llm.substring_dedup import removals
from enclosa.llm.token_files import flat_blocks, token_counts
from enclosa.llm.url_filter import host_of, temporal_filter

#: End-of-document id of the vocabulary used; flat files hold ids of two bytes.
END = 50256


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(docs, fit_language(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures fetched on day page_id mod 365; a list with one to two dated entries for each host, from the host's least page_id, and two for parent domains."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 365).alias("fetched"))
    first = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.min("page_id").alias("m")).where("host IS NOT NULL")
    entries = first.where("m % 3 < 2").selectExpr("host", "'block' AS action", "m % 200 AS day")
    entries = entries.unionByName(first.where("m % 2 = 0").selectExpr("host", "'allow' AS action", "m % 200 + 60 AS day"))
    parents = spark.createDataFrame([("example.net", "block", 100), ("example.net", "allow", 250), ("example.org", "block", 300)], "host string, action string, day long")
    return temporal_filter(pages, entries.unionByName(parents))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_supervision(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as flat files of ids, whose tokens are counted without any index; doc_id comes back by a document's number in its file."""
    made = Shared(spark, "token-files").keep(flat_blocks(table(spark, sf_dir, "documents"), vocabulary(), END), "flat")
    counts = token_counts(made.where("tokens IS NOT NULL"), END)
    ids = made.where("tokens IS NULL").select("file_id", F.col("block").alias("document"), "doc_id")
    return counts.join(ids, ["file_id", "document"]).select("doc_id", "n_tokens", "file_id", "document", "start", "closed")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op7_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rank_quality(docs, fit_ranker(docs, table(spark, sf_dir, "labels")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_language_id, op2_decontamination, op3_url_filter, op4_quality_rules, op5_token_counts,
    op6_packing, op7_quality_ranker, op8_license_scan, op9_set_join, op10_substring_dedup,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": r"""
WITH caps AS (
  SELECT page_id, page_id % 365 AS fetched,
    nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') AS host
  FROM pages),
first AS (SELECT host, min(page_id) AS m FROM caps WHERE host IS NOT NULL GROUP BY host),
raw AS (
  SELECT host, 'block' AS action, m % 200 AS day FROM first WHERE m % 3 < 2
  UNION ALL SELECT host, 'allow', m % 200 + 60 FROM first WHERE m % 2 = 0
  UNION ALL SELECT * FROM (VALUES ('example.net', 'block', 100), ('example.net', 'allow', 250), ('example.org', 'block', 300)) v),
spans AS (
  SELECT host, action, day AS valid_from, lead(day) OVER (PARTITION BY host ORDER BY day) AS valid_to
  FROM (SELECT host, day, max(action) AS action FROM raw GROUP BY host, day)),
hits AS (
  SELECT page_id, spans.host AS matched, action, valid_from,
    row_number() OVER (PARTITION BY page_id ORDER BY length(spans.host) DESC) AS k
  FROM caps JOIN spans ON (caps.host = spans.host OR ends_with(caps.host, '.' || spans.host))
    AND valid_from <= fetched AND (valid_to IS NULL OR valid_to > fetched))
SELECT page_id, caps.host AS host, matched, action, CAST(valid_from AS BIGINT) AS valid_from,
  coalesce(action, 'allow') <> 'block' AS kept
FROM caps LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (page_id)
""",
}

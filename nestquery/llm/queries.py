"""The queries of the operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, langid, licenses, ngram_join, quality, sentencepieces, token_counts, toxicity, warc
from .tables import prepare, shared_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files to the shared folder, and their response records read back."""
    prepare(spark)
    path = shared_path(spark, "warc")
    warc.write_warc(warc.pages_as_records(table(spark, sf_dir, "pages")), path)
    return warc.pages_from_records(spark, path)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sentencepieces.encode(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.language_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_ngram_join": op5_ngram_join,
    "op6_html_extraction": op6_html_extraction,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
}

ORACLE: dict[str, str] = {
    "op1_warc": "SELECT page_id, url, 200::INTEGER AS http_status, strlen(html)::BIGINT AS n_bytes, html FROM pages",
    "op5_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]|(?:_|[^\P{L}\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]|[^\P{M}\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]|[^\P{N}\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])+') AS w FROM documents WHERE doc_id IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
    ELSE unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i+2], ' '))) END AS g
  FROM words WHERE len(w) > 0
), sets AS (SELECT doc_id, list(g ORDER BY g) AS c FROM grams GROUP BY doc_id),
texts AS (SELECT c, len(c) AS n, min(doc_id) AS rep, count(*) AS n_copies FROM sets GROUP BY c),
held AS (SELECT rep, n, g FROM texts JOIN grams ON doc_id = rep),
shared AS (SELECT a.rep AS a, b.rep AS b, a.n + b.n AS sizes, count(*) AS common FROM held a JOIN held b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE common >= 0.5 * (sizes - common)),
reach AS (SELECT rep AS a, rep AS b FROM texts UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
degrees AS (SELECT a AS rep, count(*) AS n_links FROM links GROUP BY a),
found AS (
  SELECT doc_id, class_id, n_copies, coalesce(n_links, 0) AS n_links
  FROM sets JOIN texts USING (c) JOIN classes USING (rep) LEFT JOIN degrees USING (rep)
)
SELECT DISTINCT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN found USING (doc_id) WHERE d.doc_id IS NOT NULL""",
}

"""The corpus pipeline: quality rules, language ID, one of each group of near copies, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``documents``; the last returns doc_id, n_tokens, token_ids and round_trip. A stage's result is written as Parquet to
the folder the executors share and read again before the next, so a lost executor never costs more than its stage.
An empty ``documents`` gives an empty result; a row with a NULL doc_id is judged like any other, and stays in the
near-copy stage. Very long texts are judged, compared and encoded whole. Repeated rows of a doc_id are judged alike and kept
or dropped together. Of a group of near copies the least doc_id stays, so there are no ties. Columns besides those of
``documents`` are carried through, whatever their names, to all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestquery.llm import decontaminate, langid, ngram_join, quality, sentencepieces
from nestquery.llm.tables import prepare, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose histograms are near those of a language."""
    prepare(spark)
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin."""
    prepare(spark)
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and all others."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    prepare(spark)
    return sentencepieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: SQL has no zstandard, no alignment and no tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs

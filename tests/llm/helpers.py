"""Small tables with every awkward row: NULLs, empty and long texts, repeated rows, and columns whose names operators use."""

from pyspark.sql import types as T

EXTRA = ("key", "k", "_id", "_doc", "_drop", "label", "content", "row", "word", "h", "item_id", "node", "verdict", "language")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in EXTRA]])


def docs(spark, rows, lang="en"):
    """Rows of (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else lang, None, None if r[1] is None else len(r[1]), *["x"] * len(EXTRA)) for r in rows], DOCS)


def awkward(long="word " * 40_000):
    return [(1, "plain text of several words"), (1, "plain text of several words"), (2, None), (3, ""), (4, " \t\n "), (None, "no id at all here"), (5, long), (6, "x" * 70_000), (7, "\x00�\U0001f600 é"), (8, "word")]


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string, doc_id string")

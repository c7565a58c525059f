"""Language ID by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content zstandard dictionary, a bounded sample of its documents. A text is cut into blocks of
``block`` bytes, each compressed on its own with the dictionary, so that a long text depends on the dictionary as a
short one does; all blocks count. The language of the smallest sum wins; if the next is within ``min_margin`` of it,
the text is rejected.

Defined results: an empty or NULL text has no language and is rejected. With one dictionary there is no second and no
narrow margin. Without any (no document with a language) every text is rejected. Ties in size are within any margin,
so rejected. Repeated rows get the same answer each; NULL ids are carried through; all of a very long text counts; an empty
table has no rows; extra columns are ignored, or kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .tables import lean, written


@dataclass(frozen=True)
class LangIdConfig:
    #: Distinct training texts of each language at most, the first in the order of a hash, of this many characters.
    fit_rows: int = 60
    #: Languages at most that get a dictionary, those with the most training texts.
    languages: int = 500
    fit_chars: tuple[int, int] = (200, 5000)
    #: Bytes of a dictionary at most: the last of the training texts.
    dictionary: int = 64 << 10
    block: int = 4096
    level: int = 6
    #: Of the second smallest size, the share by which the smallest must be smaller.
    min_margin: float = 0.01


def train(docs: DataFrame, config: LangIdConfig = LangIdConfig()) -> dict[str, bytes]:
    """A dictionary for each value of ``lang``. At most ``fit_rows`` texts of a language reach the driver."""
    low, high = config.fit_chars
    some = docs.filter(F.col("lang").isNotNull() & F.length("text").between(low, high)).select("lang", "text", F.xxhash64("text").alias("h"))
    # copies count once: the first hashes are told from hashes alone, so that no more than their texts are moved
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    hashes = written(some.select("lang", "h").distinct().withColumn("first", first).filter(F.col("first") <= config.fit_rows).select("lang", "h"), "training-hashes")
    most = hashes.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(config.languages).select("lang")
    hashes = hashes.join(F.broadcast(most), "lang")  # as many rows as languages and training texts at most
    some = some.join(F.broadcast(hashes), ["lang", "h"]).dropDuplicates(["lang", "text"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    texts: dict[str, list[str]] = {}
    for r in some.withColumn("rank", rank).filter(F.col("rank") <= config.fit_rows).orderBy("lang", "rank").collect():
        texts.setdefault(r.lang, []).append(r.text)
    return {lang: "\n".join(t).encode()[-config.dictionary :] for lang, t in texts.items()}


class Classifier:
    """Compressed sizes of texts under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], config: LangIdConfig) -> None:
        self.languages = sorted(dictionaries)
        self.config = config
        self.compressors = []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=config.level)
            self.compressors.append(zstandard.ZstdCompressor(level=config.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, column: pa.Array) -> np.ndarray:
        data, offsets = tx.string_buffers(column)
        view = memoryview(data)
        out = np.zeros((len(offsets) - 1, len(self.languages)), np.int64)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for at in range(a, b, self.config.block):
                part = view[at : min(b, at + self.config.block)]
                for j, c in enumerate(self.compressors):
                    out[i, j] += len(c.compress(part))
        return out

    def classify(self, column: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Nearest language, margin, and whether it is accepted."""
        sizes = self.sizes(column)
        n = len(sizes)
        if not self.languages:
            return [None] * n, np.zeros(n), np.zeros(n, bool)
        best = sizes.argmin(1)
        ordered = np.sort(sizes, 1)
        margin = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1) if len(self.languages) > 1 else np.ones(n)
        some = ordered[:, 0] > 0
        ok = some & (margin >= self.config.min_margin)
        return [self.languages[j] if s else None for j, s in zip(best, some)], np.where(some, margin, 0.0), ok


def language_scores(docs: DataFrame, config: LangIdConfig = LangIdConfig()) -> DataFrame:
    """doc_id, nearest (smallest size), margin, language (NULL where rejected): one row for each document."""
    dictionaries = train(docs, config)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries, config)
        for batch in batches:
            nearest, margin, ok = classifier.classify(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nearest, pa.string()), pa.array(margin, pa.float64()), pa.array([x if k else None for x, k in zip(nearest, ok)], pa.string())], names=["doc_id", "nearest", "margin", "language"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(score), f"doc_id {kind}, nearest string, margin double, language string")


def keep_identified(docs: DataFrame, config: LangIdConfig = LangIdConfig()) -> DataFrame:
    """The documents whose language is accepted, with all their columns."""
    dictionaries = train(docs, config)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries, config)
        for batch in batches:
            yield batch.filter(pa.array(classifier.classify(batch.column("text"))[2]))

    return docs.mapInArrow(lean(keep), docs.schema)

"""Quality rules: divergence of a document's histograms from language references.

Two histograms of a document, of character classes and of common words, are compared with those of each reference
language by Jensen-Shannon distance (base 2, 0 to 1). A document passes if one language is near in both. The
references are trained on a bounded sample of labelled rows; every document is judged, on its whole text.

Defined results: an empty or NULL text (or one without any word) is rejected as ``empty``. A text shorter than
``min_words`` or ``min_chars`` has no dependable histogram; the guard passes it as ``short``, but not one that has few words
because they are very long. Without any usable label no reference exists and every other text passes as ``unjudged``; so
does a document whose ``lang`` is known and has no reference, as there is nothing to compare it with. A NULL ``lang`` (or no
such column) compares with all references; in the sample such rows are left out. Of languages that are equally near
(ties) the first by name is the nearest. Repeated rows are judged alike, each one; all of a very long text counts; an
empty table has no rows; other columns are carried through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import lean

CLASSES = ("lower", "upper", "digit", "space", "line end", "sentence mark", "other mark", "non-ASCII")
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 32]], _CLASS[[10, 13]], _CLASS[128:] = 3, 4, 7
for _c in b".,;:?'\"()-":
    _CLASS[_c] = 5


@dataclass(frozen=True)
class QualityConfig:
    #: Labelled rows of quality 1 that the references are trained on, the first in the order of a hash of their id.
    fit_rows: int = 4000
    #: Common words of each language.
    common: int = 40
    min_words: int = 12
    min_chars: int = 60
    #: Characters of a word up to which too few words make a text short.
    long_word: int = 40
    #: Greatest distances of a long text; a short one's histogram is a small sample, so ``noise / sqrt(length)`` is added.
    max_char_distance: float = 0.13
    char_noise: float = 0.8
    max_word_distance: float = 0.34
    word_noise: float = 0.9


@dataclass(frozen=True)
class References:
    languages: tuple[str, ...]
    #: Class shares by language.
    chars: np.ndarray
    #: Hashes of all common words, sorted, and their shares by language; the last column is any other word.
    words: np.ndarray
    shares: np.ndarray


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of shares."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(lang, text) of the labelled good documents that train the references; at most ``rows`` labels are used."""
    good = (
        labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    texts = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("_doc"), F.col("lang"), F.col("text"))
    return texts.join(F.broadcast(good), F.col("_doc") == F.col("_id")).select("lang", "text")  # the sample is bounded


def train(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> References | None:
    """References from the sample. What reaches the driver is a few rows for each language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            kinds, keys, counts, names = [], [], [], []
            for a, b, data, offsets in _groups(batch.column("text")):
                by_class = _class_counts(data, offsets)
                low = tx.string_buffers(pa.compute.utf8_lower(batch.column("text").slice(a, b - a)))
                w = tx.words(*low)
                for lang in set(langs[a:b]):
                    rows = np.flatnonzero(langs[a:b] == lang)
                    total = by_class[rows].sum(0)
                    h, n = np.unique(w.hash[np.isin(w.row, rows)], return_counts=True)
                    names += [lang] * (len(total) + len(h))
                    kinds += [0] * len(total) + [1] * len(h)
                    keys += [*range(len(total)), *h.view(np.int64).tolist()]
                    counts += [*total.tolist(), *n.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "kind", "key", "n"])

    counts = sample(docs, labels, config.fit_rows).mapInArrow(lean(count), "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(_by_count())
    kept = counts.withColumn("total", F.sum("n").over(_by_kind())).withColumn("rank", rank).filter((F.col("kind") == 0) | (F.col("rank") <= config.common)).collect()
    languages = tuple(sorted({r.lang for r in kept}))
    if not languages:
        return None
    common = np.unique(np.array([r.key for r in kept if r.kind == 1], np.int64).view(np.uint64))
    chars, shares = np.zeros((len(languages), len(CLASSES))), np.zeros((len(languages), len(common) + 1))
    for r in kept:
        i = languages.index(r.lang)
        if r.kind == 0:
            chars[i, r.key] = r.n / max(r.total, 1)
        else:
            shares[i, np.searchsorted(common, np.uint64(r.key & (2**64 - 1)))] = r.n / r.total
    shares[:, -1] = 1 - shares.sum(1)
    return References(languages, chars, common, shares)


def _by_kind():
    from pyspark.sql import Window

    return Window.partitionBy("lang", "kind")


def _by_count():
    return _by_kind().orderBy(F.desc("n"), "key")


def _groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = tx.string_buffers(column)
    for a, b in tx.row_groups(offsets):
        yield a, b, data, offsets[a : b + 1]


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each class by row; of a non-ASCII character the first byte counts."""
    rows, k = len(offsets) - 1, len(CLASSES)
    out = np.zeros(rows * k, np.int64)
    for at in range(int(offsets[0]), int(offsets[-1]), tx.BLOCK):
        b = data[at : min(at + tx.BLOCK, int(offsets[-1]))]
        first, last = np.searchsorted(offsets, [at, at + len(b) - 1], side="right") - 1
        lengths = np.diff(np.clip(offsets[first : last + 2], at, at + len(b)))
        key = np.repeat(np.arange(first, last + 1) * k, lengths) + _CLASS[b]
        part = np.bincount(key[(b & 0xC0) != 0x80], minlength=rows * k)
        out += part
    return out.reshape(rows, k)


def judge(column: pa.Array, lang: pa.Array | None, refs: References | None, config: QualityConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """For each text: distance by characters, by words (NaN where not computed), the nearest language, the verdict."""
    by_char, by_word, near, verdict = [], [], [], []
    known = pa.array(refs.languages if refs else (), pa.string())
    foreign = np.zeros(len(column), bool) if lang is None else np.array(pa.compute.and_(lang.is_valid(), pa.compute.invert(pa.compute.is_in(lang.cast(pa.string()), known))))
    for a, b, data, offsets in _groups(column):
        w = tx.words(*tx.string_buffers(pa.compute.utf8_lower(column.slice(a, b - a))))
        rows = b - a
        n_words = np.bincount(w.row, minlength=rows)
        chars = _class_counts(data, offsets)
        n_chars = chars.sum(1)
        c, d, nearest = np.full(rows, np.nan), np.full(rows, np.nan), np.full(rows, -1)
        other = foreign[a:b]
        if refs is not None:
            k = len(refs.words) + 1
            i = np.minimum(np.searchsorted(refs.words, w.hash), max(k - 2, 0)) if k > 1 else np.zeros(len(w.hash), np.int64)
            slot = np.where(refs.words[i] == w.hash, i, k - 1) if k > 1 else i
            shares = np.bincount(w.row * k + slot, minlength=rows * k).reshape(rows, k) / np.maximum(n_words, 1)[:, None]
            both = np.stack([np.stack([js_distance(chars / np.maximum(n_chars, 1)[:, None], refs.chars[j]), js_distance(shares, refs.shares[j])]) for j in range(len(refs.languages))])
            most_c = config.max_char_distance + config.char_noise / np.sqrt(np.maximum(n_chars, 1))
            most_d = config.max_word_distance + config.word_noise / np.sqrt(np.maximum(n_words, 1))
            nearest = (both[:, 0] / most_c + both[:, 1] / most_d).argmin(0)
            c, d = both[nearest, 0, np.arange(rows)], both[nearest, 1, np.arange(rows)]
            near_any = ((both[:, 0] <= most_c) & (both[:, 1] <= most_d)).any(0)
        empty = n_words == 0
        short = ((n_words < config.min_words) & (n_chars < config.min_words * config.long_word)) | (n_chars < config.min_chars)
        for r in range(rows):
            verdict.append("empty" if empty[r] else "short" if short[r] else "unjudged" if refs is None or other[r] else "pass" if near_any[r] else "diverges")
        judged = ~(empty | short | other) if refs is not None else np.zeros(rows, bool)
        by_char.append(np.where(judged, c, np.nan))
        by_word.append(np.where(judged, d, np.nan))
        near.append(np.where(judged, nearest, -1))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0)
    return cat(by_char), cat(by_word), cat(near).astype(int), verdict


def quality_scores(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, char_distance, word_distance, near_lang, verdict, keep: one row for each document."""
    refs = train(docs, labels, config)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, d, near, verdict = judge(batch.column("text"), batch.column("lang") if "lang" in batch.schema.names else None, refs, config)
            names = [refs.languages[i] if i >= 0 else None for i in near] if refs else [None] * len(verdict)
            keep = [v not in ("empty", "diverges") for v in verdict]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(c, from_pandas=True), pa.array(d, from_pandas=True), pa.array(names, pa.string()), pa.array(verdict, pa.string()), pa.array(keep, pa.bool_())], names=["doc_id", "char_distance", "word_distance", "near_lang", "verdict", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns]).mapInArrow(lean(score), f"doc_id {kind}, char_distance double, word_distance double, near_lang string, verdict string, keep boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that the rules pass, with all their columns."""
    refs = train(docs, labels, config)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = judge(batch.column("text"), batch.column("lang") if "lang" in batch.schema.names else None, refs, config)[3]
            yield batch.filter(pa.array([v not in ("empty", "diverges") for v in verdict], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)

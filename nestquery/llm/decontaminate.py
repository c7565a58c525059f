"""Benchmark decontamination: rare n-gram seeds find the passages, Smith-Waterman alignment scores them.

A seed is a word n-gram of a benchmark item that chance would seldom make: its expected occurrences in a million words,
the product of its words' shares in the corpus, are at most ``rare``. Copies of a passage don't change that, so a much
copied item keeps its seeds. An item with fewer than ``min_seeds`` rare n-grams is sought by all of its n-grams. Around
each seed in a document lies a window that holds every sufficient alignment through the seed: the item's length, and on
either side as many words as gaps may then be. The local alignment of item and window (match 2, mismatch and gap -1, in
words) over twice the item's length is the score.

Items are broadcast in portions of ``portion`` characters at most, one pass over the documents each, and only their words'
counts come back from the corpus. There is no shuffle of texts.

Defined results: items that are NULL, have a NULL id or fewer than n words match nothing. Repeated items count once.
Empty and NULL documents match nothing, and empty tables have no matches. Repeated documents are reported each; a NULL doc_id
is reported as NULL. Ids may be of any type. Of an item that matches in several places the best is reported, the first of
equals; all items are, ties included. Very long documents are searched whole, and windows are no longer than their items
need. Extra columns are ignored, or kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import text as tx
from .tables import lean


@dataclass(frozen=True)
class DecontaminationConfig:
    n: int = 3
    #: Expected chance occurrences in a million words up to which an n-gram is rare.
    rare: float = 1.0
    min_seeds: int = 4
    #: Least score of a match.
    threshold: float = 0.5
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    portion: int = 16 << 20


@dataclass(frozen=True)
class Items:
    """A portion of the benchmark: word hashes by item, and sorted seeds with their item and place."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray


def align(item: np.ndarray, window: np.ndarray, config: DecontaminationConfig) -> tuple[int, int]:
    """Smith-Waterman score of the best local alignment, and where in the window it ends."""
    up = np.zeros(len(window) + 1, np.int64)
    along = np.arange(len(window) + 1) * -config.gap
    best, end = 0, 0
    for word in item:
        here = np.zeros(len(window) + 1, np.int64)
        np.maximum(up[1:] + config.gap, up[:-1] + np.where(window == word, config.match, config.mismatch), out=here[1:])
        np.maximum(here, 0, out=here)
        up = np.maximum.accumulate(here + along) - along
        top = int(up.argmax())
        if up[top] > best:
            best, end = int(up[top]), top
    return best, end


def _word_counts(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, _, data, offsets in tx.lower_groups(batch.column("text")):
                h = tx.words(data, offsets).hash
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                counts += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
                total += len(h)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], total))], names=["word", "n"])

    return run


def prepare_items(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig) -> Iterator[Items]:
    """Portions of the benchmark with their seeds."""
    texts = benchmark.select(F.col("item_id"), F.col("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    portions = 1 + int((texts.agg(F.sum(F.length("text"))).first()[0] or 0) // config.portion)
    for k in range(portions):
        rows = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == k).orderBy("item_id", "text").collect()
        ids = [r.item_id for r in rows]
        words = tx.hash_words([r.text for r in rows])
        ids, words = [i for i, w in zip(ids, words) if len(w) >= config.n], [w for w in words if len(w) >= config.n]
        if not ids:
            continue
        vocabulary = np.unique(np.concatenate(words))
        counted = docs.select("text").mapInArrow(lean(_word_counts(vocabulary)), "word long, n long").groupBy("word").agg(F.sum("n")).collect()
        counts = np.ones(len(vocabulary))
        total = 1
        for word, n in counted:
            if word < 0:
                total = max(1, n)
            else:
                counts[word] = n
        share = counts / total
        seeds, item, place = [], [], []
        for i, w in enumerate(words):
            each = share[np.searchsorted(vocabulary, w)]
            g, _ = tx.ngrams(tx.Words(w, np.zeros(len(w), np.int64), w, w), config.n, 1)
            expected = 1e6 * np.prod([each[j : len(each) - config.n + 1 + j] for j in range(config.n)], axis=0)
            use = np.flatnonzero(expected <= config.rare)
            if len(use) < config.min_seeds:
                use = np.arange(len(g))
            seeds.append(g[use])
            item.append(np.full(len(use), i))
            place.append(use)
        seeds, item, place = np.concatenate(seeds), np.concatenate(item), np.concatenate(place)
        order = np.argsort(seeds, kind="stable")
        yield Items(ids, words, seeds[order], item[order], place[order])


def find(column: pa.Array, items: Items, config: DecontaminationConfig) -> list[tuple[int, int, float, int]]:
    """(row, item, score, words before the end of the match) of all matches."""
    out = []
    unique, first, count = np.unique(items.seeds, return_index=True, return_counts=True)
    for start, end, data, offsets in tx.lower_groups(column):
        w = tx.words(data, offsets)
        k = len(w.hash) - config.n + 1
        if k <= 0:
            continue
        g = np.zeros(k, np.uint64)
        for j in range(config.n):
            g += w.hash[j : j + k] * tx._GRAM[j]
        g = tx.mix(g)
        at = np.minimum(np.searchsorted(unique, g), len(unique) - 1)
        hit = np.flatnonzero((unique[at] == g) & (w.row[:k] == w.row[config.n - 1 :]))
        if not len(hit):
            continue
        reps = count[at[hit]]
        pos = np.repeat(hit, reps)
        which = np.repeat(first[at[hit]], reps) + np.arange(len(pos)) - np.repeat(np.cumsum(reps) - reps, reps)
        item, place, row = items.item[which], items.place[which], w.row[pos]
        length = np.array([len(x) for x in items.words])[item]
        low, high = np.searchsorted(w.row, row), np.searchsorted(w.row, row, side="right")
        pad = np.ceil(length * config.match * (1 - config.threshold) / -config.gap).astype(np.int64)
        left, right = np.maximum(low, pos - place - pad), np.minimum(high, pos - place + length + pad)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        order = np.lexsort((left, item, row))
        i = 0
        while i < len(order):  # overlapping windows of a row and an item become one
            o = order[i]
            a, b = left[o], right[o]
            i += 1
            while i < len(order) and row[order[i]] == row[o] and item[order[i]] == item[o] and left[order[i]] <= b:
                b = max(b, right[order[i]])
                i += 1
            words, window = items.words[item[o]], w.hash[a:b]
            least = config.threshold * config.match * len(words)
            if config.match * np.isin(words, window).sum() < least:  # no alignment can reach it
                continue
            score, stop = align(words, window, config)
            key = (int(row[o]) + start, int(item[o]))
            if score >= least and score / (config.match * len(words)) > best.get(key, (0.0, 0))[0]:
                best[key] = (score / (config.match * len(words)), int(a + stop - low[o]))
        out += [(r, i, s, e) for (r, i), (s, e) in sorted(best.items())]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """doc_id, item_id, score (0.5 to 1), end_word: one row for each document and item that match."""
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, end_word int"
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    parts = []
    for items in prepare_items(docs, benchmark, config):
        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = find(batch.column("text"), items, config)
                if found:
                    row, item, score, end = zip(*found)
                    ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[i] for i in item], id_type), pa.array(score, pa.float64()), pa.array(end, pa.int32())], names=["doc_id", "item_id", "score", "end_word"])

        parts.append(docs.select("doc_id", "text").mapInArrow(lean(run), schema))
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """The documents that match no item, with all their columns."""
    for items in prepare_items(docs, benchmark, config):
        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in find(batch.column("text"), items, config)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs

"""N-gram Jaccard self-join by token-combination prefixes, exact for every pair of texts.

A text's set holds its word n-grams; two texts match if the Jaccard similarity of their sets is at least ``threshold``.

1. A text's content key is a hash of its set, so copies are one content. The n-grams go to the executors by hash, packed
   in blocks of about 6 bytes each, and come back with a class of the number of texts that have them (8 classes for each
   doubling; copies in one block count once). Those of one text only can match nothing and stay away. Of an n-gram that many
   of a block's texts have one entry with their number is sent, so a common one costs its counter no more than a rare one.
2. In the order of class and hash a content's *prefix* is its rarest n-grams. ``tau`` of a content's n-grams may be missing
   from a match, so a prefix must keep a signature after any ``tau`` losses. An n-gram of a rare class is a signature
   alone. N-grams of a frequent class are spread over sub-classes, and two of one sub-class are a signature together;
   a sub-class of n covers n - 1 losses, and the prefix is extended until all that it covers exceeds ``tau``. The number
   of sub-classes depends on the size of the larger set, so each content is indexed for its own size (by doublings) and
   the larger ones that a match may have, one for a threshold of a half.
3. Contents with the same signature are candidates. Most matches also agree in one of a few min-hash labels (again one
   n-gram where it is rare, two or three where it is frequent): contents with equal labels are compared together, and
   signatures only yield the pairs that no label holds. A component of which many pairs are known links is compared whole, and
   so are all contents with a signature that many of a component have, so that the pairs of a large cluster are not listed.
   All candidates are verified by exact intersection of hashes.

What comes back grows with the documents, not with the pairs: of a label's contents only the links' numbers and a forest of
what they connect. Hashes stand for n-grams (40 bits in a comparison) and for whole sets (64 bits): two n-grams of a pair
are taken for one with a chance of 2**-40, and two different sets for copies with one of 2**-64.

Defined results: an empty or NULL text, or one without words, matches nothing and is a class of its own. A text of fewer
than n words has one n-gram, all its words. Rows with a NULL doc_id count as texts but are never reported. Repeated rows of
a doc_id are one document; rows that share a doc_id and differ in text are one each. Ids may be of any type that can be
compared; of several least ones (ties) there is only one. Very long texts are sets like others. Extra columns are ignored,
or kept by ``keep_one``. An empty table has no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import text as tx
from .tables import discard, lean, release, written


@dataclass(frozen=True)
class JoinConfig:
    n: int = 3
    threshold: float = 0.5
    #: An n-gram of more texts than this is of a frequent class.
    frequent: int = 4
    #: A min-hash label takes another n-gram while the last is in more texts than this.
    label_frequent: int = 256
    labels: int = 2
    #: Contents of a label that are compared in one task; of more, each two blocks are.
    label_group: int = 4096
    #: Pairs for each known link up to which all pairs of a component are compared at once; others meet by signatures.
    sparse: int = 64
    #: Contents of a component with the same signature from which on all contents with it are compared together.
    crowd: int = 32
    #: Bytes of input for a bucket of n-grams at most.
    bucket_bytes: int = 128 << 20
    #: Contents of a block from which on an n-gram's number alone goes to be counted.
    hot: int = 16
    #: N-grams and texts that a map task packs in a block.
    flush: int = 1_000_000
    flush_rows: int = 60_000
    #: Ids up to which documents to drop are broadcast (8 bytes each); beyond, they are joined by a shuffle.
    broadcast_ids: int = 4_000_000


_MASK40 = np.uint64((1 << 40) - 1)


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    return tx.mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 2 + 1))


def _pack40(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 40-bit numbers by their differences, all first bytes, then all second ones and so on; the upper bytes are
    mostly alike and compress."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(d[:, : 5 if d[:, 4].any() else 4].T).tobytes()


def _unpack_sorted(b: bytes, n: int) -> np.ndarray:
    d = np.zeros((n, 8), np.uint8)
    width = len(b) // max(n, 1)
    d[:, :width] = np.frombuffer(b, np.uint8).reshape(width, n).T
    return np.cumsum(d.reshape(-1).view("<u8"), dtype=np.uint64)


def _class(n: np.ndarray) -> np.ndarray:
    """The class of a number of texts."""
    return np.floor(8 * np.log2(n) + 1e-9).astype(np.uint8)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of rows: first and last row; the distinct n-grams, their rows in order; the content keys by row."""
    for a, b, data, offsets in tx.lower_groups(column):
        g, row = tx.ngrams(tx.words(data, offsets), n, b - a)
        order = np.argsort(row, kind="stable")
        g, row = g[order], row[order]
        edges = np.searchsorted(row, np.arange(b - a + 1))
        for i in np.flatnonzero(np.diff(edges) > 1):
            g[edges[i] : edges[i + 1]].sort()
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[first], row[first]
        total = np.concatenate(([np.uint64(0)], np.cumsum(tx.mix(g), dtype=np.uint64)))
        edges = np.searchsorted(row, np.arange(b - a + 1))
        key = tx.mix((total[edges[1:]] - total[edges[:-1]]) + np.diff(edges).astype(np.uint64)).view(np.int64)
        yield a, b, g, row, key


_BLOCK = "bucket int, block long, source int, q binary, i binary, kind binary, content binary, size binary, id binary, owner binary"
_BLOCK_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]
_BLOCK_TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7]


def _blocks(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), _BLOCK_TYPES)], names=_BLOCK_NAMES)


def _map_sets(config: JoinConfig, parts: int):
    """Packs the n-grams of a block of texts by bucket, with the number of their text in the block; one more row has the
    texts' content keys, sizes and ids. A block is named by its contents."""
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        g = np.concatenate([h[0] for h in held])
        text = np.concatenate([h[1] + at for h, at in zip(held, np.cumsum([0] + [len(h[2]) for h in held]))])
        keys, size, ids, known = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4, 5))
        content, first, owner = np.unique(keys, return_index=True, return_inverse=True)  # copies in the block are one
        lone = np.zeros(len(keys), bool)
        lone[first] = True
        keep = lone[text]
        g, own = g[keep], owner[text[keep]]
        name = int(tx.mix(np.array([tx.mix(content.view(np.uint64)).sum() + np.uint64(len(content))])).view(np.int64)[0])
        bucket = (g % np.uint64(parts)).astype(np.int64)
        q = (g >> np.uint64(24)) & _MASK40
        rows = [(name % parts, name, None, None, None, None, content.tobytes(), size[first].astype("<u4").tobytes(), pickle.dumps(ids[known]), owner[known].astype("<u2").tobytes())]
        order = np.lexsort((q, bucket))
        q, own, bucket = q[order], own[order].astype("<u2"), bucket[order]
        begin = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (bucket[1:] != bucket[:-1])))[: len(q)])
        n = np.diff(np.append(begin, len(q)))
        hot = np.repeat(n >= config.hot, n)
        edges = np.searchsorted(bucket, np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(edges)):
            at = slice(edges[k], edges[k + 1])
            few = ~hot[at]
            if few.any():
                rows.append((int(k), name, int(k), _pack_sorted(q[at][few]), own[at][few].tobytes(), *[None] * 5))
            if not few.all():  # only their number goes to be counted; who has them waits where the block is put together
                first = (begin >= edges[k]) & (begin < edges[k + 1]) & (n >= config.hot)
                some, sizes = _pack_sorted(q[begin[first]]), n[first].astype("<u4").tobytes()
                rows.append((int(k), name, int(k), some, None, sizes, *[None] * 4))
                rows.append((name % parts, name, int(k), None, own[at][~few].tobytes(), None, some, sizes, None, None))
        yield from _blocks(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = rows_held = 0
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.array(ids.is_valid())
            values = ids.fill_null(0).to_numpy().astype(np.int64) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist() + [None], object)[:-1]
            for a, b, g, row, key in _sets(batch.column("text"), config.n):
                for lo in range(a, b, config.flush_rows):
                    hi = min(b, lo + config.flush_rows)
                    r0, r1 = np.searchsorted(row, [lo - a, hi - a])
                    if held and (n_held + r1 - r0 > config.flush or rows_held + hi - lo > config.flush_rows):
                        yield from flush(held)
                        held, n_held, rows_held = [], 0, 0
                    held.append((g[r0:r1], row[r0:r1] - (lo - a), key[lo - a : hi - a], np.bincount(row[r0:r1] - (lo - a), minlength=hi - lo), values[lo:hi], known[lo:hi]))
                    n_held, rows_held = n_held + r1 - r0, rows_held + hi - lo
        if held:
            yield from flush(held)

    return run


def _sorted_with(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40-bit numbers in order, and where each was."""
    if len(q) < 1 << 24:
        both = np.sort((q << np.uint64(24)) | np.arange(len(q), dtype=np.uint64))
        return both >> np.uint64(24), (both & np.uint64((1 << 24) - 1)).astype(np.int64)
    order = np.argsort(q, kind="stable")
    return q[order], order


def _count(parts: int):
    """Counts the texts of each n-gram of a bucket; those of several go on to their blocks, with their class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, hot, seen = [], [], set()
        source = None
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            yield from _blocks([r for r in rows if r[3] is None])
            for r in rows:
                if r[3] is not None and (r[1], r[4] is None) not in seen:  # blocks of one name are the same
                    seen.add((r[1], r[4] is None))
                    source = r[2]
                    if r[4] is None:
                        n = np.frombuffer(r[5], "<u4")
                        hot.append((r[1], _unpack_sorted(r[3], len(n)), n))
                    else:
                        i = np.frombuffer(r[4], "<u2")
                        plain.append((r[1], _unpack_sorted(r[3], len(i)), i))
        if not plain and not hot:
            return
        names = [p[0] for p in plain + hot]
        block = np.repeat(np.arange(len(names), dtype=np.int32), [len(p[1]) for p in plain + hot])
        q, at = _sorted_with(np.concatenate([p[1] for p in plain + hot]))
        i = np.concatenate([p[2] for p in plain] or [np.zeros(0, "<u2")])
        edges = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1], [True])))
        n = np.diff(edges)
        if hot:  # an entry of several texts stands behind those of one
            place = np.flatnonzero(at >= len(i))
            more = np.concatenate([p[2] for p in hot])[at[place] - len(i)].astype(np.int64) - 1
            n = n + np.bincount(np.searchsorted(edges, place, side="right") - 1, more, len(n)).astype(np.int64)
        single = len(plain)
        del plain, hot
        kind = np.repeat(_class(n), np.diff(edges))
        several = np.repeat(n > 1, np.diff(edges))
        q, at, kind = q[several], at[several], kind[several]
        order = np.argsort(block[at], kind="stable")
        q, at, kind = q[order], at[order], kind[order]
        edges = np.searchsorted(block[at], np.arange(len(names) + 1))
        rows = []
        for k in np.flatnonzero(np.diff(edges)):
            x = slice(edges[k], edges[k + 1])
            rows.append((names[k] % parts, names[k], source, _pack_sorted(q[x]), i[at[x]].tobytes() if k < single else None, kind[x].tobytes(), *[None] * 4))
        yield from _blocks(rows)

    return run


def needed(size: int, threshold: float) -> int:
    """Of a set's n-grams, how many a match has at least."""
    return max(1, math.ceil(threshold * size - 1e-9))


def subclasses(level: int, threshold: float) -> int:
    """Sub-classes of the frequent n-grams for sets of which the larger has 2**level to 2**(level + 1) - 1; 0: none are
    frequent. With so few, a whole set always covers its losses."""
    return max(0, math.floor(threshold * 2 ** (level - 1) + 1e-9) - 1) if level > 0 else 0


def signatures(tokens: np.ndarray, kind: np.ndarray, size: int, config: JoinConfig) -> np.ndarray:
    """Signatures of a set from its shared n-grams, in the order of (class, n-gram)."""
    level = size.bit_length() - 1
    pairs = []
    rare = kind <= _class(np.array(config.frequent))
    for at in range(level, level + math.ceil(math.log2(1 / config.threshold) - 1e-9) + 1):
        # a match with a set of this level shares so many of the tokens at least
        need = len(tokens) - max(needed(size, config.threshold), needed(1 << at, config.threshold)) + 1
        if need <= 0:
            continue
        m = subclasses(at, config.threshold)
        if not m:
            pairs.append(_salted(tokens[: min(need, len(tokens))], 3))
            continue
        group = np.where(rare, -1, (_salted(tokens, 5) % np.uint64(m)).astype(np.int64))
        covers = np.ones(len(tokens), np.int64)
        _, first = np.unique(group[~rare], return_index=True)
        covers[np.flatnonzero(~rare)[first]] = 0
        end = int(np.searchsorted(np.cumsum(covers), need)) + 1
        t, r, c = tokens[:end], rare[:end], group[:end]
        pairs.append(_salted(t[r], 3))
        t, c = t[~r], c[~r]
        order = np.argsort(c, kind="stable")
        t, c = t[order], c[order]
        i = np.arange(len(t))
        for d in range(1, len(t)):
            i = i[i + d < len(t)]
            i = i[c[i] == c[i + d]]
            if not len(i):
                break
            pairs.append(tx.mix(_salted(t[i], 7) * np.uint64(3) + _salted(t[i + d], 11) + np.uint64(at)))
    return np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)


def labels(tokens: np.ndarray, kind: np.ndarray, config: JoinConfig) -> list[int]:
    out = []
    for k in range(config.labels):
        h = _salted(tokens, 101 + k)
        low = np.argpartition(h, min(2, len(h) - 1))[:3]
        low = low[np.argsort(h[low])]
        label = np.uint64(k)
        for j in low:
            label = _salted(np.array([label ^ h[j]]), 13)[0]
            if kind[j] <= _class(np.array(config.label_frequent)):
                break
        out.append(int(np.int64(label.view(np.int64))))
    return out


_CONTENT = "content long, size int, tokens binary, kinds binary, labels array<long>, doc_id "


def _gather(config: JoinConfig, id_type: pa.DataType):
    """Of each block: its documents with their contents, and the contents that may have a match with their shared n-grams."""
    def block(content: np.ndarray, size: np.ndarray, tokens: list[tuple]) -> Iterator[tuple]:
        token = tx.mix(np.concatenate([q | (np.uint64(source) << np.uint64(40)) for source, q, _, _ in tokens])) & _MASK40
        kind, own = np.concatenate([t[3] for t in tokens]), np.concatenate([t[2] for t in tokens])
        shared = np.bincount(own, minlength=len(content))
        keep = (shared >= np.maximum(1, np.ceil(config.threshold * size - 1e-9)))[own]
        token, kind, own = token[keep], kind[keep], own[keep]
        order = np.lexsort((token, kind, own))
        token, kind, own = token[order], kind[order], own[order]
        edges = np.searchsorted(own, np.arange(len(content) + 1))
        for i in np.flatnonzero(np.diff(edges)):
            t, c = token[edges[i] : edges[i + 1]], kind[edges[i] : edges[i + 1]]
            yield int(content[i]), int(size[i]), _pack40(t), c.tobytes(), labels(t, c, config), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        tokens: dict[int, list[tuple]] = {}
        waiting: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, name, source, q, i, kind, content, size, ids, owner in zip(*[c.to_pylist() for c in batch.columns]):
                if q is None and source is not None:
                    waiting[name, source] = np.frombuffer(i, "<u2").astype(np.int32), np.frombuffer(size, "<u4")
                elif q is None:
                    keys = np.frombuffer(content, np.int64)
                    texts[name] = keys, np.frombuffer(size, "<u4").astype(np.int64)
                    owner = np.frombuffer(owner, "<u2")
                    some = texts[name][1][owner] > 0
                    yield _content_batch([(k if any_ else None, None, None, None, None, d) for k, any_, d in zip(keys[owner].tolist(), some.tolist(), pickle.loads(ids).tolist())], id_type)
                else:
                    kind = np.frombuffer(kind, np.uint8)
                    tokens.setdefault(name, []).append((source, _unpack_sorted(q, len(kind)), None if i is None else np.frombuffer(i, "<u2").astype(np.int32), kind))
        for name in list(tokens):
            rows = []
            parts = []
            for source, q, i, kind in tokens.pop(name):
                if i is None:
                    i, n = waiting[name, source]
                    q, kind = np.repeat(q, n), np.repeat(kind, n)
                parts.append((source, q, i, kind))
            for row in block(*texts[name], parts):
                rows.append(row)
                if len(rows) == 500:
                    yield _content_batch(rows, id_type)
                    rows = []
            yield _content_batch(rows, id_type)

    return run


def _content_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), id_type]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names=[x.split()[0] for x in _CONTENT.split(", ")])


def _joined(start: np.ndarray, end: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all j from start[i] to end[i] - 1, in parts of about ``most`` pairs."""
    n = end - start
    total = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        if len(i):
            yield i, np.arange(len(i)) - np.repeat(total[lo:hi] - n[lo:hi] - (total[lo - 1] if lo else 0), n[lo:hi]) + start[i]
        lo = hi


def overlaps(sets: list[np.ndarray], split: int = 0, block: int = 1024, columns: int = 8192, thin: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, common n-grams) for i < j with any, by products of incidence matrices; with a split only i < split <= j.
    N-grams of less than one in ``thin`` sets are joined one by one, as their columns would be all but empty."""
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(token, return_inverse=True, return_counts=True)
    several = count > 1
    dense = several & (count * thin > len(sets))
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    use = (several & ~dense)[column]
    thin_owner, thin_column = owner[use], column[use]
    use = dense[column]
    owner, column = owner[use], (np.cumsum(dense) - 1)[column[use]]
    width = int(dense.sum())
    columns = max(1, min(columns, width))
    end = split or len(sets)
    for lo in range(0, end, block):
        for hi in range(split or lo, len(sets), block):
            p, q = min(block, end - lo), min(block, len(sets) - hi)
            total = np.zeros((p, q), np.float32)
            for c in range(0, width, columns):
                x, y = np.searchsorted(column, [c, c + columns])
                o, k = owner[x:y], column[x:y] - c
                left, right = np.zeros((p, columns), np.float32), np.zeros((q, columns), np.float32)
                m = (o >= lo) & (o < lo + p)
                left[o[m] - lo, k[m]] = 1
                m = (o >= hi) & (o < hi + q)
                right[o[m] - hi, k[m]] = 1
                total += left @ right.T
            m, k = (thin_owner >= lo) & (thin_owner < lo + p), (thin_owner >= hi) & (thin_owner < hi + q)
            o, k, c = thin_owner[m] - lo, thin_owner[k] - hi, thin_column[k]
            for i, j in _joined(np.searchsorted(c, thin_column[m], side="left"), np.searchsorted(c, thin_column[m], side="right")):
                total += np.bincount(o[i] * q + k[j], minlength=p * q).reshape(p, q)
            i, j = np.nonzero(total)
            keep = i + lo < j + hi
            i, j = i[keep], j[keep]
            yield i + lo, j + hi, total[i, j].astype(np.int64)


def _matches(common: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    return common >= threshold * (sizes - common) - 1e-9


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number of the connected component of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


_EDGE = "node long, root long, links long"


def _edges(node: np.ndarray, root: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(links.astype(np.int64))], names=["node", "root", "links"])


def _group_edges(config: JoinConfig, at: int, content: np.ndarray, size: np.ndarray, marks: np.ndarray, part: np.ndarray, tokens: list[bytes], pairs: bool) -> Iterator[pa.RecordBatch]:
    """Of the contents of a label (the label's number is ``at``; two blocks of them, if ``part`` has two values): those with
    a match, the least that is connected with each, and the number of matches that no earlier label has; or these matches."""
    order = np.lexsort((content, part))
    order = order[np.concatenate(([True], content[order][1:] != content[order][:-1]))]  # the same content may come from several blocks
    content, size, marks, part = content[order], size[order], marks[order], part[order]
    if len(order) < 2:
        return
    split = int(np.searchsorted(part, part[-1]))
    sets = [np.sort(_unpack40(tokens[int(k)])) for k in order]
    counted = [(np.array([0]), np.array([1]), np.array([len(np.intersect1d(*sets, assume_unique=True))]))] if len(sets) == 2 else overlaps(sets, split)
    links, left, right = np.zeros(len(sets), np.int64), [], []
    root = np.arange(len(sets))
    for i, j, common in counted:
        ok = _matches(common, size[i] + size[j], config.threshold)
        if at:
            ok &= ~(marks[i, :at] == marks[j, :at]).any(1)
        i, j = i[ok], j[ok]
        if pairs:
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(content[i], content[j])), pa.array(np.maximum(content[i], content[j]))], names=["a", "b"])
            continue
        links += np.bincount(i, minlength=len(sets)) + np.bincount(j, minlength=len(sets))
        apart = root[i] != root[j]
        left.append(i[apart])
        right.append(j[apart])
        if sum(map(len, left)) > 4 * len(sets):  # keep a forest
            root = _roots(len(sets), np.concatenate(left), np.concatenate(right))
            left, right = [np.arange(len(sets))], [root]
    root = _roots(len(sets), np.concatenate(left), np.concatenate(right)) if left else root
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, root, content)
    some = links > 0
    if some.any():
        yield _edges(content[some], least[root[some]], links[some])


def _by_label(config: JoinConfig, pairs: bool):
    """Streams the rows of a partition, which are sorted by group; one group at a time is in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def group() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            crossing = table.column("low")[0].as_py() != table.column("high")[0].as_py()
            if len(table.column("part").unique()) == 1 + crossing:
                marks = np.array(table.column("labels").to_pylist(), np.int64).reshape(table.num_rows, -1)
                yield from _group_edges(config, table.column("at")[0].as_py(), table.column("content").to_numpy(), table.column("size").to_numpy().astype(np.int64), marks, table.column("part").to_numpy(), table.column("tokens").to_pylist(), pairs)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("label", "low", "high")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges[:-1], edges[1:]):
                key = tuple(keys[:, x].tolist())
                if held and key != last:
                    yield from group()
                last = key
                held.append(batch.slice(x, y - x))
        if held:
            yield from group()

    return run


def _near(contents: DataFrame, config: JoinConfig, parts: int) -> DataFrame:
    """Edges of all contents that have a match with an equal label. A label of more than ``label_group`` contents is split:
    its contents go to blocks by their hash, and each two blocks are a group of their own."""
    return _compared(contents.select(F.posexplode("labels").alias("at", "label"), "content", "size", "tokens", "labels"), config, parts)


def _compared(each: DataFrame, config: JoinConfig, parts: int, pairs: bool = False) -> DataFrame:
    """Edges of all contents that have a match with an equal ``label`` and agree in none of the first ``at`` labels; or
    (a, b) of these matches, which several labels may have."""
    hot = each.groupBy("label").count().filter(F.col("count") > config.label_group).select(F.col("label").alias("hot"), F.ceil(F.col("count") / config.label_group).cast("int").alias("blocks"))
    each = each.join(hot, each["label"] == hot["hot"], "left").withColumn("part", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    each = each.withColumn("other", F.explode(others)).withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    each = each.select("label", "low", "high", "at", "content", "size", "tokens", "labels", "part")
    return each.repartition(parts, "label", "low", "high").sortWithinPartitions("label", "low", "high").mapInArrow(lean(_by_label(config, pairs)), "a long, b long" if pairs else _EDGE)


_SIGNED = "bucket int, q binary, i binary, content binary, size binary, marks binary"


def _map_signatures(config: JoinConfig, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            sets = [signatures(_unpack40(t), np.frombuffer(k, np.uint8), int(n), config) for t, k, n in zip(batch.column("tokens").to_pylist(), batch.column("kinds").to_pylist(), size)]
            if not sets:
                continue
            owner, s = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
            content, marks = batch.column("content").to_numpy(), np.array(batch.column("labels").to_pylist(), np.int64)
            if not len(s):
                continue
            bucket, q = (s % np.uint64(parts)).astype(np.int64), (s >> np.uint64(24)) & _MASK40
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(parts + 1))
            rows = []
            for k in np.flatnonzero(np.diff(edges)):
                at = order[edges[k] : edges[k + 1]]
                used, local = np.unique(owner[at], return_inverse=True)
                rows.append((int(k), _pack40(q[at]), local.astype("<u4").tobytes(), content[used].tobytes(), size[used].astype("<u4").tobytes(), marks[used].tobytes()))
            for at in range(0, len(rows), 64):
                c = list(zip(*rows[at : at + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *[pa.array(x, pa.binary()) for x in c[1:]]], names=[x.split()[0] for x in _SIGNED.split(", ")])

    return run


def _candidates(a: np.ndarray, b: np.ndarray, crowd: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowd))], names=["a", "b", "crowd"])


def batches_of(both: np.ndarray, content: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of numbers of contents as pairs of contents."""
    for lo in range(0, len(both), 100_000):
        a, b = content[(both[lo : lo + 100_000] >> np.uint64(32)).astype(np.int64)], content[(both[lo : lo + 100_000] & np.uint64(2**32 - 1)).astype(np.int64)]
        yield _candidates(np.minimum(a, b), np.maximum(a, b), False)


def _by_signature(config: JoinConfig):
    """Pairs with a common signature that agree in no mark (labels, and last the group whose pairs are known) and whose sizes allow
    a match. Where a signature has ``crowd`` contents of one group, its pairs are not listed: it yields (group, content) of all
    its contents, which are compared together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, owners, contents, sizes, marks, at = [], [], [], [], [], 0
        for batch in batches:
            for _, q, i, content, size, mark in zip(*[c.to_pylist() for c in batch.columns]):
                qs.append(_unpack40(q))
                owners.append(np.frombuffer(i, "<u4").astype(np.int64) + at)
                contents.append(np.frombuffer(content, np.int64))
                sizes.append(np.frombuffer(size, "<u4").astype(np.int64))
                marks.append(np.frombuffer(mark, np.int64).reshape(len(contents[-1]), -1))
                at += len(contents[-1])
        if not sum(map(len, qs)):
            return
        content, first, number = np.unique(np.concatenate(contents), return_index=True, return_inverse=True)
        size, mark = np.concatenate(sizes)[first], np.concatenate(marks)[first]
        q, at = _sorted_with(np.concatenate(qs))
        own = number[np.concatenate(owners)][at]
        edges = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        apart = [np.minimum.reduceat(m, edges) != np.maximum.reduceat(m, edges) for m in mark[own].T]  # else all agree
        keep = np.repeat(np.logical_and.reduce(apart), np.diff(np.append(edges, len(q))))
        q, own = q[keep], own[keep]
        if not len(q):
            return
        group = mark[own, -1]
        order = np.lexsort((group, q))
        q, own, group = q[order], own[order], group[order]
        new = q[1:] != q[:-1]
        last = np.append(np.flatnonzero(new) + 1, len(q))
        run = np.cumsum(np.concatenate(([0], new)))[: len(q)]
        new |= group[1:] != group[:-1]
        part = np.cumsum(np.concatenate(([0], new)))[: len(q)]
        after = np.append(np.flatnonzero(new) + 1, len(q))[part]
        n = np.bincount(part)[part]  # contents of the same group with the same signature
        begin = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))[: len(q)]
        most = np.maximum.reduceat(n, begin)
        crowded = (most >= config.crowd)[run]
        if crowded.any():
            leader = np.minimum.reduceat(np.where(n == most[run], group, np.iinfo(np.int64).max), begin)[run]
            led = np.unique(np.stack([leader[crowded], own[crowded]]), axis=1)
            for lo in range(0, led.shape[1], 100_000):
                yield _candidates(led[0, lo : lo + 100_000], content[led[1, lo : lo + 100_000]], True)
            after = np.where(crowded, last[run], after)
        found, held = [], 0
        for i, j in _joined(after, last[run]):  # only pairs of different groups
            a, b = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
            ok = np.minimum(size[a], size[b]) >= config.threshold * np.maximum(size[a], size[b]) - 1e-9
            a, b = a[ok], b[ok]
            ok = ~(mark[a] == mark[b]).any(1)
            found.append(np.unique((a[ok].astype(np.uint64) << np.uint64(32)) | b[ok].astype(np.uint64)))
            held += len(found[-1])
            if held > 4_000_000:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
            if held > 2_000_000 and len(found) == 1:
                yield from batches_of(found[0], content)
                found, held = [], 0
        if found:
            yield from batches_of(np.unique(np.concatenate(found)), content)

    return run


def _verify(config: JoinConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            common = np.array([len(np.intersect1d(_unpack40(s), _unpack40(t), assume_unique=True)) for s, t in zip(x, y)], np.int64)
            ok = _matches(common, batch.column("sizes").to_numpy().astype(np.int64), config.threshold)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def buckets(docs: DataFrame, config: JoinConfig) -> int:
    """The number of buckets of n-grams: that of the session's shuffle partitions, or more for a large input, as each is held
    in one task's memory."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # the plan doesn't know
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // config.bucket_bytes))


def _shared(docs: DataFrame, config: JoinConfig, parts: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    sets = docs.select("doc_id", "text").mapInArrow(lean(_map_sets(config, parts)), _BLOCK)
    counted = sets.repartitionById(parts, F.col("bucket")).mapInArrow(lean(_count(parts)), _BLOCK)
    gathered = counted.repartitionById(parts, F.col("bucket")).mapInArrow(lean(_gather(config, to_arrow_type(kind))), _CONTENT + kind.simpleString())
    return written(gathered, "ngram-contents")


def _far(contents: DataFrame, config: JoinConfig, parts: int) -> DataFrame:
    """(a, b) of the matches that agree in none of ``labels``."""
    few = max(1, parts // 4)  # a bucket repeats what it must know of a content, and pairs that other buckets have
    found = contents.mapInArrow(lean(_map_signatures(config, few)), _SIGNED).repartitionById(few, F.col("bucket")).mapInArrow(lean(_by_signature(config)), "a long, b long, crowd boolean")
    found = written(found, "candidates")
    rest = found.filter("NOT crowd").select("a", "b").distinct()
    one = contents.select("content", "size", "tokens", "labels").dropDuplicates(["content"])
    left, right = one.select(F.col("content").alias("a"), F.col("size").alias("sa"), F.col("tokens").alias("x")), one.select(F.col("content").alias("b"), F.col("size").alias("sb"), F.col("tokens").alias("y"))
    verified = rest.join(left, "a").join(right, "b").select("a", "b", (F.col("sa") + F.col("sb")).alias("sizes"), "x", "y").mapInArrow(lean(_verify(config)), "a long, b long")
    crowds = found.filter("crowd").select(F.col("a").alias("label"), F.col("b").alias("content")).distinct().join(one, "content")
    return verified.unionByName(_compared(crowds.select("label", F.size("labels").alias("at"), "content", "size", "tokens", "labels"), config, parts, pairs=True)).distinct()


def _dense(near: DataFrame, known: DataFrame, config: JoinConfig) -> DataFrame:
    """(node, root, open) of the components in which at least one of ``sparse`` pairs is a known link. Comparing all pairs of
    such a component costs in proportion to its links, however many texts share a signature; it is open if any is unknown."""
    linked = known.join(near.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    each = linked.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("links").alias("ends")).withColumn("most", F.col("n") * (F.col("n") - 1))
    dense = each.filter(F.col("ends") * config.sparse >= F.col("most")).select("root", (F.col("ends") < F.col("most")).alias("open"))
    return written(known.join(dense, "root").select("node", "root", "open"), "dense")


def similar_texts(docs: DataFrame, config: JoinConfig = JoinConfig(), links: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, content) of all documents with an id, the content being NULL for those without words; and of each content
    with a match: (content, root, links), the least content connected with it and the number of contents it matches. Without
    ``links`` these are not counted (0), and pairs that are known to be connected are not verified again."""
    spark = docs.sparkSession
    parts = buckets(docs, config)
    table = _shared(docs, config, parts)
    release(spark)
    members, contents = table.filter("doc_id IS NOT NULL").select("doc_id", "content").distinct(), table.filter("tokens IS NOT NULL").drop("doc_id")
    near = written(_near(contents, config, parts), "near-edges")
    edges = near.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    known = components(edges)
    if links:
        known = _dense(near, known, config)
    marked = contents.join(known.withColumnRenamed("node", "content"), "content", "left")
    if links:
        rest = marked.filter("open").select(F.col("root").alias("label"), F.lit(config.labels).alias("at"), *["content", "size", "tokens", "labels"])
        near = near.unionByName(written(_compared(rest, config, parts), "group-edges"))
    marked = marked.withColumn("labels", F.concat("labels" if links else F.array().cast("array<long>"), F.array(F.coalesce("root", "content")))).select(*contents.columns)
    far = written(_far(marked, config, parts), "far-edges")
    roots = components(edges.unionByName(far))
    if not links:
        return members, roots.select(F.col("node").alias("content"), "root", F.lit(0).cast("long").alias("links"))
    ends = far.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("links"))
    number = near.select("node", "links").unionByName(ends).groupBy("node").agg(F.sum("links").alias("links"))
    return members, roots.join(number, "node").select(F.col("node").alias("content"), "root", "links")


def jaccard_classes(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """doc_id, class_id, n_copies, n_links: one row for each document with an id. Documents of one n-gram set are copies, of
    which there are ``n_copies`` with this one; ``n_links`` is the number of other sets that match; a class is what links
    and copies connect, and its id the least doc_id in it."""
    members, similar = similar_texts(docs, config)
    texts = members.filter("content IS NOT NULL").groupBy("content").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    texts = texts.join(similar, "content", "left").select("content", "least", "n_copies", F.coalesce("root", "content").alias("root"), F.coalesce("links", F.lit(0)).alias("n_links"))
    classes = texts.groupBy("root").agg(F.min("least").alias("class_id"))
    known = texts.join(classes, "root").select("content", "class_id", "n_copies", "n_links")
    return members.join(known, "content", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node of the connected component of each node in a pair (a, b). Each round takes the least
    root among the neighbours, then the root's root; groups of near copies are settled after a few."""
    edges = written(pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    roots = written(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "roots")
    while True:
        seen = edges.join(roots.withColumnsRenamed({"node": "other"}), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = roots.join(seen, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = written(step.join(jump, "next", "left").select("node", F.col("root").alias("old"), F.least("next", F.coalesce("far", "next")).alias("root")), "roots")
        discard(roots)
        roots = new.select("node", "root")
        if new.filter("old <> root").isEmpty():
            discard(edges)
            return roots


def groups(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """doc_id, keep: the least doc_id of each connected group of matching documents, for every document in a group of
    two or more."""
    members, similar = similar_texts(docs, config, links=False)
    rooted = members.filter("content IS NOT NULL").join(similar, "content", "left").select("doc_id", F.coalesce("root", "content").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rooted.join(least, "root").select("doc_id", "keep")


def drop_ids(docs: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (doc_id). Up to ``limit`` ids go to every executor and the
    texts stay in place; more are joined by a shuffle."""
    name = "_drop"
    while name in docs.columns:
        name += "_"
    ids = ids.select(F.col("doc_id").alias(name)).distinct()
    hit = docs["doc_id"] == ids[name]
    few = ids.limit(limit + 1).count() <= limit
    return docs.join(F.broadcast(ids) if few else ids, hit, "left_anti")


def keep_one(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """One document of each group stays, that of the least doc_id, with all its columns; so does every document that is
    in no group or has no doc_id."""
    dropped = written(groups(docs, config).filter("doc_id <> keep").select("doc_id"), "near-copies")
    return drop_ids(docs, dropped, config.broadcast_ids)

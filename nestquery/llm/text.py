"""Vectorised words and word n-grams of Arrow string columns.

A word is a maximal run of letters, marks, numbers (of Unicode) and ``_`` in the lower-cased text; in scripts that put no
spaces between words each character is a word. Words and n-grams are 64-bit hashes: a polynomial over random byte values, then mixed. All functions are deterministic, so a
task that is run again gives the same hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text handled at once. Work arrays take about 40 bytes for each byte of a block.
BLOCK = 1 << 18
#: Bytes of text of the rows that are handled together; a longer text is alone.
ROWS_BYTES = 4 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Scripts without spaces between words.
SOLID = "".join(rf"\p{{{s}}}" for s in ("Han", "Hiragana", "Katakana", "Bopomofo", "Thai", "Lao", "Khmer", "Myanmar"))
#: Bytes of words; of non-ASCII characters ``_kinds`` tells.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95]] = True
_WORD[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, modulo 2**64; the sizes are powers of two so that few tables are made."""
    size = max(BLOCK * 2, 1 << max(1, n - 1).bit_length())
    if size not in _POWERS:
        inverse = pow(_P, -1, 1 << 64)
        both = []
        for base in (_P, inverse):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=np.uint64))
        _POWERS[size] = (both[0], both[1])
        for k in [k for k in _POWERS if k > BLOCK * 4 and k != size]:
            del _POWERS[k]
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; NULL counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def row_groups(offsets: np.ndarray, limit: int = ROWS_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about ``limit`` bytes in all."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 1 in words, 2 a word by itself, 0 neither."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, r"[\p{L}\p{M}\p{N}]+"), (2, f"[{SOLID}]+")):
        for run in regex.finditer(pattern, every):
            out[run.start() : run.end()] = kind
    return out


def _marks(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes that begin and end between characters: which are in words, and where (len(b) + 1 places) words are cut."""
    m, cut = _WORD[b], np.zeros(len(b) + 1, bool)
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        padded = np.concatenate((b, np.zeros(3, np.uint8)))
        first, c1, c2, c3 = padded[lead].astype(np.int32), *(padded[lead + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        kind = _kinds()[np.choose(size - 2, [(first & 0x1F) << 6 | c1, (first & 0xF) << 12 | c1 << 6 | c2, (first & 7) << 18 | c1 << 12 | c2 << 6 | c3])]
        none, single = kind == 0, kind == 2
        for k in range(4):
            m[lead[none & (size > k)] + k] = False
        cut[lead[single]] = True
        cut[lead[single] + size[single]] = True
    return m, cut


class Words:
    """Words of some rows: hash, row number, and byte range in the buffer, in the order of the text."""

    def __init__(self, hash: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.hash, self.row, self.start, self.end = hash, row, start, end


def _character(data: np.ndarray, at: int, end: int) -> int:
    """The first place from ``at`` on where a character begins."""
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, end)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of lower-cased rows. Row numbers count from 0 at ``offsets[0]``."""
    low, high = int(offsets[0]), int(offsets[-1])
    starts, ends, hashes = [], [], []
    at = low
    cut = np.unique(offsets)
    while at < high:
        to = _character(data, at + BLOCK, high)
        while to < high:  # a block ends between words
            more = _character(data, to + BLOCK // 16, high)
            m, edge = _marks(data[to:more])
            gap = np.flatnonzero(~m | edge[:-1])
            if len(gap):
                to += int(gap[0])
                break
            to = more
        b = data[at:to]
        m, edge = _marks(b)
        edge[[0, -1]] = True
        edge[cut[np.searchsorted(cut, at) : np.searchsorted(cut, to, side="right")] - at] = True
        before = np.concatenate(([False], m))
        after = np.concatenate((m, [False]))
        s = np.flatnonzero(after & (~before | edge))
        e = np.flatnonzero(before & (~after | edge))
        power, inverse = _powers(len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * power[: len(b)], dtype=np.uint64, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverse[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), np.searchsorted(offsets, start, side="right") - 1, start, np.concatenate(ends))


def digest(text: str) -> str:
    """A name of a text, the same for copies."""
    return hashlib.sha256(text.encode()).hexdigest()


def hash_words(texts: list[str]) -> list[np.ndarray]:
    """The word hashes of each text."""
    data, offsets = string_buffers(pc.utf8_lower(pa.array(texts, pa.string())))
    w = words(data, offsets)
    edges = np.searchsorted(w.row, np.arange(len(texts) + 1))
    return [w.hash[a:b] for a, b in zip(edges[:-1], edges[1:])]


def ngrams(w: Words, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the n-grams; a row of fewer words than n, but any, has one of all its words."""
    count = np.bincount(w.row, minlength=rows)
    out, at = [], []
    k = len(w.hash) - n + 1
    if k > 0:
        g = np.zeros(k, np.uint64)
        for j in range(n):
            g += w.hash[j : j + k] * _GRAM[j]
        same = w.row[:k] == w.row[n - 1 :]
        out.append(mix(g[same]))
        at.append(w.row[:k][same])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(w.row, short)
        g = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = count[short] > j
            g[has] += w.hash[first[has] + j] * _GRAM[j]
        out.append(mix(g + count[short].astype(np.uint64) * _GRAM[63]))
        at.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(at)


def lower_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of lower-cased groups of rows."""
    _, raw = string_buffers(column)
    for a, b in row_groups(raw):
        data, offsets = string_buffers(pc.utf8_lower(column.slice(a, b - a)))
        yield a, b, data, offsets

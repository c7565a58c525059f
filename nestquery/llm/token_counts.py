"""Token counts by a tokenizer compiled to a finite-state transducer.

The byte-level BPE merges become a deterministic transducer over the bytes of a pre-token; a transition gives the next
state and the change in the number of emitted tokens (merges can undo tokens, so it may be negative or 0). It rests on
this rule: the last token of a prefix is the longest token that ends there and is compatible with the last token before
it. So all that a state must know of what was read is where tokens may begin that reach further: for each such place the
node of the vocabulary's trie that leads on from it, the last token before it, and how many tokens fewer there were.
Equal states are one, whatever led to them. Transitions are compiled when first taken, into a flat hash table, and all
new words of a batch walk through it together, a byte a step. Words that a worker met before come from a bounded memory.

A document of more than ``giant`` characters is cut into chunks anywhere. Where pre-tokens begin is told from a few
characters on either side. The state at a cut inside a pre-token is the token across it (or ending at it) and how many of
its bytes are still to come. A chunk is a map from each state that its start may have to the states its end may then
have, with the tokens that begin between; walks from different states that meet go on as one. Maps compose associatively,
in a parallel scan over the chunks and over groups of them. A text without any space is counted in parallel like another.

Defined results: NULL text has a NULL count, an empty one 0; an empty table has no rows. Repeated rows are counted each;
NULL ids are carried through. Extra columns are ignored. Special tokens' names in a text are ordinary text.
"""

from __future__ import annotations

import base64
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import lean, written

_WS = r"\t-\r \x85\xa0  -     　"
#: The public pre-token pattern of byte-level BPE vocabularies, with white space as Unicode has it.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


@dataclass(frozen=True)
class TokenCountConfig:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    giant: int = 65_536
    chunk: int = 16_384
    #: Pieces (and pairs of tokens), and transitions of the transducer, that a worker keeps.
    pieces: int = 600_000
    states: int = 1_500_000
    #: Bytes of a pre-token up to which it walks together with others; a longer one walks alone, to the same count.
    depth: int = 64


MARGIN = 128
#: A place where a token may begin that reaches further: trie node of what was read since, last token before, tokens fewer.
Open = tuple[int, int, int]
_HASH = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """Counts of tokens. State 0 is the start of a pre-token; a state is the tuple of its open places, the earliest first.
    If a token can end where the state is, the last place is there, with the trie's root."""

    def __init__(self, config: TokenCountConfig) -> None:
        self.config = config
        with open(config.vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.longest = max(map(len, self.ranks))
        #: Characters of a chunk's neighbours that its map depends on; no token has more bytes.
        self.margin = max(MARGIN, self.longest)
        self.split = regex.compile(config.pattern).findall
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        #: The vocabulary's trie: (node << 8 | byte) to node; a node's token or -1; whether it leads on.
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for word, rank in self.ranks.items():
            node = 0
            for byte in word:
                self.inner[node] = True
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            self.token[node] = rank
        self.splits: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        #: Counts of pieces, each standing for itself with a space before it, and of pre-tokens.
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Begins with no state but the start."""
        self.states: list[tuple[Open, ...]] = [((0, -1, 0),)]
        self.number: dict[tuple[Open, ...], int] = {self.states[0]: 0}
        self.made = 0
        self._room(1 << 16)

    def tidy(self) -> None:
        """Keeps the memory within its bounds; between batches, as it may renumber states."""
        if self.made > self.config.states:
            self.forget()
        for known in (self.pieces, self.words):
            if len(known) > self.config.pieces:
                known.clear()

    # The table of transitions: (state << 8 | byte) + 1 in a slot, 0 where it is free.

    def _room(self, size: int) -> None:
        self.bits = size.bit_length() - 1
        self.slot, self.to, self.change = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.int16)

    def _put(self, key: int, to: int, change: int) -> None:
        if self.made * 2 >= len(self.slot):
            old = self.slot, self.to, self.change
            self._room(len(self.slot) * 4)
            self.made = 0
            used = np.flatnonzero(old[0])
            for k, t, c in zip(old[0][used].tolist(), old[1][used].tolist(), old[2][used].tolist()):
                self._put(k - 1, t, c)
        at = self._find(key)
        self.slot[at], self.to[at], self.change[at] = key + 1, to, change
        self.made += 1

    def _find(self, key: int) -> int:
        """The slot of a transition, or the free one where it would be."""
        at = ((key + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        slot = self.slot
        while (k := int(slot[at])) and k != key + 1:
            at = at + 1 & len(slot) - 1
        return at

    def step(self, state: int, byte: int) -> tuple[int, int]:
        at = self._find(state << 8 | byte)
        if not self.slot[at]:
            return self.compile(state, byte)
        return int(self.to[at]), int(self.change[at])

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """Compiles a transition."""
        found, still = None, []
        for node, last, fewer in self.states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            token = self.token[to]
            if found is None and token >= 0 and (last < 0 or self.fits(last, token)):
                found = token, fewer + 1
            if self.inner[to]:
                still.append((to, last, fewer))
        change = 0
        if found:
            token, change = found
            still = [(node, last, fewer - change) for node, last, fewer in still]
            still.append((0, token, 0))
        key = tuple(still)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        self._put(state << 8 | byte, to, change)
        return to, change

    def merge(self, s: bytes, below: int = 1 << 60) -> list[bytes]:
        """BPE by the merges of ranks below a number."""
        parts = [s[i : i + 1] for i in range(len(s))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge is this one; itself twice for a byte."""
        if token not in self.splits:
            parts = self.merge(self.tokens[token], token)
            self.splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
        return self.splits[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of two tokens' bytes give back the two: undoing them step by step, the latest first, no merge
        across the border may come before those that were undone."""
        limit = 1 << 60
        ranks, tokens = self.ranks, self.tokens
        while True:
            if ranks.get(tokens[a] + tokens[b], limit) < limit:
                return False
            if a > b:
                limit, (_, a) = a, self.halves(a)
                if a == limit:
                    limit, (b, _) = b + 1, self.halves(b)
                    if b + 1 == limit:
                        return True
            else:
                limit, (b, _) = b + 1, self.halves(b)
                if b + 1 == limit:
                    limit, (_, a) = a, self.halves(a)
                    if a == limit:
                        return True

    def fits(self, a: int, b: int) -> bool:
        """``compatible`` with a bounded memory."""
        pair = a << 32 | b
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= self.config.pieces:
                self.pairs.clear()
            known = self.pairs[pair] = self.compatible(a, b)
        return known

    def walk(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of tokens of words in a buffer, all walking together."""
        order = np.argsort(-size, kind="stable")
        start, sizes = start[order], -size[order]
        state, count = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
        for k in range(int(-sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(sizes, -k))
            key = (state[:live] << np.uint64(8) | data[start[:live] + k]) + np.uint64(1)
            at = self.slots(key)
            state[:live] = self.to[at].astype(np.uint64)
            count[:live] += self.change[at]
        out = np.empty(len(count), np.int64)
        out[order] = count
        return out

    def slots(self, key: np.ndarray) -> np.ndarray:
        """The slots of transitions; those that are missing are compiled."""
        at = self._slots(key)
        new = np.flatnonzero(self.slot[at] == 0)
        if len(new):
            for x in np.unique(key[new]).tolist():
                self.compile(x - 1 >> 8, x - 1 & 255)
            at = self._slots(key)
        return at

    def _slots(self, key: np.ndarray) -> np.ndarray:
        at = (key * _HASH >> np.uint64(64 - self.bits)).astype(np.int64)
        off = np.flatnonzero((found := self.slot[at]) != key)
        off = off[found[off] != 0]
        while len(off):
            at[off] = at[off] + 1 & len(self.slot) - 1
            found = self.slot[at[off]]
            off = off[(found != key[off]) & (found != 0)]
        return at

    def lone(self, word: bytes) -> int:
        """The number of tokens of a long pre-token."""
        state = count = 0
        for byte in word:
            state, change = self.step(state, byte)
            count += change
        return count

    def count_words(self, words: list[str]) -> np.ndarray:
        """The numbers of tokens of pre-tokens."""
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        start = np.cumsum(size) - size
        out = np.zeros(len(raw), np.int64)
        short = size <= self.config.depth
        out[short] = self.walk(np.frombuffer(b"".join(raw), np.uint8), start[short], size[short])
        for i in np.flatnonzero(~short):
            out[i] = self.lone(raw[i])
        return out

    def learn(self, pieces: list[str]) -> None:
        """Counts new pieces into the memory."""
        for at in range(0, len(pieces), 50_000):
            part = pieces[at : at + 50_000]
            split = [[" " + p] if p.isalpha() else self.split(" " + p) for p in part]
            counts = self.count_words(list(chain.from_iterable(split)))
            edges = np.cumsum([0] + [len(s) for s in split])
            total = np.concatenate(([0], np.cumsum(counts)))
            self.pieces.update(zip(part, (total[edges[1:]] - total[edges[:-1]]).tolist()))

    def counts(self, texts: list[str | None]) -> list[int | None]:
        """The number of tokens of each text."""
        self.tidy()
        # a text is its first pre-tokens, to be counted as they are, and pieces that a space comes before
        first: list[list[str]] = []
        rest: list[list[str]] = []
        for text in texts:
            if not text:
                first.append([])
                rest.append([])
            elif _UNSAFE.search(text):
                first.append(self.split(text))
                rest.append([])
            else:
                head, *pieces = text.split(" ")
                first.append(self.split(head) if head else [])
                rest.append(pieces)
        known = self.words
        if new := list({w for words in first for w in words if w not in known}):
            known.update(zip(new, self.count_words(new).tolist()))
        pieces = self.pieces
        if new := list({p for ps in rest for p in ps if p not in pieces}):
            self.learn(new)
        word, piece = known.__getitem__, pieces.__getitem__
        return [None if t is None else sum(map(word, f)) + sum(map(piece, r)) for t, f, r in zip(texts, first, rest)]

    def count(self, text: str) -> int:
        """The number of tokens of a text."""
        return self.counts([text])[0] or 0


#: A space that white space surrounds: cutting there could split a run that is one pre-token.
_UNSAFE = re.compile(r"\s (?:\s|\Z)|\A (?:\s|\Z)")


@lru_cache(maxsize=2)
def transducer(config: TokenCountConfig) -> Transducer:
    return Transducer(config)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 1 letter, 2 number, 3 white space, 0 other."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    out = np.zeros(0x110000, np.uint8)
    for k, kind in enumerate((r"\p{L}", r"\p{N}", rf"[{_WS}]"), 1):
        for run in regex.finditer(kind + "+", every):
            out[run.start() : run.end()] = k
    return out


_SHORT = {ord(c): 2 for c in "stmd"} | {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}


def begins(text: str, whole: bool = True) -> np.ndarray:
    """For each place in a text, whether a pre-token of ``PATTERN`` begins there. ``whole``: the text's start is one; else it
    is a part of a text, and the first and last few places are not told for certain."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _classes()[cp]
    ws = kind == 3
    out = np.zeros(len(cp), bool)
    if not len(cp):
        return out
    out[0] = whole
    after, here = ws[:-1], ws[1:]
    # a class begins, but a space that goes before is part of what follows; the last of white space is left to what follows
    out[1:] = np.where(after, ~here & (cp[:-1] != 32), kind[1:] != kind[:-1])
    out[1:-1] |= here[:-1] & ~ws[2:]
    if len(cp) > 1 and whole and ws[0] and not ws[1]:
        out[0] = True
    for q in np.flatnonzero((cp == 39) & out).tolist():
        size = _SHORT.get(int(cp[q + 1]), 0) if q + 1 < len(cp) else 0
        if size > 2:
            size = 3 if q + 2 < len(cp) and cp[q + 2] == size else 0
        if size:
            out[q + 1 : q + size] = False
            if q + size < len(cp):
                out[q + size] = True
    return out


#: What lies across a cut: a token, and how many of its bytes are still to come; at the start of a pre-token nothing does.
State = tuple[bytes, int]
EDGE: State = (b"", 0)
#: From a state at the start of a chunk to the states at its end, with the tokens that begin in the chunk.
Map = dict[State, dict[State, int]]


def across(t: Transducer, before: bytes, after: bytes) -> list[State]:
    """The tokens that may lie across a cut."""
    out = []
    for i in range(1, min(t.longest, len(before)) + 1):
        node: int | None = 0
        for byte in before[len(before) - i :]:
            node = t.child.get(node << 8 | byte)
            if node is None:
                break
        j = 0
        while node is not None:
            if t.token[node] >= 0:
                out.append((before[len(before) - i :] + after[:j], j))
            if j == len(after):
                break
            node = t.child.get(node << 8 | after[j])
            j += 1
    return out


class Trace:
    """A walk over a chunk's bytes from one state; where it meets another, that goes on for both."""

    def __init__(self, t: Transducer, entry: State) -> None:
        token, self.at = entry
        self.t, self.other, self.shift = t, None, 0
        first = ((0, t.ranks[token] if token else -1, 0),)
        state = t.number.setdefault(first, len(t.states))
        if state == len(t.states):
            t.states.append(first)
        self.states, self.counts = [state], [0]

    def reach(self, p: int) -> tuple[int, int] | None:
        """The last token that ends at a place on the way, and the number of tokens so far."""
        k = p - self.at
        if k < 0:
            return None
        if k >= len(self.states):
            found = self.other.reach(p) if self.other else None
            return found and (found[0], found[1] + self.shift)
        opened = self.t.states[self.states[k]]
        return (opened[-1][1], self.counts[k]) if opened and not opened[-1][0] else None


def traces(t: Transducer, data: bytes, entries: list[State]) -> dict[State, Trace]:
    """The walks from all states, together."""
    out = {e: Trace(t, e) for e in entries if e[1] <= len(data)}
    waiting = sorted(out.values(), key=lambda w: -w.at)
    live: list[Trace] = []
    p = 0
    while p < len(data) and (live or waiting):
        while waiting and waiting[-1].at == p:
            live.append(waiting.pop())
        stop = waiting[-1].at if waiting else len(data)
        if live:
            p, live = advance(t, data, live, p, stop)
        else:
            p = stop
    return out


def advance(t: Transducer, data: bytes, live: list[Trace], p: int, stop: int) -> tuple[int, list[Trace]]:
    """Walks on from a place until two walks meet, or to ``stop``; which go on from there."""
    states, counts = [[] for _ in live], [[] for _ in live]
    if len(live) < 16:
        now, number = [w.states[-1] for w in live], [w.counts[-1] for w in live]
        while p < stop:
            for i, state in enumerate(now):
                now[i], change = t.step(state, data[p])
                number[i] += change
                states[i].append(now[i])
                counts[i].append(number[i])
            p += 1
            if len(live) > 1 and len(set(now)) < len(live):
                break
    else:
        row, sums = np.array([w.states[-1] for w in live], np.uint64), np.array([w.counts[-1] for w in live])
        rows, totals = [], []
        while p < stop:
            key = (row << np.uint64(8) | np.uint64(data[p])) + np.uint64(1)
            at = t.slots(key)
            row, sums = t.to[at].astype(np.uint64), sums + t.change[at]
            rows.append(row)
            totals.append(sums)
            p += 1
            if len(set(row.tolist())) < len(live):
                break
        states, counts = np.array(rows, np.int64).T.tolist(), np.array(totals).T.tolist()
    seen: dict[int, Trace] = {}
    for w, s, n in zip(live, states, counts):
        o = seen.setdefault(s[-1], w)
        w.states += s if o is w else s[:-1]
        w.counts += n if o is w else n[:-1]
        if o is not w:
            w.other, w.shift = o, n[-1] - o.counts[-1]
    return p, [w for state, w in seen.items() if t.states[state]]  # a walk without open places has no way on


def spans(t: Transducer, data: bytes, entries: list[State], exits: list[State]) -> Map:
    """The map of a part of one pre-token."""
    out: Map = {}
    walks = traces(t, data, entries)
    for entry in entries:
        token, j = entry
        if j > len(data):
            if (token, j - len(data)) in exits:
                out[entry] = {(token, j - len(data)): 0}
            continue
        to = {}
        for piece, rest in exits:
            p = len(data) if not piece else len(data) - len(piece) + rest
            if piece == token and rest == 0 and j == len(data):
                to[piece, rest] = 0
            elif (found := walks[entry].reach(p)) and (not piece or found[0] < 0 or t.fits(found[0], t.ranks[piece])):
                to[piece, rest] = found[1] + bool(piece)
        if to:
            out[entry] = to
    return out


def chunk_map(t: Transducer, before: str, s: str, after: str) -> Map:
    """The map of a chunk between ``margin`` characters on either side (or as many as there are)."""
    t.tidy()
    full = before + s + after
    begin = np.flatnonzero(begins(full, len(before) < t.margin))  # then they go back to the text's start
    low, high = len(before), len(before) + len(s)

    def states(cut: int) -> list[State]:
        if cut in (0, len(full)) or cut in begin:
            return [EDGE]
        k = int(np.searchsorted(begin, cut))
        a, b = int(begin[k - 1]) if k else 0, int(begin[k]) if k < len(begin) else len(full)
        return across(t, full[max(a, cut - t.margin) : cut].encode(), full[cut : min(b, cut + t.margin)].encode())

    entries, exits = states(low), states(high)
    inside = begin[(begin >= low) & (begin < high)]
    if entries == [EDGE] and (not len(inside) or inside[0] > low):
        inside = np.concatenate(([low], inside))
    if not len(inside):
        return spans(t, s.encode(), entries, exits)
    edges = inside.tolist()
    head = spans(t, full[low : edges[0]].encode(), entries, [EDGE])
    words = [full[a:b] for a, b in zip(edges[:-1], edges[1:])]
    distinct = list(dict.fromkeys(words))
    known = dict(zip(distinct, t.count_words(distinct).tolist()))
    middle = sum(known[w] for w in words)
    tail = spans(t, full[edges[-1] : high].encode(), [EDGE], exits).get(EDGE, {})
    return {e: {x: h + middle + n for x, n in tail.items()} for e, to in head.items() for h in to.values()}


def compose(x: Map, y: Map) -> Map:
    """The map of two neighbouring parts. Only one of the states between is on a way through."""
    return {e: found for e, to in x.items() if (found := {f: n + k for m, n in to.items() if m in y for f, k in y[m].items()})}


def scan(maps: list[Map]) -> Map:
    """The map of all parts: neighbours compose in a logarithmic number of rounds."""
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def total(maps: list[Map]) -> int:
    """The count of a whole text."""
    return scan(maps)[EDGE][EDGE]


#: Chunks whose maps are composed together; a string of Spark has fewer than its square.
GROUP = 512


def token_counts(docs: DataFrame, config: TokenCountConfig = TokenCountConfig()) -> DataFrame:
    """doc_id, n_tokens: one row for each document. The documents are read once: small ones are counted where they are,
    giants leave in chunks. A giant's key is a hash of its text, so copies are counted once, and NULL or repeated ids don't
    matter."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "key", "k", "before", "s", "after"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(config)
        for batch in batches:
            _, offsets = tx.string_buffers(batch.column("text"))
            for a, b in tx.row_groups(offsets):
                ids, texts = batch.column("doc_id").slice(a, b - a), batch.column("text").slice(a, b - a).to_pylist()
                keys = [tx.digest(x) if x is not None and len(x) > config.giant else None for x in texts]
                n = t.counts([None if key else x for key, x in zip(keys, texts)])
                none = pa.nulls(b - a, pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.nulls(b - a, pa.int32()), none, none, none], names=names)
                for key, x in zip(keys, texts):
                    for at in range(0, len(x) if key else 0, config.chunk):
                        parts = x[max(0, at - t.margin) : at], x[at : at + config.chunk], x[at + config.chunk : at + config.chunk + t.margin]
                        yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), pa.nulls(1, pa.int64()), pa.array([key]), pa.array([at // config.chunk], pa.int32()), *[pa.array([p]) for p in parts]], names=names)

    found = written(docs.select("doc_id", "text").mapInArrow(lean(read), f"doc_id {kind}, n_tokens long, key string, k int, before string, s string, after string"), "token-counts")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(config)
        for batch in batches:
            done = [pickle.dumps(chunk_map(t, *x)) for x in zip(*[batch.column(c).to_pylist() for c in names[4:]])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(done, pa.binary())], names=["key", "k", "map"])

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["key", "k", "map"]).to_pylist(), key=lambda r: r["k"])
        return pa.table({"key": [rows[0]["key"]], "k": pa.array([rows[0]["k"] // GROUP], pa.int32()), "map": pa.array([pickle.dumps(scan([pickle.loads(r["map"]) for r in rows]))], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["key", "k", "map"]).to_pylist(), key=lambda r: r["k"])
        return pa.table({"key": [rows[0]["key"]], "n": pa.array([total([pickle.loads(r["map"]) for r in rows])], pa.int64())})

    chunks = found.filter("k IS NOT NULL").select("key", "k", "before", "s", "after").dropDuplicates(["key", "k"])
    parts = chunks.mapInArrow(lean(maps), "key string, k int, map binary").groupBy("key", F.floor(F.col("k") / GROUP)).applyInArrow(combine, "key string, k int, map binary")
    counted = parts.groupBy("key").applyInArrow(finish, "key string, n long")
    return found.filter("k IS NULL AND key IS NULL").select("doc_id", "n_tokens").unionByName(
        found.filter("k IS NULL AND key IS NOT NULL").select("doc_id", "key").join(counted, "key").select("doc_id", F.col("n").alias("n_tokens"))
    )

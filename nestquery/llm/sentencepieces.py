"""SentencePiece encoding and decoding with a given BPE model, exact, and in parallel within giant documents.

A BPE segmentation is the one path through the lattice of pieces whose neighbours are all *compatible*: the merges of
their concatenation give back the two. So it is a best path in the max-plus semiring: compatible steps weigh 0, others
minus infinity. A document of more than ``giant`` characters is cut into chunks anywhere. The state at a cut is the piece
across it (or ending at it) and how many characters of that are still to come. Each chunk yields the transfer matrix
from the states at its start to those at its end; the matrices are combined associatively; then each chunk is backtraced
on its own between its two states. Pieces never hold a space after another character, so a chunk with such a place has a
matrix of rank one, and what lies between its first and last place is encoded word by word.

Other documents are encoded word by word where they are. Words that a worker met before come from a bounded memory.

Defined results: NULL text has NULL ids, and an empty one no ids; an empty table has no rows. U+2581, SentencePiece's own sign for a space, is read
as a space. Repeated rows are encoded each; NULL ids are carried through. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import lean, written


@dataclass(frozen=True)
class SentencePieceConfig:
    model: str = "/opt/tokenizers/piece_bpe_32k.model"
    #: Characters above which a document is cut, and those of a chunk.
    giant: int = 65_536
    chunk: int = 16_384
    #: Words that a worker remembers.
    memory: int = 300_000


SPACE = "▁"
NONE = -np.inf
_SEGMENT = re.compile(r" +[^ ]+| +$")


class Model(dict):
    """The ids of words, as bytes of 32-bit integers; a word stands for itself with one space before it."""

    def __init__(self, path: str, memory: int) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memory = memory
        n = self.sp.get_piece_size()
        self.ids = {self.sp.id_to_piece(i): i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))}
        self.score = {p: self.sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.byte = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [self.sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        self.fits: dict[tuple[str, str], bool] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.memory:
            self.clear()
        out = self[word] = np.array(self.sp.encode(word) if word else [self.ids[SPACE]], "<i4").tobytes()
        return out

    def piece_ids(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.byte[b] for b in piece.encode()]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as bytes."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [s[1:] for s in _SEGMENT.findall(" " + text)]
        else:
            words = text.split(" ")
        return b"".join([self[w] for w in words])

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8."""
        table = self.bytes
        out = b"".join([table[i] for i in ids])
        return out[1:] if out[:1] == b" " else out

    def merge(self, s: str) -> list[str]:
        """BPE of a short string: the best-scoring neighbours merge, the first of equals, until none can."""
        parts = list(s)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], NONE), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > self.memory:
                self.fits.clear()
            self.fits[key] = self.merge(a + b) == [a, b]
        return self.fits[key]


@lru_cache(maxsize=2)
def model(path: str, memory: int) -> Model:
    return Model(path, memory)


State = tuple[str, int]
#: At the start and the end of a document no piece is across.
EDGE: State = ("", 0)


def states(m: Model, before: str, after: str) -> list[State]:
    """What may lie across a cut between two strings: a piece, and its characters after the cut."""
    if not before or not after:
        return [EDGE]
    out = []
    for i in range(1, min(m.longest, len(before)) + 1):
        head = before[len(before) - i :]
        for j in range(0, min(m.longest - i, len(after)) + 1):
            piece = head + after[:j]
            if piece in m.ids or len(piece) == 1:
                out.append((piece, j))
    return out


def _first_cut(s: str, before: str) -> int:
    """The first place in ``s`` (``before`` precedes it) where a piece must end: a space follows another character."""
    if s[:1] == SPACE and before and before[-1] != SPACE:
        return 0
    at = re.search(f"[^{SPACE}]{SPACE}", s)
    return at.start() + 1 if at else -1


def _last_cut(s: str) -> int:
    """The last such place inside ``s``."""
    at = len(s)
    while (at := s.rfind(SPACE, 0, at)) > 0:
        if s[at - 1] != SPACE:
            return at
    return -1


def paths(m: Model, s: str, after: str, entries: list[State], exits: list[State]) -> np.ndarray:
    """The transfer matrix of ``s``: 0 where a path of compatible pieces leads from a state at its start to one at its
    end, else minus infinity."""
    return _walk(m, s, after, entries, exits)[0]


def _walk(m: Model, s: str, after: str, entries: list[State], exits: list[State], keep: bool = False):
    """The matrix, and for one entry the last piece before each piece on its path."""
    n = len(s)
    full = s + after[: m.longest]
    ends: list[dict[str, np.ndarray]] = [{} for _ in range(n + 1)]
    back: dict[tuple[int, str], str] = {}
    matrix = np.full((len(entries), len(exits)), NONE)
    column = {e: k for k, e in enumerate(exits)}
    for k, (piece, r) in enumerate(entries):
        if r <= n:
            v = ends[r].setdefault(piece, np.full(len(entries), NONE))
            v[k] = 0.0
        if r >= n and (piece, r - n) in column:
            matrix[k, column[(piece, r - n)]] = 0.0
    for at in range(n):
        if not ends[at]:
            continue
        for size in range(1, min(m.longest, len(full) - at) + 1):
            piece = full[at : at + size]
            if piece not in m.ids and size > 1:
                continue
            best = None
            for last, v in ends[at].items():
                if not last or m.compatible(last, piece):
                    best = v if best is None else np.maximum(best, v)
                    if keep:
                        back[(at + size, piece)] = last
            if best is None:
                continue
            if at + size <= n:
                old = ends[at + size].get(piece)
                ends[at + size][piece] = best if old is None else np.maximum(old, best)
            if at + size >= n and (piece, at + size - n) in column:
                c = column[(piece, at + size - n)]
                matrix[:, c] = np.maximum(matrix[:, c], best)
        if not keep and at > m.longest:
            ends[at] = {}
    if exits == [EDGE]:
        for v in ends[n].values():
            matrix[:, 0] = np.maximum(matrix[:, 0], v)
    return matrix, back, ends


def pieces_between(m: Model, s: str, after: str, entry: State, exit: State) -> list[str]:
    """The pieces that begin in ``s``, from one state to another."""
    r = entry[1]
    if r > len(s) or (r == len(s) and exit == entry[:1] + (0,)):
        return []
    _, back, ends = _walk(m, s, after, [entry], [exit], keep=True)
    if exit == EDGE:
        last = [p for p, v in ends[len(s)].items() if v[0] == 0.0]
        at, piece = len(s), last[0]
    else:
        at, piece = len(s) + exit[1], exit[0]
    out = []
    while at > r or (at == r and piece != entry[0]):
        out.append(piece)
        at, piece = at - len(piece), back[(at, piece)]
        if at <= r:
            break
    return out[::-1]


class Chunk:
    """A part of a giant document: its characters with ``longest`` of context on either side."""

    def __init__(self, m: Model, before: str, s: str, after: str) -> None:
        self.m, self.before, self.s, self.after = m, before, s, after
        self.entries, self.exits = states(m, before, s + after), states(m, before + s, after)
        self.first = _first_cut(s, before)
        self.last = max(self.first, _last_cut(s)) if self.first >= 0 else -1

    def matrix(self) -> np.ndarray:
        if self.first < 0:
            return paths(self.m, self.s, self.after, self.entries, self.exits)
        head = paths(self.m, self.s[: self.first], "", self.entries, [EDGE]) if self.first else np.array([[0.0 if e == EDGE or e[1] == 0 else NONE] for e in self.entries])
        tail = paths(self.m, self.s[self.last :], self.after, [EDGE], self.exits)
        return head + tail

    def ids(self, entry: State, exit: State) -> list[int]:
        m = self.m
        if self.first < 0:
            return [i for p in pieces_between(m, self.s, self.after, entry, exit) for i in m.piece_ids(p)]
        head = pieces_between(m, self.s[: self.first], "", entry, EDGE) if self.first else []
        tail = pieces_between(m, self.s[self.last :], self.after, EDGE, exit)
        middle = self.s[self.first : self.last].replace(SPACE, " ")
        return [i for p in head for i in m.piece_ids(p)] + np.frombuffer(m.encode(middle[1:]) if len(middle) > 1 else b"", "<i4").tolist() + [i for p in tail for i in m.piece_ids(p)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, in a logarithmic number of rounds of independent products."""
    out = list(matrices)
    step = 1
    while step < len(out):
        out = out[:step] + [product(out[i - step], out[i]) for i in range(step, len(out))]
        step *= 2
    return out


def cuts(matrices: list[np.ndarray]) -> list[int]:
    """The number of the state at the end of each chunk on the best path."""
    prefix = scan(matrices)
    at = [int(prefix[-1][0].argmax())]
    for k in range(len(matrices) - 1, 0, -1):
        at.append(int((prefix[k - 1][0] + matrices[k][:, at[-1]]).argmax()))
    return at[::-1]


def _rows(ids: list[bytes | None]) -> tuple[pa.Array, pa.Array]:
    """Counts and lists of ids."""
    sizes = np.array([len(x) // 4 if x is not None else 0 for x in ids], np.int64)
    missing = np.array([x is None for x in ids], bool)
    values = pa.array(np.frombuffer(b"".join([x for x in ids if x]), "<i4"))
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.append(missing, False))
    return pa.array(sizes.astype(np.int32), mask=missing), pa.ListArray.from_arrays(offsets, values)


def _round_trip(m: Model, text: str | None, ids: bytes | None) -> bool | None:
    return None if text is None else m.decode(np.frombuffer(ids, "<i4").tolist()) == text.replace(SPACE, " ").encode()


def encode(docs: DataFrame, config: SentencePieceConfig = SentencePieceConfig()) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip (whether the decoded ids are the text): one row for each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(config.model, config.memory)
        for batch in batches:
            _, offsets = tx.string_buffers(batch.column("text"))
            for a, b in tx.row_groups(offsets):
                text = batch.column("text").slice(a, b - a).to_pylist()
                ids = [None if t is None else m.encode(t) for t in text]
                n, lists = _rows(ids)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), n, lists, pa.array([_round_trip(m, t, i) for t, i in zip(text, ids)], pa.bool_())], names=["doc_id", "n_tokens", "token_ids", "round_trip"])

    schema = f"doc_id {kind}, n_tokens int, token_ids array<int>, round_trip boolean"
    small = texts.filter(F.coalesce(F.length("text") <= config.giant, F.lit(True))).mapInArrow(lean(whole), schema)
    return small.unionByName(_encode_giants(texts.filter(F.length("text") > config.giant), config, schema))


#: Characters of a chunk's neighbours that its matrix depends on; no piece has more.
MARGIN = 64
#: Chunks whose matrices are combined in one task; a string of Spark has fewer chunks than its square.
GROUP = 512


def _encode_giants(giants: DataFrame, config: SentencePieceConfig, schema: str) -> DataFrame:
    """Documents in chunks, which are written once; their texts are not moved again. A document's key is a hash of its text, so
    copies are encoded once and NULL or repeated ids don't matter, and the decoded ids are compared with it. The scan goes
    up from chunks to groups of them and to the document, and down again."""
    size = config.chunk
    names = ["doc_id", "key", "k", "before", "s", "after"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for r, text in enumerate(batch.column("text").to_pylist()):
                key = tx.digest(text.replace(SPACE, " "))
                none = pa.nulls(1, pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(r, 1), pa.array([key]), pa.nulls(1, pa.int32()), none, none, none], names=names)
                marked = SPACE + text.replace(" ", SPACE)  # a text begins with the space that SentencePiece puts there
                for at in range(0, len(marked), size):
                    parts = marked[max(0, at - MARGIN) : at], marked[at : at + size], marked[at + size : at + size + MARGIN]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), pa.array([key]), pa.array([at // size], pa.int32()), *[pa.array([p]) for p in parts]], names=names)

    kind = giants.schema["doc_id"].dataType.simpleString()
    found = written(giants.mapInArrow(lean(cut), f"doc_id {kind}, key string, k int, before string, s string, after string"), "giant-chunks")
    chunks = found.filter("k IS NOT NULL").drop("doc_id").dropDuplicates(["key", "k"])

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(config.model, config.memory)
        for batch in batches:
            rows = batch.to_pylist()
            out = [Chunk(m, r["before"], r["s"], r["after"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array([pickle.dumps((c.entries, c.exits, c.matrix())) for c in out], pa.binary())], names=["key", "k", "matrix"])

    def parts_of(table: pa.Table) -> tuple[list[dict], list[tuple]]:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        return rows, [pickle.loads(r["matrix"]) for r in rows]

    def reduce(table: pa.Table) -> pa.Table:
        """The matrix of a group of chunks."""
        rows, parts = parts_of(table.select(["key", "k", "matrix"]))
        whole = parts[0][0], parts[-1][1], scan([p[2] for p in parts])[-1]
        return pa.table({"key": [rows[0]["key"]], "k": pa.array([rows[0]["k"] // GROUP], pa.int32()), "matrix": pa.array([pickle.dumps(whole)], pa.binary())})

    def ends_of(rows: list[dict], parts: list[tuple], entry: State, exit: State) -> pa.Table:
        first = parts[0][2][[parts[0][0].index(entry)]]
        last = parts[-1][2] if len(parts) > 1 else first
        last = last[:, [parts[-1][1].index(exit)]]
        at = cuts([first[:, [parts[0][1].index(exit)]]] if len(parts) == 1 else [first, *[p[2] for p in parts[1:-1]], last])
        exits = [p[1][i] for p, i in zip(parts[:-1], at)] + [exit]
        return pa.table({"key": [r["key"] for r in rows], "k": pa.array([r["k"] for r in rows], pa.int32()), "ends": pa.array([pickle.dumps(e) for e in zip([entry, *exits[:-1]], exits)], pa.binary())})

    def top(table: pa.Table) -> pa.Table:
        """Between which states each group lies."""
        rows, parts = parts_of(table.select(["key", "k", "matrix"]))
        return ends_of(rows, parts, EDGE, EDGE)

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        """Between which states each chunk of a group lies."""
        rows, parts = parts_of(left.select(["key", "k", "matrix"]))
        return ends_of(rows, parts, *pickle.loads(right.column("ends")[0].as_py()))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(config.model, config.memory)
        for batch in batches:
            rows = batch.to_pylist()
            ids = [Chunk(m, r["before"], r["s"], r["after"]).ids(*pickle.loads(r["ends"])) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(ids, pa.list_(pa.int32()))], names=["key", "k", "ids"])

    matrices = written(chunks.mapInArrow(lean(transfer), "key string, k int, matrix binary"), "giant-matrices")
    group = F.floor(F.col("k") / GROUP).cast("int").alias("group")
    groups = matrices.groupBy("key", group).applyInArrow(reduce, "key string, k int, matrix binary").groupBy("key").applyInArrow(top, "key string, k int, ends binary").withColumnRenamed("k", "group")
    ends = matrices.groupBy("key", group).cogroup(groups.groupBy("key", "group")).applyInArrow(down, "key string, k int, ends binary")
    traced = chunks.join(ends, ["key", "k"]).mapInArrow(lean(trace), "key string, k int, ids array<int>")
    joined = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("token_ids"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(config.model, config.memory)
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("token_ids")[r].as_py()
                ok = hashlib.sha256(m.decode(ids)).hexdigest() == batch.column("key")[r].as_py()
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(r, 1), pa.array([len(ids)], pa.int32()), batch.column("token_ids").slice(r, 1), pa.array([ok])], names=["key", "n_tokens", "token_ids", "round_trip"])

    checked = joined.mapInArrow(lean(check), "key string, n_tokens int, token_ids array<int>, round_trip boolean")
    return found.filter("k IS NULL").select("doc_id", "key").join(checked, "key").select("doc_id", "n_tokens", "token_ids", "round_trip")


def decode(encoded: DataFrame, config: SentencePieceConfig = SentencePieceConfig()) -> DataFrame:
    """doc_id, text of doc_id, token_ids; NULL ids give NULL text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(config.model, config.memory)
        for batch in batches:
            texts = [None if x is None else m.decode(x).decode("utf-8", "replace") for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "token_ids").mapInArrow(lean(run), f"doc_id {kind}, text string")

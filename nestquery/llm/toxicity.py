"""Toxicity: a Levenshtein automaton intersected with a lexicon trie, and the context of what it finds.

The intersection is determinised once: a state is a set of (trie node, edits so far), so a word in the text is matched
against the whole lexicon, misspellings included, by one walk. All words of a block of text walk together, one
character a step, and most leave after two. An edit is a letter too many, missing or wrong, or two neighbours swapped. The
first character must be right and short terms allow no edits, which keeps ordinary neighbours out. A stem (``term*``) also matches any ending. Each hit is scored by its window of words: full
weight where it is used, a part where it is quoted, reported or negated. A document is toxic from a sum of ``threshold``,
which one hit that is used reaches, misspelled or not.

The lexicon is a list of insults and what a bounded labelled sample adds: words and stems that occur in many different
contexts of toxic documents and hardly in clean ones (contexts, so that copies of a document count once), beyond what
chance would give. Learned words allow edits by their length as listed ones do, learned stems none; both only count beyond
what chance may put in the densest window of words, of sizes from the document down by halves. Words near a term that stand in several contexts of the clean sample,
neither quoted nor reported nor negated, are ordinary words and only match exactly; so does a term that has several of
them near it.

Defined results: NULL and empty texts have no hits and score 0; an empty table has no rows. Without labels only the list is
used. Repeated rows are scored each; NULL ids are carried through. Extra columns are ignored. All of a long text is
scanned. A word near several terms (a tie) is a hit of the one with the fewest edits, then of the first by the alphabet.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import lean, written

INSULTS = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "scum", "trash", "loser", "losers", "clown", "clowns", "pathetic", "worthless", "disgusting", "imbecile", "cretin", "scumbag", "bastard", "bastards", "bitch",
    "asshole", "dumbass", "jackass", "dickhead", "fuck", "fucking", "fucker", "shithead", "bullshit", "slut", "whore", "wanker", "twat", "retard", "retarded", "degenerate", "subhuman", "vermin", "parasite", "lowlife", "filthy", "braindead",
)


@dataclass(frozen=True)
class ToxicityConfig:
    lexicon: tuple[str, ...] = INSULTS
    #: Labelled rows of either class in the sample at most, the first in the order of a hash of their id.
    fit_rows: int = 1500
    #: Contexts in which a learned term was toxic at least, and how much commoner it is in toxic than in clean documents at
    #: least. How many terms these are is bounded by the sample alone.
    contexts: int = 8
    ratio: float = 20.0
    #: Words in which one learned term may stand by chance.
    chance_words: int = 300
    #: The greatest chance that a learned term would be this rare in the clean sample, were it as common there.
    chance: float = 1e-7
    #: Contexts of the clean sample in which a word near a term must stand plainly to be ordinary.
    frequent: int = 3
    #: A term with so many ordinary words near it only matches exactly.
    neighbours: int = 2
    #: A term of this length allows one edit, of the second two.
    one_edit: int = 5
    two_edits: int = 9
    #: Characters of context on either side.
    window: int = 80
    threshold: float = 0.9


DEAD, OTHER = 0, 0
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
#: A node of the trie, the ending of stem k (-1 - k), or a node with the first letter read of a swapped pair below it.
Node = int | tuple[int, str]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point, whether it is in words."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


class Automaton:
    """The determinised intersection. ``step[state, letter]``; state 0 is dead, 1 the start; letter 0 is any other."""

    def __init__(self, terms: list[str], config: ToxicityConfig, exact: frozenset[str] = frozenset()) -> None:
        self.terms = terms
        edits_of = lambda t: 0 if t.endswith("*") or t in exact else (len(t) >= config.one_edit) + (len(t) >= config.two_edits)
        children: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        stems: dict[int, int] = {}
        allowed = [0]
        for k, term in enumerate(terms):
            word, node = term.rstrip("*"), 0
            edits = edits_of(term)
            for c in word:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    allowed.append(0)
                node = children[node][c]
                allowed[node] = max(allowed[node], edits)
            (stems if term.endswith("*") else ends)[node] = k
        letters = sorted({c for d in children for c in d})
        self.letters = {c: i + 1 for i, c in enumerate(letters)}
        limits = [edits_of(t) for t in terms]

        def close(found: dict[Node, int]) -> frozenset[tuple[Node, int]]:
            """With what deletions of trie letters reach."""
            todo = list(found.items())
            while todo:
                v, e = todo.pop()
                if isinstance(v, tuple) or v <= 0:
                    continue
                for w in children[v].values():
                    if e + 1 <= allowed[w] and e + 1 < found.get(w, 99):
                        found[w] = e + 1
                        todo.append((w, e + 1))
            return frozenset(found.items())

        def move(state: frozenset[tuple[Node, int]], c: str | None) -> frozenset[tuple[Node, int]]:
            found: dict[Node, int] = {}
            for v, e in state:
                if isinstance(v, tuple):  # the second letter of a swapped pair is next
                    w = children[children[v[0]][c]].get(v[1]) if c in children[v[0]] else None
                    if w is not None and e <= allowed[w]:
                        found[w] = min(found.get(w, 99), e)
                    continue
                if v < 0:  # inside the ending of a stem
                    found[v] = 0
                    continue
                if v in stems and e == 0:
                    found[-1 - stems[v]] = 0
                for d, w in children[v].items():
                    cost = e + (d != c)
                    if cost <= (allowed[w] if v else 0) or (d == c and cost == 0):
                        found[w] = min(found.get(w, 99), cost)
                    if v and c != d and (x := children[w].get(c)) is not None and e + 1 <= allowed[x]:  # perhaps swapped with d
                        found[v, c] = min(found.get((v, c), 99), e + 1)
                if v and e + 1 <= allowed[v]:  # a letter too many
                    found[v] = min(found.get(v, 99), e + 1)
            return close(found)

        start = frozenset({(0, 0)})
        number = {frozenset(): 0, start: 1}
        order, step = [frozenset(), start], [[0] * (len(letters) + 1)]
        k = 1
        while k < len(order):
            state = order[k]
            near = {d for v, _ in state if isinstance(v, tuple) or v >= 0 for d in children[v[0] if isinstance(v, tuple) else v]}
            near |= {d for v, _ in state if not isinstance(v, tuple) and v > 0 for w in children[v].values() for d in children[w]}
            rest = None
            row = []
            for c in [None, *letters]:
                if c is None or c in near:
                    to = move(state, c)
                else:
                    to = rest
                if c is None:
                    rest = to
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            step.append(row)
            k += 1
        self.step = np.array(step, np.int32)
        self.term = np.full(len(order), -1, np.int32)
        self.edits = np.zeros(len(order), np.int32)
        self.near: dict[int, list[int]] = {}
        for i, state in enumerate(order):
            best = [(e, ends[v]) for v, e in state if v in ends and e <= limits[ends[v]]]
            best += [(0, stems[v]) for v, e in state if v in stems and e == 0] + [(0, -1 - v) for v, _ in state if not isinstance(v, tuple) and v < 0]
            if best:
                self.edits[i], self.term[i] = min(best)
                self.near[i] = [k for _, k in best]
        self.table = np.zeros(0x10000, np.int32)
        for c, i in self.letters.items():
            if ord(c) < 0x10000:
                self.table[ord(c)] = i
        for digit, c in _LEET.items():
            if digit not in self.letters:
                self.table[ord(digit)] = self.letters.get(c, OTHER)
        self.most = max([len(t) for t in terms if not t.endswith("*")], default=0) + 2
        self.stemmed = bool(stems)

    def terms_near(self, word: str) -> list[str]:
        """All terms that one word matches."""
        state = 1
        for c in word:
            state = int(self.step[state, self.table[ord(c)] if ord(c) < 0x10000 else OTHER])
        return [self.terms[k] for k in self.near.get(state, ())]

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, term, edits) of the words of a lower-cased text that match."""
        out = []
        size = 1 << 20
        at = 0
        while at < len(text):
            to = min(len(text), at + size)
            while to < len(text) and text[to].isalnum():  # a block ends between words
                to += 1
            cp = np.frombuffer(text[at:to].encode("utf-32-le", "surrogatepass"), np.uint32)
            m = _letters()[cp]
            edge = np.diff(np.concatenate(([0], m.view(np.int8), [0])))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if not self.stemmed:
                ok = end - start <= self.most
                start, end = start[ok], end[ok]
            letter = self.table[np.minimum(cp, 0xFFFF)]
            live, state = np.arange(len(start)), np.ones(len(start), np.int32)
            k = 0
            while len(live):
                state[live] = self.step[state[live], letter[start[live] + k]]
                k += 1
                done = end[live] - start[live] == k
                ended = live[done]
                for i in ended[self.term[state[ended]] >= 0]:
                    out.append((at + int(start[i]), at + int(end[i]), int(self.term[state[i]]), int(self.edits[state[i]])))
                live = live[~done & (state[live] != DEAD)]
            at = to
        return sorted(out)


_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
_REPORT = re.compile(r"\b(?:said|says|say|wrote|writes|called|calls|calling|quote|quoted|quotes|quoting|word|words|term|terms|title|titled|named|according|the word|so-called|reported|alleged)\b")
_NOT = re.compile(r"\b(?:not|never|isn't|aren't|wasn't|no)\s+(?:an?\s+|the\s+)?$")
_LAST = re.compile(r"\w*(?=\W*$)")
_YOU = re.compile(r"\b(?:you|you're|your|u)\b")


def weight(text: str, start: int, end: int, edits: int, config: ToxicityConfig) -> float:
    """The score of a hit in its window."""
    return (1.0, 0.95, 0.9)[min(edits, 2)] * use(text, start, end, config)


def use(text: str, start: int, end: int, config: ToxicityConfig) -> float:
    """The share of a hit that counts as it is used: less than 1 where it is quoted, reported or negated."""
    before, after = text[max(0, start - config.window) : start], text[end : end + config.window]
    for o, c in zip(_OPEN, _CLOSE):
        left, right = before.rfind(o), after.find(c)
        inside = left >= 0 and right >= 0 and "\n" not in before[left:] and (before.count(o) % 2 == 1 if o == c else before.rfind(c) < left)
        if inside:
            return 0.2
    if _NOT.search(before):
        return 0.5
    if _REPORT.search(before[-40:]):
        return 0.4
    return 1.3 if _YOU.search(before[-30:]) or _YOU.search(after[:30]) else 1.0


def by_chance(words: np.ndarray, places: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """Learned hits that chance may put in the densest of so many windows of so many words; with one window, the mean.

    The k above the mean m with exp(-(k ln(k/m) - k + m)), Chernoff's bound of k Poisson hits in one window, at 1/places.
    """
    mean, rare = words / config.chance_words, np.log(places)
    low, high = mean, mean + 2 * rare + np.sqrt(2 * mean * rare)
    for _ in range(40):
        k = (low + high) / 2
        over = k * np.log(k / mean) - k + mean > rare
        low, high = np.where(over, low, k), np.where(over, k, high)
    return high


def beyond_chance(at: list[int], values: list[float], words: int, config: ToxicityConfig) -> float:
    """The greatest excess of learned hits, at these words, over chance in a window of the document."""
    if not at:
        return 0.0
    place, sums = np.array(at), np.concatenate(([0.0], np.cumsum(values)))
    sizes = [words]
    while sizes[-1] > 1:
        sizes.append(sizes[-1] // 2)
    most = [float((sums[np.searchsorted(place, place + w)] - sums[:-1]).max()) for w in sizes]
    size = np.array(sizes, float)
    return max(0.0, float((np.array(most) - by_chance(size, words / size, config)).max()))


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[str, ...]
    #: Words that only count if they are terms themselves.
    ordinary: frozenset[str]
    #: Terms that only match exactly.
    exact: frozenset[str]
    #: Terms from the sample.
    learned: frozenset[str]


def learn(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> Lexicon:
    """The lexicon, with terms and ordinary words of a bounded labelled sample."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("_id"), "toxic").distinct()
    some = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(config.fit_rows) for k in (0, 1)]
    sample = some[0].unionByName(some[1])
    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("_doc"), F.lower("text").alias("text"))
    words = F.split("text", r"[^\p{L}\p{N}]+")
    texts = written(texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_id", "toxic", "text"), "toxicity-sample")  # the sample is bounded
    rows = texts.select("_id", "toxic", words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(F.col("w")[i - 1].alias("word"), F.coalesce(F.get("w", i - 2), F.lit("")).alias("before")))
    each = rows.select("toxic", F.explode(pairs).alias("p")).select("toxic", F.col("p.word").alias("word"), F.col("p.before").alias("before")).filter("length(word) >= 3").distinct()
    each = each.select("toxic", "word", "before", F.explode(F.array("word", *[F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in (5, 6, 7)])).alias("term")).filter("term IS NOT NULL")
    counts = each.groupBy("term").agg(F.sum((F.col("toxic") == 1).cast("int")).alias("t"), F.sum((F.col("toxic") == 0).cast("int")).alias("c"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("word"))).alias("words"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("before"))).alias("contexts"))
    size = {r.toxic: min(r["count"], config.fit_rows) for r in known.groupBy("toxic").count().collect()}
    bad, clean_size = size.get(1, 0), max(1, size.get(0, 0))
    commoner = F.col("t") * clean_size >= config.ratio * bad * (F.col("c") + 1)
    good = counts.filter((F.col("contexts") >= config.contexts) & commoner & (~F.col("term").endswith("*") | (F.col("words") >= 4)))
    share = bad / (bad + clean_size)
    # the logarithm of about the chance of such a split among t + c contexts
    unlikely = lambda r: r.t * np.log(max(share, 1e-9)) + r.c * np.log(r.t + r.c) <= np.log(config.chance)
    learned = [r.term for r in good.orderBy(F.desc("t"), "term").collect() if unlikely(r)]
    stems = {t for t in learned if t.endswith("*")}
    covered = lambda t: any(t[:n] + "*" in stems for n in range(1, len(t.rstrip("*"))))
    new = frozenset(t for t in learned if not covered(t) and t not in config.lexicon)
    terms = tuple(sorted({*config.lexicon, *new}))
    automaton = Automaton(list(terms), config)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for t in batch.column("text").to_pylist():
                for a, b, _, edits in automaton.hits(t):
                    if edits and use(t, a, b, config) >= 1:
                        found.add((t[a:b], _LAST.search(t[max(0, a - config.window) : a])[0]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*sorted(found))] or [pa.array([], pa.string())] * 2, names=["word", "before"])

    clean = texts.filter("toxic = 0").select("text").mapInArrow(lean(near), "word string, before string")
    seen = clean.groupBy("word").agg(F.count_distinct("before").alias("contexts"))
    ordinary = frozenset(r.word for r in seen.filter(F.col("contexts") >= config.frequent).collect())
    crowd = Counter(t for w in ordinary for t in automaton.terms_near(w))
    return Lexicon(terms, ordinary, frozenset(t for t, n in crowd.items() if n >= config.neighbours), new)


def toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """doc_id, score, n_hits, terms (distinct, sorted), toxic: one row for each document."""
    lexicon = learn(docs, labels, config)
    automaton = Automaton(list(lexicon.terms), config, lexicon.exact)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, numbers, names = [], [], []
            _, offsets = tx.string_buffers(batch.column("text"))
            for a, b in tx.row_groups(offsets):
                texts = [(t or "").lower() for t in batch.column("text").slice(a, b - a).to_pylist()]
                edges = np.cumsum([0] + [len(t) + 1 for t in texts])
                joined = "\0".join(texts)
                total, n, terms = np.zeros(b - a), np.zeros(b - a, np.int32), [set() for _ in texts]
                found: dict[int, tuple[list[int], list[float]]] = {}
                for s, e, term, edits in automaton.hits(joined):
                    if edits and joined[s:e] in lexicon.ordinary:
                        continue
                    r = int(np.searchsorted(edges, s, side="right")) - 1
                    value = weight(texts[r], s - int(edges[r]), e - int(edges[r]), edits, config)
                    if automaton.terms[term] in lexicon.learned:
                        starts, values = found.setdefault(r, ([], []))
                        starts.append(s - int(edges[r]))
                        values.append(min(1.0, value))
                    else:
                        total[r] += value
                    n[r] += 1
                    terms[r].add(automaton.terms[term])
                for r, (starts, values) in found.items():
                    at = np.cumsum([texts[r].count(" ", x, y) for x, y in zip([0, *starts], starts)])
                    total[r] += beyond_chance(at.tolist(), values, texts[r].count(" ") + 1, config)
                sums.append(total)
                numbers.append(n)
                names += [sorted(t) for t in terms]
            total = np.round(np.concatenate(sums), 6) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), pa.array(np.concatenate(numbers) if numbers else np.zeros(0, np.int32)), pa.array(names, pa.list_(pa.string())), pa.array(total >= config.threshold)], names=["doc_id", "score", "n_hits", "terms", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(score), f"doc_id {kind}, score double, n_hits int, terms array<string>, toxic boolean")

"""Token counts and SentencePiece against the libraries they stand for."""

import base64
import random
from functools import lru_cache

import pytest
from .helpers import awkward, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from nestquery.llm import sentencepieces as sp
from nestquery.llm import token_counts as tc

CONFIG = tc.TokenCountConfig()
PIECES = sp.SentencePieceConfig()


@lru_cache
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(CONFIG.vocabulary, "rb"))}
    return tiktoken.Encoding("own", pat_str=CONFIG.pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def sentencepiece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES.model)


TEXT = st.text(st.one_of(st.sampled_from("ab eé\n\t'.0▁😀ß中 "), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_are_those_of_the_library(text):
    assert tc.transducer(CONFIG).count(text) == len(tiktoken_encoding().encode_ordinary(text))


def chunk_maps(t, text, size):
    return [tc.chunk_map(t, text[max(0, i - tc.MARGIN) : i], text[i : i + size], text[i + size : i + size + tc.MARGIN]) for i in range(0, len(text), size)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab eé\n\t'.0▁😀ß中strevlmd\u3000\x85"), max_size=40))
def test_where_pre_tokens_begin(text):
    import regex

    assert [i for i, x in enumerate(tc.begins(text)) if x] == [m.start() for m in regex.finditer(CONFIG.pattern, text)]


def test_texts_without_spaces_are_counted_within_chunks():
    """Every chunk gives counts for a few states at its start, and all maps together the library's count."""
    rng = random.Random(9)
    t = tc.transducer(CONFIG)
    cjk = "".join(chr(rng.randrange(*rng.choice([(0x4E00, 0x9FFF), (0x3041, 0x3096), (0xAC00, 0xD7A3)]))) for _ in range(100_000))
    for text in (cjk, "的" * 40_000, "".join(rng.choice("ABCDEFabcdef0123+/") for _ in range(80_000)), "x" * 40_000 + " " * 40_000 + "-" * 20_000):
        maps = chunk_maps(t, text, CONFIG.chunk)
        assert all(m and all(isinstance(n, int) for to in m.values() for n in to.values()) for m in maps)
        assert tc.total(maps) == len(tiktoken_encoding().encode_ordinary(text))


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_chunk_maps_compose(text, size):
    t = tc.transducer(CONFIG)
    maps = chunk_maps(t, text, size)
    if maps:
        assert tc.total(maps) == len(tiktoken_encoding().encode_ordinary(text))


def long_texts():
    rng = random.Random(5)
    words = ["the", "quick", "brown", "naïve", "fox's", "12345", "  ", "\n\n", "😀", "antidisestablishmentarianism"]
    return [" ".join(rng.choice(words) for _ in range(20_000)), "".join(rng.choice("abcdeé▁") for _ in range(66_000)), "x" * 66_000, "a" + " " * 66_000 + "b"]


def test_token_counts(spark):
    rows = awkward() + [(20 + k, t) for k, t in enumerate(long_texts())] + [(20, long_texts()[0])]
    got = sorted(map(tuple, tc.token_counts(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(i, None if t is None else len(tiktoken_encoding().encode_ordinary(t))) for i, t in rows], key=str)
    assert tc.token_counts(docs(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_ids_are_those_of_the_library(text):
    m = sp.model(PIECES.model, PIECES.memory)
    import numpy as np

    want = sentencepiece_model().encode(text.replace("▁", " "))
    ids = np.frombuffer(m.encode(text), "<i4").tolist()
    assert ids == want
    assert m.decode(ids).decode("utf-8") == text.replace("▁", " ")


@settings(max_examples=150, deadline=None)
@given(st.text("ab e .é", max_size=60), st.integers(1, 7))
def test_max_plus_scan(text, size):
    if not text:
        return
    m = sp.model(PIECES.model, PIECES.memory)
    marked = sp.SPACE + text.replace(" ", sp.SPACE)
    chunks = [sp.Chunk(m, marked[max(0, i - 64) : i], marked[i : i + size], marked[i + size : i + size + 64]) for i in range(0, len(marked), size)]
    at = sp.cuts([c.matrix() for c in chunks])
    exits = [c.exits[i] for c, i in zip(chunks, at)]
    got = [i for c, a, b in zip(chunks, [sp.EDGE, *exits[:-1]], exits) for i in c.ids(a, b)]
    assert got == sentencepiece_model().encode(text)


def test_sentencepiece(spark):
    texts = long_texts()
    rows = awkward() + [(20, texts[0]), (20, texts[0]), (21, texts[3]), (22, texts[1][:66_000].replace("▁", " "))]
    encoded = sp.encode(docs(spark, rows))
    got = sorted(((r.doc_id, r.n_tokens, r.token_ids, r.round_trip) for r in encoded.collect()), key=str)
    want = []
    for i, t in rows:
        ids = None if t is None else sentencepiece_model().encode(t.replace("▁", " "))
        want.append((i, None if ids is None else len(ids), ids, None if ids is None else True))
    assert got == sorted(want, key=str)
    back = sorted(map(tuple, sp.decode(encoded).collect()), key=str)
    assert back == sorted([(i, t if t is None else t.replace("▁", " ")) for i, t in rows], key=str)
    assert sp.encode(docs(spark, [])).collect() == []


@pytest.mark.parametrize("a, b", [(3, 4), (1, 7)])
def test_prefix_scan_is_the_product(a, b):
    import numpy as np

    rng = np.random.default_rng(a)
    shapes = rng.integers(1, 5, b + 1)
    matrices = [np.where(rng.random((x, y)) < 0.6, 0.0, -np.inf) for x, y in zip(shapes[:-1], shapes[1:])]
    out = matrices[0]
    for m, prefix in zip(matrices[1:], sp.scan(matrices)[1:]):
        out = sp.product(out, m)
        assert (out == prefix).all()

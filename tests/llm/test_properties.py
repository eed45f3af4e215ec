"""Random texts: the encoders and formats against the libraries and their inverses."""

import functools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat, quality, tokencounts, tokenfiles
from tests.llm.test_text_ops import brute_metrics

pytest.importorskip("public_tokenizers")
TEXT = st.text(st.one_of(st.sampled_from(" \n\t  ab.'1éß日▁\x1c\x85 　,!s"), st.characters(exclude_categories=["Cs"])), max_size=40)
FEW = settings(max_examples=150, deadline=None)


@functools.cache
def encoder():
    return tokenfiles.ChunkEncoder(tokenfiles.default_tokenizer(), cache=300)


@functools.cache
def counter():
    import sentencepiece

    path = tokencounts.default_model()
    return tokencounts.PrefixCounter(path), sentencepiece.SentencePieceProcessor(model_file=path)


@FEW
@given(st.lists(TEXT, max_size=6))
def test_ids_match_the_library(texts):
    got = encoder().encode_all([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [e.ids for e in encoder().tokenizer.encode_batch(texts, add_special_tokens=False)]


@FEW
@given(st.lists(TEXT, max_size=4))
def test_prefix_counts_match_the_library(texts):
    prefixes, model = counter()
    for text, table in zip(texts, prefixes.tables([t.encode() for t in texts]), strict=True):
        assert table.tolist() == [len(model.encode(text[:k])) for k in range(len(text) + 1)]


@FEW
@given(TEXT, TEXT)
def test_turns_round_trip(role, text):
    role = role if role != "assistant" else ""
    turns = [(role, text), ("assistant", text), ("assistant", role), (text if text != "assistant" else "x", role)]
    assert chat.parse_turns("".join(chat.render(r, t) for r, t in turns)) == turns


@FEW
@given(st.lists(st.sampled_from(["a", "b", "#", "é ", "\n", " ", "\x1c", "\x0b"]), max_size=60))
def test_metrics_match_brute_force(parts):
    text = " ".join(parts)
    assert quality.measure(text.encode()) == brute_metrics(text)


@FEW
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.integers(1, 8))
def test_covered_runs(starts, length):
    from tessera.llm import textscan

    starts = np.array([s + 5 for s in starts])
    want = {i for s in starts.tolist() for i in range(s, s + length)}
    assert set(np.flatnonzero(textscan.covered(starts, length, 30)).tolist()) == want

"""Chunks that share a hash, or differ in NUL bytes only, keep lists of their own."""

import numpy as np
import pytest

from tessera.llm import chunks, textscan, tokencounts, tokenfiles

TEXTS = ["x abc y", "x abc\0 y", "x abc\0\0 y", "abc", "abc\0", "\0", "\0\0 a"]


def test_trailing_nul_changes_the_hash():
    hashes = textscan.scan(b"abc abc\0 abc\0\0 \0 \0\0", chunks._SPACE_ONLY)[3]
    assert len(set(hashes.tolist())) == 5


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[::-1]])
@pytest.mark.parametrize("together", [True, False])
def test_token_ids_with_nul(texts, together):
    pytest.importorskip("public_tokenizers")
    encoder = tokenfiles.ChunkEncoder(tokenfiles.default_tokenizer())
    raw = [t.encode() for t in texts]
    got = encoder.encode_all(raw) if together else [encoder.encode_all([r])[0] for r in raw]
    assert [g.tolist() for g in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[::-1]])
def test_prefix_counts_with_nul(texts):
    pytest.importorskip("public_tokenizers")
    got = tokencounts.PrefixCounter(tokencounts.default_model()).tables([t.encode() for t in texts])
    for text, table in zip(texts, got, strict=True):
        alone = tokencounts.PrefixCounter(tokencounts.default_model()).table(text)
        assert table.tolist() == alone.tolist()


def test_a_shared_hash_is_not_an_identity(monkeypatch):
    scan = textscan.scan
    monkeypatch.setattr(textscan, "scan", lambda text, table: (*(found := scan(text, table))[:3], np.ones_like(found[3])))
    table = chunks.ChunkTable(lambda chunk, first: [*chunk.encode()], np.int16, 100, by_place=False)
    assert [None if v is None else v.tolist() for v in table.values([b"ab", b"cd", b"ab ab"])] == [[97, 98], None, [97, 98, 97, 98]]
    assert [None if v is None else v.tolist() for v in table.values([b"abc", b"ab", b"", b"ac"])] == [None, [97, 98], [], None]

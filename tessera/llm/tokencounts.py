"""Token counts (operator 4): the exact count at every prefix of a text.

A prefix's BPE encoding ends in the one token that is compatible with the last
token of the prefix before it (a pair is compatible if encoding its text gives
the pair back), so ``count[i] = count[i - len(token)] + 1`` fills a table from
left to right. Truncation and budget questions then read the table instead of
encoding again.

No piece of the vocabulary has a word-start mark behind another character, so
the table of a text is put together from those of its words, which are cached.

The table is a binary column of big-endian 32-bit counts, for prefixes of 0 to
n characters (code points). Edge cases: a null text is empty, with the single
count 0; repeated rows each get a table; an empty table gives an empty result.
Result columns replace same-named ones, others are dropped but for the id.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import ChunkTable, groups
from tessera.llm.shared import read_table

LIMIT = 4096
#: Bounds of a worker's caches: chunks (about 40 bytes each), token pairs, word stems of ``_STEM`` characters.
_CACHE, _PAIRS, _STEMS, _STEM = 1_500_000, 1_000_000, 100_000, 6
_MARK = "▁"


class PrefixCounter:
    """Prefix tables for a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in normal}
        if any(_MARK in p.lstrip(_MARK) for p in self.rank) or not any(model.is_byte(i) for i in range(model.get_piece_size())):
            raise ValueError("the model must keep words apart and fall back to bytes")
        if model.encode(" ½", out_type=str) != [_MARK * 2, "½"] or model.encode("a", out_type=str) != [_MARK + "a"]:
            raise ValueError("the model must add a word start and normalise nothing else")
        #: Pieces by their characters from the last to the first; under "piece" a
        #: whole one, under "after" the tokens that may stand before it or not.
        self.ends: dict = {}
        for piece in self.rank:
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node["piece"] = piece
        self.n_pairs, self.afters = 0, []
        self.stems: dict[str, tuple[list[str], list[int]]] = {}
        self.chunks = ChunkTable(self._chunk, np.int16, _CACHE, by_place=False)

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-ranked pair first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1)))
            if best[0] == np.inf:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: str, node: dict) -> bool:
        """Whether the token of ``node`` may follow ``left`` ("" at the start)."""
        if self.n_pairs >= _PAIRS:
            for after in self.afters:
                after.clear()
            self.n_pairs = 0
        token, after = node["piece"], node.get("after")
        if after is None:
            after = node["after"] = {}
            self.afters.append(after)
        known = after[left] = self.merge(left + token) == ([left, token] if left else [token])
        self.n_pairs += 1
        return known

    def counts(self, symbols: str) -> list[int]:
        """Counts of the prefixes of 0 to n symbols of a run."""
        n, stem = len(symbols), symbols[:_STEM]
        last, count = self.stems.get(stem, ([""], [0])) if n > _STEM else ([""], [0])
        last, count = list(last), list(count)
        ends, fits = self.ends, self._fits
        for i in range(len(last), n + 1):
            node, k, token = ends, i - 1, None
            while k >= 0:
                node = node.get(symbols[k])
                if node is None:
                    break
                if "piece" in node:
                    left = last[k]
                    fit = node["after"].get(left) if "after" in node else None
                    if fit is None:
                        fit = fits(left, node)
                    if fit:
                        token = node["piece"]
                        break
                k -= 1
            if token is None:  # not in the vocabulary: a token for each byte
                token, k = symbols[i - 1], i - 1
                last.append(token)
                count.append(count[k] + len(token.encode()))
            else:
                last.append(token)
                count.append(count[k] + 1)
            if i == _STEM and n > _STEM:
                if len(self.stems) >= _STEMS:
                    self.stems.clear()
                self.stems[stem] = (last[:], count[:])
        return count

    def _chunk(self, chunk: str, first: bool) -> list[int] | None:
        """A chunk's counts as differences, its word start first."""
        if _MARK in chunk:
            return None
        count = self.counts(_MARK + chunk)
        return [b - a for a, b in zip(count, count[1:])]

    def tables(self, texts: list[bytes]) -> list[np.ndarray]:
        """``table`` of each text, looked up together."""
        out = []
        for text, steps in zip(texts, self.chunks.values(texts), strict=True):
            out.append(self._joined([steps]) if steps is not None and len(steps) else self.table(text.decode()))
        return out

    def _joined(self, steps: list[np.ndarray]) -> np.ndarray:
        out = np.cumsum(np.concatenate(steps), dtype=np.int32)
        out[0] = 0  # the empty text has no word start either
        return out

    def table(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0 to ``len(text)`` characters."""
        if not text:
            return np.zeros(1, np.int32)
        marked = _MARK + text.replace(" ", _MARK)
        return self._joined([np.diff(self.counts(s)) for s in re.findall(f"{_MARK}+[^{_MARK}]*", marked)])


@functools.cache
def counter_for(model_path: str) -> PrefixCounter:
    """One counter per Python worker, so that its caches serve all its tasks."""
    return PrefixCounter(model_path)


def prefix_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_bytes (UTF-8) and ``prefix_counts`` of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, ids, sizes, tables = counter_for(model_path), [], [], []
        schema = None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(sizes, pa.int64()), pa.array(tables, pa.binary())], [schema.field(0).name, "n_bytes", "prefix_counts"])

        for batch in batches:
            schema = batch.schema
            keys = iter(batch.column(0))
            for texts in groups(batch.column(1)):
                ids += [next(keys).as_py() for _ in texts]
                sizes += [len(t) for t in texts]
                tables += [t.astype(">i4").tobytes() for t in counter.tables(texts)]
                yield flush()
                ids, sizes, tables = [], [], []

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, prefix_counts binary")


def n_chars(table: Column) -> Column:
    return (F.octet_length(table) / 4 - 1).cast("int")


def count_at(table: Column, chars: Column | int) -> Column:
    """The token count of the prefix of ``chars`` characters, beyond the end that of the whole text."""
    at = F.least(F.lit(chars) if isinstance(chars, int) else chars, n_chars(table))
    return F.conv(F.hex(F.substring(table, 4 * at + 1, F.lit(4))), 16, 10).cast("long")


def longest_within(table: Column, limit: int) -> Column:
    """The most characters whose encoding has at most ``limit`` tokens. (Counts
    may fall when a character completes a merge, so the last such prefix counts.)"""
    ks = F.sequence(F.lit(0), n_chars(table))
    return F.array_max(F.filter(ks, lambda k: F.conv(F.hex(F.substring(table, 4 * k + 1, F.lit(4))), 16, 10).cast("long") <= limit))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = prefix_counts(read_table(spark, sf_dir, "documents"), default_model())
    whole = tables.withColumn("n_tokens", count_at(F.col("prefix_counts"), n_chars(F.col("prefix_counts"))))
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

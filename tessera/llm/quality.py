"""Adaptive quality rules (operator 8).

Per-document metrics are summarised by mergeable quantile sketches
(``approx_percentile``, a Greenwald-Khanna summary with partial and final
merging) for each (language, source). Upper fences derived from them replace
fixed cutoffs; the fences are joined back and documents beyond one are rejected.

A fence is ``q75 + reach * max(q75 - q25, slack)``: groups whose documents vary
get wide fences, uniform ones narrow fences, and no group loses a fixed share.
A group's quartiles are drawn towards those of its language, and a language's
towards those of all documents, as if ``prior`` more documents had them: a group
of n documents has n / (n + prior) of the say, at every n, without a jump.

The slack is the least spread that a group is granted, so that a group in which
a metric never varies does not lose documents over a trifle. Where quartiles
agree (most texts have no symbols and no repeated lines) the slack decides.

Words: maximal runs without space and 0x09 to 0x0D. Edge cases: a null or empty
text has no words and fails the base rules; null language or source is a group
of its own; repeated rows are judged each; an empty table gives an empty result.
Result columns replace same-named input columns; others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textscan
from tessera.llm.shared import cut, fresh, read_table, without

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
REACH, PRIOR, ACCURACY = 6.0, 100, 10_000
#: Ratios that get a fence, with the least spread that a group is granted.
RATIOS = {"symbol_ratio": 0.01, "dup_line_ratio": 0.1, "repeat_ratio": 0.05, "word_length": 0.5}
#: Broadcast bound for the table of fences, in groups (about 100 bytes each).
MAX_BROADCAST_GROUPS = 50_000
_SYMBOLS = b"#*$%&|<>"
_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def measure(raw: bytes) -> tuple[int, int, int, int, int, int]:
    """The metrics of one text, in the order of ``_FIELDS``."""
    text, starts, ends, words = textscan.scan(raw, textscan.SPACED)
    if not len(words):
        return 0, 0, 0, 0, 0, 0
    data = np.frombuffer(text, np.uint8)
    chars = int(((data & 0xC0) != 0x80).sum() - (data == 32).sum())
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen, lines, dups = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dups += line in seen
            seen.add(line)
    return len(words), chars, symbols, dups, lines, repeated(text, starts, ends, words)


def repeated(text: bytes, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> int:
    """Words in windows that occur twice or more; equal hashes are verified."""
    h = textscan.windows(words, WINDOW)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    by_words: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(hit).tolist():
        key = tuple(text[starts[j] : ends[j]] for j in range(i, i + WINDOW))
        by_words.setdefault(key, []).append(i)
    at = np.array([i for v in by_words.values() if len(v) > 1 for i in v], np.int64)
    return int(textscan.covered(at, WINDOW, len(words)).sum()) if len(at) else 0


def _metrics(texts: pa.Array) -> pa.Array:
    rows = [measure(x.as_py() or b"") for x in texts.cast(pa.binary())]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_FIELDS))], names=_FIELDS)


def metrics(text_col: str) -> Column:
    """A struct of the metrics. Declared non-deterministic only so that the optimiser
    never evaluates it again for a filter or another column."""
    udf = F.arrow_udf(_metrics, f"struct<{','.join(f'{f}:bigint' for f in _FIELDS)}>")
    return udf.asNondeterministic()(F.col(text_col))


def _ratios(m: str = "") -> dict:
    words = F.greatest(F.col(f"{m}n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col(f"{m}n_symbols") / F.greatest(F.col(f"{m}word_chars"), F.lit(1)),
        "dup_line_ratio": F.col(f"{m}n_dup_lines") / F.greatest(F.col(f"{m}n_lines"), F.lit(1)),
        "repeat_ratio": F.col(f"{m}n_repeat_words") / words,
        "word_length": F.col(f"{m}word_chars") / words,
    }


def base_failed(m: str = ""):
    return (F.col(f"{m}n_words") < MIN_WORDS) | (F.lit(100) * F.col(f"{m}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}n_words"))


def fences(measured: DataFrame, *, reach: float = REACH, prior: int = PRIOR, accuracy: int = ACCURACY) -> DataFrame:
    """One row per (lang, source) with its fences, from the sketches of the
    documents that pass the base rules."""
    passed = measured.where(~base_failed()).select("lang", "source", *[c.alias(k) for k, c in _ratios().items()])
    quartiles = [F.percentile_approx(k, F.lit([0.25, 0.75]), accuracy).alias(k) for k in RATIOS]
    levels = cut(passed.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *quartiles), "quality-levels")
    # Groups without a passing document have nothing to fence.
    total = levels.where("level = 3").first()
    if total is None:
        return levels.select("lang", "source", *[F.lit(None).cast("double").alias(f"max_{k}") for k in RATIOS]).limit(0)

    def drawn(n: Column, own: Column, parent: Column) -> Column:
        return (n * own + prior * parent) / (n + prior)

    fine = levels.where("level = 0").drop("level")
    language = levels.where("level = 1").select(F.col("lang").alias("l2"), F.col("n").alias("n2"), F.struct(*RATIOS).alias("q2"))
    joined = fine.join(language, F.col("lang").eqNullSafe(F.col("l2")))
    upper = []
    for k, slack in RATIOS.items():
        low, high = (drawn(F.col("n"), F.col(k)[i], drawn(F.col("n2"), F.col(f"q2.{k}")[i], F.lit(total[k][i]))) for i in (0, 1))
        upper.append((high + reach * F.greatest(high - low, F.lit(slack))).alias(f"max_{k}"))
    return joined.select("lang", "source", *upper)


def _verdict(measured: DataFrame, limits: DataFrame, m: str, kept: str) -> DataFrame:
    """``measured`` with ``kept``: the base rules, then the joined fences."""
    own = fresh(measured, "fence")
    bounds = limits.select(F.col("lang").alias(f"{own}_l"), F.col("source").alias(f"{own}_s"), *[F.col(f"max_{k}").alias(f"{own}_{k}") for k in RATIOS])
    if bounds.count() <= MAX_BROADCAST_GROUPS:
        bounds = F.broadcast(bounds)
    joined = measured.join(bounds, F.col("lang").eqNullSafe(F.col(f"{own}_l")) & F.col("source").eqNullSafe(F.col(f"{own}_s")), "left")
    beyond = F.lit(False)
    for k, c in _ratios(m).items():
        beyond = beyond | F.coalesce(c > F.col(f"{own}_{k}"), F.lit(False))
    return joined.withColumn(kept, ~base_failed(m) & ~beyond).drop(*bounds.columns)


def judge(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the text, with the metrics, base_failed and kept."""
    m = fresh(docs, "metrics")
    rest = without(docs, *_FIELDS, "base_failed", "kept").withColumn(m, metrics(text_col)).drop(text_col)
    measured = cut(rest.select(*[F.col(f"`{c}`") for c in rest.columns if c != m], f"{m}.*"), "quality")
    judged = _verdict(measured, cut(fences(measured, **options), "quality-fences"), "", "kept")
    return judged.withColumn("base_failed", base_failed())


def keep(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that pass, with their columns. Texts are measured twice
    rather than shuffled: once for the sketches, once beside the fences."""
    measured = docs.select("lang", "source", metrics(text_col).alias("m")).select("lang", "source", "m.*")
    limits = cut(fences(measured, **options), "quality-fences")
    m = fresh(docs, "metrics")
    kept = f"{m}_kept"
    return _verdict(docs.withColumn(m, metrics(text_col)), limits, f"{m}.", kept).where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_ONE = "(f.n * f.q{k}[{i}] + 100 * ((l.n * l.q{k}[{i}] + 100 * e.q{k}[{i}]) / (l.n + 100))) / (f.n + 100)"
_DRAWN = ", ".join(f"[{_ONE.format(k=k, i=1)}, {_ONE.format(k=k, i=2)}] AS q{k}" for k in range(1, 5))
ORACLE = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r > 1) AS n_dup_lines FROM ln GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS r1, n_dup_lines / greatest(n_lines, 1) AS r2,
    n_repeat_words / greatest(n_words, 1) AS r3, word_chars / greatest(n_words, 1) AS r4 FROM m),
q AS (
  SELECT lang, source, grouping(lang, source) AS level, count(*) AS n, quantile_disc(r1, [0.25, 0.75]) AS q1, quantile_disc(r2, [0.25, 0.75]) AS q2, quantile_disc(r3, [0.25, 0.75]) AS q3, quantile_disc(r4, [0.25, 0.75]) AS q4
  FROM b WHERE NOT base_failed GROUP BY ROLLUP (lang, source)),
p AS (
  SELECT f.lang, f.source, {drawn}
  FROM q f JOIN q l ON f.level = 0 AND l.level = 1 AND f.lang IS NOT DISTINCT FROM l.lang JOIN q e ON e.level = 3)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(r1 > q1[2] + 6 * greatest(q1[2] - q1[1], 0.01), false) OR coalesce(r2 > q2[2] + 6 * greatest(q2[2] - q2[1], 0.1), false)
    OR coalesce(r3 > q3[2] + 6 * greatest(q3[2] - q3[1], 0.05), false) OR coalesce(r4 > q4[2] + 6 * greatest(q4[2] - q4[1], 0.5), false)) AS kept
FROM b LEFT JOIN p ON b.lang IS NOT DISTINCT FROM p.lang AND b.source IS NOT DISTINCT FROM p.source
""".replace("{drawn}", _DRAWN)

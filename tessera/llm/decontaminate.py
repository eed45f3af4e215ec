"""Benchmark decontamination (operator 1).

A hash set of the benchmark's word windows is broadcast; every document's
windows are probed against it, each hit is verified word by word, and hit spans
or whole documents can be removed.

Words: A-Z lower-cased, maximal runs of ASCII letters, digits and non-ASCII
characters. A window is ``n`` consecutive words of an item; an item with fewer
words, but at least one, is a single window of all its words.

What is broadcast at once is bounded by ``block_bytes`` of the built window set.
Items are normalised and cut into pieces that overlap by ``n - 1`` words, so no
window is lost and a long item is spread over blocks; equal (id, text) rows
count once. A larger benchmark has a pass over the documents for each block: a
pass writes only the rows' keys and hits, and is written before the next block
is fetched, so neither driver nor workers hold two blocks.

Edge cases: a null or empty text has no words and no hits; a null or wordless
item has no window; an item without an id marks words and contaminates, but the
list and number of items leave it out; ids keep their type; an empty benchmark
leaves all documents clean; an empty documents table gives an empty result. A
single window of more than ``block_bytes`` is a block of its own. Other columns
pass through, except that result columns replace same-named ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tessera.llm import textscan
from tessera.llm.shared import cut, fresh, read_table, without

N = 10
#: Bound of a block, in bytes of the window set that is built of it.
BLOCK_BYTES = 64 << 20
#: Bytes that a word adds to a window set beside its own letters, and a piece.
_PER_WORD, _PER_PIECE = 32, 128
_SPAN = "array<struct<a:bigint,b:bigint>>"


class WindowSet:
    """The windows of one block of pieces, in arrays: by length in words the
    sorted hashes, each window's place in the block's text, and its owners."""

    def __init__(self, pieces: list[tuple[object, bytes]], n: int):
        #: Owners by number; None has no name.
        self.ids = list(dict.fromkeys(i for i, _ in pieces))
        number = {i: k for k, i in enumerate(self.ids)}
        self.text = b"\n".join(raw for _, raw in pieces)
        _, starts, ends, words = textscan.scan(self.text, textscan.ALNUM)
        begins = np.cumsum([0, *(len(raw) + 1 for _, raw in pieces)])
        first = np.searchsorted(starts, begins)
        sizes = np.diff(first)
        owner = np.array([number[i] for i, _ in pieces], np.int32)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        #: length in words: hashes, places (begin, end), first owner and owners.
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for k in np.unique(np.minimum(sizes[sizes > 0], n)).tolist():
            mine = sizes >= n if k == n else sizes == k
            h = textscan.windows(words, k)
            at = np.flatnonzero(mine[piece[: len(h)]] & (piece[: len(h)] == piece[k - 1 :])) if len(h) else np.zeros(0, np.int64)
            self.by_length[k] = self._distinct(h[at], starts[at], ends[at + k - 1], owner[piece[at]])

    def _distinct(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each window once, with its owners; windows that only share a hash stay apart."""
        order = np.lexsort((owner, h))
        h, begin, end, owner = h[order], begin[order], end[order], owner[order]
        same = np.flatnonzero(h[1:] == h[:-1]) + 1
        #: The row that a row's window is first seen in.
        of = np.arange(len(h))
        seen: dict[bytes, int] = {}
        run = -1
        for i in same.tolist():
            if run != int(h[i]):
                run, seen = int(h[i]), {self.text[begin[i - 1] : end[i - 1]]: i - 1}
            of[i] = seen.setdefault(self.text[begin[i] : end[i]], i)
        order = np.lexsort((owner, of))
        of, owner = of[order], owner[order]
        keep = np.ones(len(of), bool)
        keep[1:] = (of[1:] != of[:-1]) | (owner[1:] != owner[:-1])
        of, owner = of[keep], owner[keep]
        rows, low = np.unique(of, return_index=True)
        return h[rows], begin[rows], end[rows], np.append(low, len(of)), owner

    def probe(self, raw: bytes) -> tuple[int, list[tuple[int, int]], list, list[tuple[int, int]]]:
        """Word count, merged hit runs in words, numbers of the items found, and the runs' byte spans."""
        text, starts, ends, words = textscan.scan(raw, textscan.ALNUM)
        runs, found = [], set()
        for k, (known, begin, end, low, owner) in self.by_length.items():
            h = textscan.windows(words, k)
            if not len(h) or not len(known):
                continue
            a = np.searchsorted(known, h)
            a[a == len(known)] = 0
            for i in np.flatnonzero(known[a] == h).tolist():
                window = b" ".join(text[starts[j] : ends[j]] for j in range(i, i + k))
                j = int(a[i])
                while j < len(known) and known[j] == h[i]:
                    if self.text[begin[j] : end[j]] == window:
                        runs.append((i, i + k))
                        found.update(owner[low[j] : low[j + 1]].tolist())
                    j += 1
        merged = merge(runs)
        return len(words), merged, sorted(found), [(int(starts[a]), int(ends[b - 1])) for a, b in merged]


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs with overlapping or touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan_type(id_type: DataType) -> str:
    return f"struct<n_words:bigint,words:{_SPAN},bytes:{_SPAN},items:array<{id_type.simpleString()}>>"


_ARROW_SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _spans(runs: list[tuple[int, int]]) -> list[dict]:
    return [{"a": a, "b": b} for a, b in runs]


def _probe(shared, id_type: DataType) -> Column:
    """An Arrow UDF from the text to what one block finds in it."""
    arrow = to_arrow_type(id_type)

    def probe(texts: pa.Array) -> pa.Array:
        windows, rows = shared.value, []
        for raw in texts.cast(pa.binary()):
            n, runs, found, spans = windows.probe(raw.as_py() or b"")
            items = sorted(windows.ids[i] for i in found if windows.ids[i] is not None)
            rows.append({"n_words": n, "words": _spans(runs), "bytes": _spans(spans), "items": items})
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("words", _ARROW_SPAN), ("bytes", _ARROW_SPAN), ("items", pa.list_(arrow))]))

    return F.arrow_udf(probe, _scan_type(id_type))


def _merged(spans: str) -> Column:
    def merged(column: pa.Array) -> pa.Array:
        return pa.array([_spans(merge([(r["a"], r["b"]) for r in row])) if row is not None else None for row in column.to_pylist()], _ARROW_SPAN)

    return F.arrow_udf(merged, _SPAN)(spans)


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, n: int, block_bytes: int) -> DataFrame:
    """Distinct (id, piece, cost): normalised texts, long ones cut so that a piece
    costs at most an eighth of a block, or holds one window."""
    most = max(1, block_bytes // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw in enumerate(batch.column(1).cast(pa.binary())):
                text, starts, ends, _ = textscan.scan(raw.as_py() or b"", textscan.ALNUM)
                if not len(starts):
                    continue
                cost = np.concatenate(([0], np.cumsum(ends - starts + _PER_WORD)))
                a = 0
                while True:
                    b = min(len(starts), max(a + n, int(np.searchsorted(cost, cost[a] + most, side="right")) - 1))
                    piece = b" ".join(text[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([piece], pa.binary()), pa.array([int(cost[b] - cost[a]) + _PER_PIECE], pa.int64())], ["id", "piece", "cost"])
                    if b == len(starts):
                        break
                    a = b - n + 1

    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    return cut(items.mapInArrow(run, f"id {benchmark.schema[id_col].dataType.simpleString()}, piece binary, cost long").distinct(), "benchmark")


def _blocks(pieces: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The pieces in blocks of at most ``block_bytes``. Costs are summed on the
    cluster first; a block is fetched only when its cost is known."""
    total, rows = pieces.agg(F.sum("cost"), F.count("*")).first()
    n = max(1, -(-(total or 0) // block_bytes))
    block = lambda n: F.pmod(F.xxhash64("id", "piece"), F.lit(n))
    while n > 1:
        # Pieces are distinct, so blocks of several get smaller as n grows; one piece is never cut further.
        over = pieces.groupBy(block(n).alias("b")).agg(F.sum("cost").alias("s"), F.count("*").alias("c")).where(f"s > {block_bytes} and c > 1")
        if not over.limit(1).count() or n > 64 * rows:
            break
        n = n * 5 // 4 + 1
    for b in range(n):
        found = (pieces.where(block(n) == b) if n > 1 else pieces).select("id", "piece").collect()
        if found or n == 1:
            yield [(r.id, bytes(r.piece)) for r in found]


def _scanned(docs: DataFrame, benchmark: DataFrame, scan: str, n: int, text_col: str, item_id_col: str, item_text_col: str, block_bytes: int) -> DataFrame:
    """``docs`` with the struct ``scan``: the number of words, and what all blocks found."""
    context, id_type = docs.sparkSession.sparkContext, benchmark.schema[item_id_col].dataType
    blocks = _blocks(_pieces(benchmark, item_id_col, item_text_col, n, block_bytes), block_bytes)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return docs.withColumn(scan, _probe(context.broadcast(WindowSet(block, n)), id_type)(F.col(text_col)))
    key, k = fresh(docs, "key"), "k"
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()), "leaks-docs")
    texts, hits, sizes = keyed.select(F.col(key).alias(k), F.col(text_col).alias("text")), [], None
    while block is not None:
        shared = context.broadcast(WindowSet(block, n))
        found = texts.select(k, _probe(shared, id_type)("text").alias("s")).select(k, "s.*")
        found = cut(found if sizes is None else found.where(F.size("words") > 0), "leaks-pass")
        shared.unpersist()
        sizes = found.select(k, "n_words") if sizes is None else sizes
        hits.append(found.where(F.size("words") > 0).drop("n_words"))
        block, following = following, next(blocks, None)
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    lists = every.groupBy(k).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("words", "bytes", "items")])
    lists = lists.select(k, _merged("words").alias("words"), _merged("bytes").alias("bytes"), F.array_sort(F.array_distinct("items")).alias("items"))
    joined = sizes.join(lists, k, "left")
    filled = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("words", _SPAN), ("bytes", _SPAN), ("items", f"array<{id_type.simpleString()}>"))]
    scans = joined.select(F.col(k).alias(f"{key}k"), F.struct("n_words", *filled).alias(scan))
    return keyed.join(scans, F.col(key) == F.col(f"{key}k")).drop(key, f"{key}k")


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = N, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit (words in hit windows), n_items, items (ids),
    hit_spans (byte spans [a, b) in the UTF-8 text) and contaminated."""
    scan = fresh(docs, "scan")
    found = _scanned(docs, benchmark, scan, n, text_col, item_id_col, item_text_col, block_bytes)
    hit = F.aggregate(f"{scan}.words", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    added = {
        "n_words": F.col(f"{scan}.n_words"), "n_hit": hit, "n_items": F.size(f"{scan}.items").cast("long"),
        "items": F.col(f"{scan}.items"), "hit_spans": F.col(f"{scan}.bytes"), "contaminated": F.size(f"{scan}.words") > 0,
    }
    return without(found, *(c for c in added if c != text_col)).withColumns(added).drop(scan)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", n: int = N, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its contaminated documents (``mode="documents"``) or
    without the hit spans of their texts (``mode="spans"``; a space replaces each)."""
    scan = fresh(docs, "scan")
    found = _scanned(docs, benchmark, scan, n, text_col, item_id_col, item_text_col, block_bytes)
    if mode == "documents":
        return found.where(F.size(f"{scan}.words") == 0).drop(scan)
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")

    @F.arrow_udf("string")
    def drop_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for raw, cuts in zip(texts.cast(pa.binary()), spans.to_pylist(), strict=True):
            text = raw.as_py()
            if text is not None and cuts:
                edges = [0, *(x for c in cuts for x in (c["a"], c["b"])), len(text)]
                text = b" ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append(text)
        return pa.array(out, pa.binary()).cast(pa.string())

    return found.withColumn(text_col, drop_spans(F.col(text_col), F.col(f"{scan}.bytes"))).drop(scan)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 10) AS k FROM iw WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM il)),
ks AS (SELECT DISTINCT k FROM items),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, dg.k, item_id FROM dg JOIN items USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

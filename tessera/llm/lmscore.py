"""LM scoring with a log-frequency Bloom filter (operator 5).

Bigram counts of the training documents are gathered over the whole corpus and
quantised to logarithmic levels; a Bloom filter holds each bigram once for every
level up to its own. The filter is broadcast, a count is read by probing level
after level until one is missing, and interpolated bigram probabilities with
Dirichlet smoothing over add-one unigrams follow from the counts so read.

Unigram counts are kept exactly, beside the filter: the base score asks for them.
A level stands for its least count and a history for its exact one, and an n-gram
is read as no more frequent than its parts, so the probabilities of all words
after a history sum to 1 at most, but for the filter's false positives.

Counts meet by hash buckets of n-grams, so a frequent token is spread over the
buckets of its n-grams. Tasks send sorted, packed lists for each bucket, a bucket
at a time is merged and its part of the filter built with bits in proportion to
its entries; the number of buckets follows the size of the corpus. What is
broadcast at once is bounded by ``segment_bytes``: a larger model is dealt into
segments of buckets with a pass each. A pass writes rows' keys and two packed
columns of what its segment knows, never the texts, and is written before the
next begins.

Where Hadoop has no native library it starts a process or more for each file that
it writes, and until such a process has loaded its program it counts with the whole
memory of its JVM once again. So the model is persisted on the executors' disks by
Spark, without files of Hadoop, and is computed again where an executor is lost;
only a model of several segments is written to the shared folder, where a segment
is read without the others. The query's rows go to few files.

Tokens: A-Z lower-cased runs without space and 0x09 to 0x0D, then one end token.
Tokens and n-grams are identified by 64-bit hashes. Edge cases: a null or empty
text is the end token alone; a null doc_id counts as empty text for the fold and
so trains; repeated rows each train and are scored; without training documents
every count is 0; an empty table gives an empty result. Result columns replace
same-named ones, others pass through.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textscan
from tessera.llm.shared import cut, fresh, read_table, without

FOLDS, HELD_OUT = 7, 2
#: A bucket is for about so many bytes of input; their number is a power of two within these bounds.
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 1 << 20, 4, 18
PROBES, BITS_PER_ENTRY, LEVEL_BASE = 5, 9, 2.0
#: Words' worth of the unigram distribution added to a history's followers; held-out documents score best near it.
MU = 200.0
SEGMENT_BYTES = 160 << 20
#: Buckets for a task that builds filters; bytes of a model that are fetched at a time.
TASK_BUCKETS, FETCH_BYTES = 4, 8 << 20
#: The query's rows go to a file for about so many bytes of input.
FILE_BYTES = 64 << 20
_END, _START = np.uint64(0x51ED270B9F3F4E21), np.uint64(0x2545F4914F6CDD1D)
_LEVEL, _STEP = 0xA0761D6478BD642F, np.uint64(0xE7037ED1A0B428DB)
_FLUSH, _CHUNK = 2_000_000, 300_000
_UNI, _PAIR = 0, 1
_U = np.uint64


def tokens(raw: bytes) -> np.ndarray:
    return np.concatenate((textscan.scan(raw, textscan.SPACED_LOWER)[3], [_END]))


def bigrams(found: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it (the start before the first)."""
    before = np.concatenate(([_START], found[:-1]))
    return textscan.mix(before * _U(0xD6E8FEB86659FD93) + found)


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Unsigned numbers byte plane by byte plane, without the planes that are all zero."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return width, values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def pack(low: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct numbers, as steps, with their counts."""
    steps = low.copy()
    steps[1:] -= low[:-1]
    (a, first), (b, second) = _planes(steps), _planes(counts)
    return struct.pack("<IBB", len(low), a, b) + first + second


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, a, b = struct.unpack_from("<IBB", blob)
    out = []
    for width, at in ((a, 6), (b, 6 + a * n)):
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(blob, np.uint8, width * n, at).reshape(width, n).T
        out.append(full.reshape(-1).view("<u8"))
    return np.cumsum(out[0], dtype=_U), out[1].astype(np.int64)


def _count(bits: int):
    """Texts to packed partial counts (bucket, kind, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (_UNI, _PAIR):
                h, c = np.unique(np.concatenate([x[kind] for x in held]), return_counts=True)
                bucket, low = (h >> _U(64 - bits)).astype(np.int32), h & _U((1 << 64 - bits) - 1)
                edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist()
                for at in range(0, len(edges) - 1, 500):
                    runs = list(zip(edges[at : at + 500], edges[at + 1 : at + 501]))
                    blobs = [pack(low[a:b], c[a:b]) for a, b in runs]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[[a for a, _ in runs]]), pa.array(np.full(len(runs), kind, np.int8)), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                found = tokens(text.as_py() or b"")
                held.append((found, bigrams(found)))
                size += len(found)
                if size >= _FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_base(count))."""
    return (np.floor(np.log(counts) / np.log(LEVEL_BASE) + 1e-9) + 1).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The least of a level's counts, 0 for level 0."""
    return np.where(levels > 0, np.ceil(LEVEL_BASE ** (levels.astype(np.float64) - 1)), 0.0)


def _positions(keys: np.ndarray, level: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Bit positions, one probe after the other, within ``bits`` bits each."""
    x = textscan.mix(keys + _U(level * _LEVEL & 0xFFFFFFFFFFFFFFFF))
    step = textscan.mix(x ^ _STEP) | _U(1)
    for _ in range(PROBES):
        yield ((x >> _U(32)) * bits) >> _U(32)
        x = x + step


def _merged(blobs: list[bytes], bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and summed counts of a bucket's blobs of one kind."""
    if not blobs:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h, c = (np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True))
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first] + _U(bucket << 64 - bits), np.add.reduceat(c, first)


def _filter(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits that hold every key once for each level up to its count's."""
    if not len(keys):
        return b""
    levels = level_of(counts)
    size = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 8) * 8)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max()) + 1):
        for at in _positions(keys[levels >= level], level, _U(size)):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype("<u4" if not len(counts) or counts.max() < 1 << 32 else "<u8")


def _counts(hashes: bytes, counts: bytes) -> np.ndarray:
    """A bucket's counts, of 32 bits or of 64, one for each hash."""
    return np.frombuffer(counts, "<u4" if 2 * len(counts) == len(hashes) else "<u8")


def _build(bits: int):
    """Packed counts in the order of buckets to a row for each bucket."""

    def close(bucket: int, blobs: tuple[list, list]) -> pa.RecordBatch:
        (h, c), pairs = (_merged(b, bucket, bits) for b in blobs)
        values = [bucket, bits, _filter(*pairs), h.astype("<u8").tobytes(), _narrow(c).tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["bucket", "of", "bits", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            for bucket, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != now:
                    if now is not None:
                        yield close(now, held)
                    now, held = bucket, ([], [])
                held[kind].append(blob.as_py())
        if now is not None:
            yield close(now, held)

    return run


def _planned_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bucket_bits(df: DataFrame) -> int:
    """How many bits of a hash tell its bucket, from the planner's size of ``df``."""
    return min(MOST_BITS, max(LEAST_BITS, (_planned_bytes(df) // BUCKET_BYTES).bit_length()))


def train(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The model of a corpus: a row for each bucket (of 2 ** ``of``) with its filter
    bits and its unigrams' sorted hashes and exact counts. It is computed when first
    read and then stays on the executors' disks until it is unpersisted."""
    texts = texts.select(text_col)
    bits = bucket_bits(texts)
    partial = texts.mapInArrow(_count(bits), "bucket int, kind tinyint, blob binary")
    spark = texts.sparkSession
    # Cached plans keep the number they begin with, so a small corpus gets no more tasks than it has use for.
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, (1 << bits) // TASK_BUCKETS))
    dealt = partial.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_build(bits), "bucket int, of int, bits binary, hashes binary, counts binary").persist(StorageLevel.DISK_ONLY)


class Segment:
    """Buckets ``low`` to ``high`` (exclusive) of a model of 2 ** ``of`` buckets, in memory."""

    def __init__(self, low: int, high: int, of: int, rows):
        sizes, parts, hashes, counts = np.zeros(high - low, np.int64), [], [], []
        for r in rows:  # in the order of buckets
            sizes[r["bucket"] - low] = len(r["bits"])
            parts.append(r["bits"])
            hashes.append(r["hashes"])
            counts.append(_counts(r["hashes"], r["counts"]))
        numbers = np.concatenate(counts) if counts else np.zeros(0, "<u4")
        counts.clear()
        numbers = numbers.dtype.str, numbers.tobytes()
        hashes = b"".join(hashes)
        data = b"".join(parts)
        self.__setstate__((low, high, of, sizes, data, hashes, *numbers))

    def __getstate__(self) -> tuple:
        return self._state

    def __setstate__(self, state: tuple) -> None:
        """From plain bytes, so that neither sending nor receiving copies an array."""
        self._state = state
        self.low, self.high, self.of, sizes, data, hashes, kind, counts = state
        self.data, self.hashes, self.counts = np.frombuffer(data, np.uint8), np.frombuffer(hashes, "<u8"), np.frombuffer(counts, kind)
        self.starts, self.bits = (np.cumsum(sizes) - sizes) * 8, (sizes * 8).astype(_U)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> _U(64 - self.of)).astype(np.int64)

    def mine(self, keys: np.ndarray) -> np.ndarray:
        """Which keys belong to this segment."""
        if self.high - self.low == 1 << self.of:
            return np.arange(len(keys))
        bucket = self._bucket(keys)
        return np.flatnonzero((bucket >= self.low) & (bucket < self.high))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many levels of each key the filter holds, by probing upwards."""
        out = np.zeros(len(keys), np.uint8)
        at = self._bucket(keys) - self.low
        open_keys = np.flatnonzero(self.bits[at] > 0)
        for level in range(1, 200):
            if not len(open_keys):
                break
            k, where = keys[open_keys], at[open_keys]
            alive = np.arange(len(open_keys))
            start, bits = self.starts[where], self.bits[where]
            for p in _positions(k, level, bits):
                spot = start[alive] + p[alive].astype(np.int64)
                alive = alive[(self.data[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
                if not len(alive):
                    break
            open_keys = open_keys[alive]
            out[open_keys] = level
        return out

    def exact(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.hashes, keys)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == keys, self.counts[at], 0).astype(np.int64)


def segments(model: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> Iterator[tuple[bool, Segment]]:
    """The model in segments of at most ``segment_bytes`` (or one bucket), each with
    whether it is the whole; every segment is sized before it is fetched. A model of
    several that is persisted is written once and unpersisted."""
    size = F.octet_length("bits") + F.octet_length("hashes") + F.octet_length("counts")
    listed = model.select("bucket", "of", size.cast("long").alias("b")).collect()  # at most 2**MOST_BITS rows
    sizes, of = {r.bucket: r.b for r in listed}, listed[0].of if listed else 0
    low = held = 0
    bounds = []
    for b in range(1 << of):
        if held and held + sizes.get(b, 0) > segment_bytes:
            bounds.append((low, b))
            low, held = b, 0
        held += sizes.get(b, 0)
    if bounds and model.is_cached:
        # Written, it needs neither its persisted copy nor the shuffle that this holds on to.
        persisted, model = model, cut(model, "lm")
        persisted.unpersist()
    for low, high in (every := [*bounds, (low, 1 << of)]):
        held = sum(b for bucket, b in sizes.items() if low <= bucket < high)
        part = model.where((F.col("bucket") >= low) & (F.col("bucket") < high)).coalesce(1 + held // FETCH_BYTES)
        rows = sorted(part.toLocalIterator(), key=lambda r: r["bucket"], reverse=True)
        # Rows are dropped as they are read, so that no part of the model is held three times.
        yield len(every) == 1, Segment(low, high, of, (rows.pop() for _ in range(len(rows))))


def _chunks(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """Token arrays of consecutive texts, about ``_CHUNK`` tokens at a time."""
    held, size = [], 0
    for text in texts.cast(pa.binary()):
        held.append(tokens(text.as_py() or b""))
        size += len(held[-1])
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _known(segment: Segment, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exact counts of the tokens and levels of the bigrams, 0 where they are another segment's."""
    found, pairs = np.concatenate(held), np.concatenate([bigrams(h) for h in held])
    unique, back = np.unique(found, return_inverse=True)
    counts, levels = np.zeros(len(unique), np.int64), np.zeros(len(pairs), np.uint8)
    at = segment.mine(unique)
    counts[at] = segment.exact(unique[at])
    at = segment.mine(pairs)
    levels[at] = segment.levels(pairs[at])
    return counts[back], levels


def log10_probabilities(counts: np.ndarray, levels: np.ndarray, heads: np.ndarray, n_train: int, vocabulary: int, mu: float = MU) -> np.ndarray:
    """Per token of texts that begin at ``heads``, from its exact count and its bigram's level."""
    before = np.concatenate(([0], counts[:-1])).astype(np.float64)
    # A text begins as often as one ends.
    before[heads] = counts[np.concatenate((heads[1:], [len(counts)])) - 1]
    pair = np.minimum(count_of(levels), np.minimum(before, counts))
    single = (counts + 1) / (n_train + vocabulary + 1)
    return np.log10((pair + mu * single) / (before + mu))


_RESULT = "struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>"


def _results(parts: list[tuple], n_train: int, vocabulary: int, mu: float) -> pa.StructArray:
    """From (counts, levels, heads) of runs of texts."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for counts, levels, heads in parts:
        n = np.diff(np.append(heads, len(counts)))
        columns[0].append(n)
        columns[1].append(np.add.reduceat((counts > 0).astype(np.int64), heads))
        columns[2].append(np.add.reduceat(np.log10(counts + 1.0), heads) - n * np.log10(n_train + vocabulary + 1.0))
        columns[3].append(np.add.reduceat(log10_probabilities(counts, levels, heads, n_train, vocabulary, mu), heads))
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    arrays = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds, strict=True)]
    return pa.StructArray.from_arrays(arrays, names=["n_tokens", "n_known", "base_score", "score"])


def _heads(held: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *map(len, held[:-1])])


def _score(shared, n_train: int, vocabulary: int, mu: float):
    """An Arrow UDF from texts to results, for a model of one segment."""

    def score(texts: pa.Array) -> pa.Array:
        done = [_results([(*_known(shared.value, held), _heads(held))], n_train, vocabulary, mu) for held in _chunks(texts)]
        return pa.concat_arrays(done) if done else _results([], n_train, vocabulary, mu)

    return F.arrow_udf(score, _RESULT)


def _look(shared):
    """An Arrow UDF from texts to what one segment knows of them, packed."""

    def look(texts: pa.Array) -> pa.Array:
        out = []
        for held in _chunks(texts):
            counts, levels = _known(shared.value, held)
            edges = [*_heads(held).tolist(), len(counts)]
            out += [zlib.compress(counts[a:b].astype("<i8").tobytes() + levels[a:b].tobytes(), 1) for a, b in zip(edges, edges[1:])]
        return pa.array(out, pa.binary())

    return F.arrow_udf(look, "binary")


def _join(n_train: int, vocabulary: int, mu: float):
    """An Arrow UDF from all segments' packed columns of a text to its results.
    A token belongs to one segment and so does a bigram, and others say 0."""

    def join(packed: pa.Array) -> pa.Array:
        parts = []
        for row in packed:
            counts = levels = 0
            for blob in row.as_py():
                raw = zlib.decompress(blob)
                n = len(raw) // 9
                counts = counts + np.frombuffer(raw, "<i8", n)
                levels = levels + np.frombuffer(raw, np.uint8, n, 8 * n)
            parts.append((counts, levels, np.zeros(1, np.int64)))
        return _results(parts, n_train, vocabulary, mu)

    return F.arrow_udf(join, _RESULT)


def held_out(id_col: str = "doc_id", folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def score(docs: DataFrame, model: DataFrame, *, text_col: str = "text", mu: float = MU, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score."""
    context = docs.sparkSession.sparkContext
    totals = model.select("hashes", "counts").mapInArrow(_sum_counts, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    numbers = (totals[1] or 0, totals[0] or 0, mu)
    lm, key, passes, keyed = fresh(docs, "lm"), fresh(docs, "key"), [], None
    for whole, segment in segments(model, segment_bytes):
        shared = context.broadcast(segment)
        if whole:
            out = docs.withColumn(lm, _score(shared, *numbers)(F.col(text_col)))
            break
        keyed = keyed or cut(docs.withColumn(key, F.monotonically_increasing_id()), "lm-docs")
        passes.append(cut(keyed.select(F.col(key).alias("k"), _look(shared)(F.col(text_col)).alias("s")), "lm-pass"))
        shared.unpersist()
    else:
        every = passes[0]
        for more in passes[1:]:
            every = every.union(more)
        # A row for each segment; a token's zeros elsewhere pack to next to nothing.
        found = every.groupBy(F.col("k").alias(f"{key}k")).agg(F.collect_list("s").alias("s"))
        found = found.select(f"{key}k", _join(*numbers)("s").alias(lm))
        out = keyed.join(found, F.col(key) == F.col(f"{key}k")).drop(key, f"{key}k")
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    added = {c: F.lit(numbers[0]).cast("long") if c == "train_tokens" else F.col(lm)[c] for c in names}
    return without(out, *(c for c in names if c != text_col)).withColumns(added).drop(lm)


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [(h.as_py(), c.as_py()) for h, c in zip(batch.column(0), batch.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([len(h) // 8 for h, _ in held], pa.int64()), pa.array([int(_counts(h, c).sum()) for h, c in held], pa.int64())], ["v", "n"])


def op5_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    model = train(docs.where("not held_out"))
    try:
        scored = score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    finally:
        model.unpersist()
    return scored.repartition(max(spark.sparkContext.defaultParallelism, _planned_bytes(docs) // FILE_BYTES))

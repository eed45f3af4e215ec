"""Token-ID / binary output (operator 10).

Documents are range-partitioned and sorted by doc_id, encoded, and each
partition becomes one shard of three flat files: token ids (unsigned 16 bit where
the vocabulary fits, else 32 bit, little-endian), 64-bit document offsets in
tokens (one more than documents), and 64-bit doc_ids with validity bytes. A shard's base in
the whole sequence is the prefix sum of the shards before it. Readers memory-map
local files and fetch others by range.

Tasks write under names of their own and only shards that the manifest lists
count, so retried and speculative tasks do no harm.

Encoding is the tokenizer's own, whole texts, each text followed by ``end_id``.
Byte-level pre-tokenisation never joins across a single space between two
non-space characters, so texts are encoded chunk by chunk with a cache; chunks
next to other white space are encoded together.

Edge cases: a null text is empty and yields the end id alone; a null doc_id
sorts first and reads back as null; equal doc_ids are ordered by a hash of the
text and keep all rows; an empty table gives no shards and an empty result;
other columns are not written.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.chunks import ChunkTable, groups
from tessera.llm.shared import cut, read_table, work_dir

END_ID = 0
#: Chunks kept by an encoder, about 30 bytes each.
_CACHE = 2_500_000
_SHARDS = "part int, name string, n_docs long, n_tokens long"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if
    it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class ChunkEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library.

    Chunks between single spaces are looked up in a ``ChunkTable``; the library
    encodes what is new. Texts with chunks that touch other white space, or with
    several spaces in a row, are glued where needed and encoded by the library.
    """

    def __init__(self, path: str, cache: int = _CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        pre = json.loads(self.tokenizer.to_str())
        kind = pre.get("pre_tokenizer") or {}
        self.apart = kind.get("type") == "ByteLevel" and kind.get("use_regex", False) and not kind.get("add_prefix_space") and not pre.get("normalizer") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in pre["added_tokens"])
        self.plain = self.apart and not any(t["content"].rstrip(".,;:!?").isalpha() for t in pre["added_tokens"])
        self.letters = _byte_letters()
        self.table = ChunkTable(self._chunk, self.kind, cache, by_place=True)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        mapped = "".join([self.letters[b] for b in word.encode()]) if not word.isascii() else self.letters[32] + word[1:] if word[0] == " " else word
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def _chunk(self, chunk: str, first: bool) -> list[int] | None:
        """A chunk's ids, None if it can't be encoded apart from its neighbours."""
        if chunk[0].isspace() or chunk[-1].isspace():
            return None
        core = chunk.rstrip(".,;:!?")
        # Letters and then punctuation are one pre-token each.
        if self.plain and core.isalpha() and max(core) < "\u0530":
            ids = self._word(core if first else " " + core)
            return ids + self._word(chunk[len(core) :]) if len(core) < len(chunk) else ids
        return self._library([chunk if first else " " + chunk])[0]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, looked up together."""
        if not self.apart:
            return [np.array(i, self.kind) for i in self._library([t.decode() for t in texts])]
        return [self._glued(t.decode()) if v is None else v for t, v in zip(texts, self.table.values(texts), strict=True)]

    def _glued(self, text: str) -> np.ndarray:
        """Chunks that touch other white space, or stand beside an empty one, are
        encoded together with their neighbours."""
        chunks = text.split(" ")
        apart = [bool(c) and not c[0].isspace() and not c[-1].isspace() for c in chunks]
        out, begin, n = [], 0, len(chunks)
        for i in range(1, n + 1):
            if i == n or apart[i] and apart[i - 1]:
                out.append(" " * bool(begin) + " ".join(chunks[begin:i]))
                begin = i
        parts = self._library(out)
        return np.concatenate([np.array(p, self.kind) for p in parts])

    def encode(self, text: str) -> bytes:
        return self.encode_all([text.encode()])[0].tobytes()


@functools.cache
def encoder_for(path: str) -> ChunkEncoder:
    """One encoder per Python worker, so that its cache serves all its tasks."""
    return ChunkEncoder(path)


def _writer(root: str, tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), None
        store, base = pafs.FileSystem.from_uri(root)
        encoder = encoder_for(tokenizer_path)
        end = np.array([end_id], encoder.kind).tobytes()
        lengths, ids, valid, stream = [], [], [], None
        for batch in batches:
            if stream is None:
                name = f"shard-{part:06d}-{uuid.uuid4().hex}"
                stream = store.open_output_stream(f"{base}/{name}.ids")
            ids += batch.column(0).fill_null(0).to_pylist()
            valid += batch.column(0).is_valid().to_pylist()
            for texts in groups(batch.column(1)):
                found = encoder.encode_all(texts)
                lengths += [len(x) + 1 for x in found]
                stream.write(b"".join(x.tobytes() + end for x in found))
        if stream is not None:
            stream.close()
            offsets = np.zeros(len(lengths) + 1, "<u8")
            np.cumsum(lengths, out=offsets[1:])
            for kind, data in (("idx", offsets.tobytes()), ("doc", np.array(ids, "<i8").tobytes() + np.array(valid, "u1").tobytes())):
                with store.open_output_stream(f"{base}/{name}.{kind}") as f:
                    f.write(data)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": [len(lengths)], "n_tokens": [int(offsets[-1])]})

    return write


def write_tokens(docs: DataFrame, tokenizer_path: str, *, root: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the files and ``manifest.json``; returns the folder's URI."""
    spark = docs.sparkSession
    root = root or work_dir(spark, "tokens")
    store, base = pafs.FileSystem.from_uri(root)
    store.create_dir(base)
    # The row's number lets equal rows lie in several partitions.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = cut(dealt.select("doc_id", "text").mapInArrow(_writer(root, tokenizer_path, end_id), _SHARDS), "token-shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    kind = ChunkEncoder(tokenizer_path).kind
    manifest = {"dtype": kind.str, "end_id": end_id, "shards": [r.asDict() for r in shards.orderBy("part").collect()]}
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return root


class Shard:
    """One shard's arrays; local files are memory-mapped, others fetched by range."""

    def __init__(self, root: str, name: str, dtype: str):
        self.store, base = pafs.FileSystem.from_uri(root)
        self.path, self.dtype = f"{base}/{name}", np.dtype(dtype)
        self.local = isinstance(self.store, pafs.LocalFileSystem)
        self.offsets = np.frombuffer(self._all("idx"), "<u8")
        raw = self._all("doc")
        n = len(self.offsets) - 1
        self.doc_ids, self.valid = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.file = pa.memory_map(f"{self.path}.ids") if self.local else self.store.open_input_file(f"{self.path}.ids")

    def _all(self, kind: str) -> bytes:
        with self.store.open_input_file(f"{self.path}.{kind}") as f:
            return f.read()

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        self.file.seek(a * self.dtype.itemsize)
        return np.frombuffer(self.file.read_buffer((b - a) * self.dtype.itemsize), self.dtype)


def read_manifest(root: str) -> dict:
    store, base = pafs.FileSystem.from_uri(root)
    with store.open_input_file(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def read_tokens(spark: SparkSession, root: str, *, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 (of the ids as
    32-bit little-endian), and on request the ids."""
    manifest = read_manifest(root)
    dtype, columns = manifest["dtype"], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    shards = spark.createDataFrame([(s["part"], s["name"], s["base"]) for s in manifest["shards"]], "part int, name string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(root, row["name"], dtype)
                for at in range(0, len(shard.doc_ids), 2000 if not with_ids else 200):
                    rows = range(at, min(at + (2000 if not with_ids else 200), len(shard.doc_ids)))
                    ids = [shard.ids(i).astype("<u4") for i in rows] if with_ids else None
                    out = {
                        "doc_id": pa.array(shard.doc_ids[at : rows.stop], mask=~shard.valid[at : rows.stop]), "start": pa.array(row["base"] + shard.offsets[at : rows.stop].astype("i8")),
                        "n_tokens": pa.array(np.diff(shard.offsets[at : rows.stop + 1]).astype("i8")), "ids_crc32": pa.array([zlib.crc32((ids[i - at] if with_ids else shard.ids(i).astype("<u4")).tobytes()) for i in rows], pa.int64()),
                    }
                    yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    return shards.repartition(max(1, len(manifest["shards"]))).mapInArrow(read, columns)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(read_table(spark, sf_dir, "documents"), default_tokenizer()))

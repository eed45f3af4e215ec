"""N-gram Jaccard join by MinHash banding (operator 3).

1. Every document's set of word n-grams gets a digest and a MinHash signature
   in bands; band and row counts follow from the target recall.
2. Documents with the same set are one class; the rest works on classes.
3. A shuffle on band hashes finds each bucket's hub, its smallest class. A hub
   with all classes that meet it in some bucket is a candidate group, so classes
   that share a bucket share a group, and chains of buckets don't grow together.
4. Within a group pairs are verified on their full n-gram sets. Two classes may
   share several groups; their link is counted in that of their smallest common
   hub only. Classes of a large group are dealt into blocks, a task holds two
   blocks, and a tile of block against block is counted by matrix products, so
   neither pairs nor whole groups are ever rows of one task. A group whose
   classes mostly meet a smaller hub anyway compares only the others with all,
   so a crowd of near copies is compared about once, not once a hub.
5. Link counts are summed; the links' spanning forests are joined to final
   classes by connected components. Classes are numbered, and all shuffles but
   those of texts are of numbers.

Words: A-Z lower-cased, maximal runs of ASCII letters, digits and non-ASCII
characters. A document of fewer than ``n`` words, but at least one, has one
n-gram of all its words. Similarity is exact for the sets; n-grams are
identified by 64-bit hashes.

Edge cases: documents without words (null, empty) are linked to nothing and are
classes of their own; repeated rows and exact copies are links of each other; a
null doc_id takes part, and a class takes its smallest non-null doc_id as class
id (null if it has none); an empty table gives an empty result. Other columns
are not part of the result; ``one_per_group`` keeps them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textscan
from tessera.llm.components import components
from tessera.llm.shared import cut, fresh, read_table, release

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 200
#: A block of a candidate group: at most about so many classes, and n-grams.
BLOCK_CLASSES, BLOCK_GRAMS = 256, 2_000_000
_COLUMNS = 1 << 13


def choose_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """Bands and rows that find a pair at the threshold with the given
    probability: the most rows (fewest false candidates) within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit))) if hit < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
        elif best:
            break
    if best is None:
        raise ValueError("no bands and rows reach the recall with so few hashes")
    return best


def grams(raw: bytes, n: int = N) -> np.ndarray:
    """The sorted set of n-gram hashes of a text."""
    words = textscan.scan(raw, textscan.ALNUM)[3]
    return np.unique(textscan.windows(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


class Signer:
    def __init__(self, bands: int, rows: int):
        draw = np.random.default_rng(0x5EED)
        self.bands, self.rows = bands, rows
        self.factors = (draw.integers(0, 1 << 31, bands * rows).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
        self.weights = draw.integers(0, 1 << 62, rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = draw.integers(0, 1 << 62, bands).astype(np.uint64)

    def sign(self, found: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band."""
        low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(found), 2048):
            part = self.factors[:, None] * low[None, at : at + 2048]
            part += high[None, at : at + 2048]
            np.minimum(least, part.min(axis=1), out=least)
        return textscan.mix((least.reshape(self.bands, self.rows).astype(np.uint64) * self.weights).sum(axis=1) + self.salt)


def signatures(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, digest of the n-gram set (null without words), its size and band hashes."""
    kind = docs.schema[id_col].dataType.simpleString()
    bands, rows = choose_bands(threshold, recall, MOST_HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            digests, sizes, hashes = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                found = grams(text.as_py() or b"", n)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sizes.append(len(found))
                hashes.append(signer.sign(found).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "text_hash", "digest", "n_grams", "bands"])

    rows_in = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows_in.mapInArrow(run, f"doc_id {kind}, text_hash long, digest binary, n_grams long, bands array<long>")


def _met(classes: DataFrame) -> DataFrame:
    """(hub, cls): the classes that share a bucket with others, with each such
    bucket's smallest class. Band hashes are salted by band, so the hash is the bucket."""
    banded = classes.select("cls", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("cls").alias("hub"), F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("b"), "hub")
    return banded.join(hubs, F.col("bucket") == F.col("b")).select("hub", "cls").distinct()


def _tiles(rows: DataFrame) -> DataFrame:
    """``rows`` (hub, cls, low, n_grams, ...) with their block and one row for each
    tile (hub, block_a, block_b) that they take part in.

    ``low`` is a class's smallest hub. Of the classes of a group those with the
    most frequent ``low``, if that is another group's hub, are compared there with
    each other; here their blocks (numbers below kp) only meet the others' (kq)."""
    def blocks(n, grams):
        return F.greatest(F.ceil(n / BLOCK_CLASSES), F.ceil(grams / BLOCK_GRAMS)).cast("int")

    parts = rows.groupBy("hub", "low").agg(F.count("*").alias("n"), F.sum("n_grams").alias("g"))
    groups = parts.groupBy("hub").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.max(F.struct("n", "g", "low")).alias("most"))
    apart = F.col("most.low") != F.col("hub")
    p, pg = (F.when(apart, F.col(f"most.{c}")).otherwise(F.lit(0)) for c in ("n", "g"))
    one = blocks(F.col("n"), F.col("g")) <= 1
    kp = F.when(one, F.lit(0)).otherwise(blocks(p, pg))
    kq = F.when(p == F.col("n"), F.lit(0)).when(one, F.lit(1)).otherwise(blocks(F.col("n") - p, F.col("g") - pg))
    plans = groups.select(F.col("hub").alias("h"), F.when(apart, F.col("most.low")).alias("mode"), kp.alias("kp"), kq.alias("kq")).where("kq > 0")
    dealt = rows.join(plans, F.col("hub") == F.col("h")).drop("h")
    settled = (F.col("kp") > 0) & F.col("low").eqNullSafe(F.col("mode"))
    deal = F.xxhash64("cls")
    dealt = dealt.withColumn("block", F.when(settled, F.pmod(deal, F.col("kp"))).otherwise(F.col("kp") + F.pmod(deal, F.col("kq"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(settled, F.col("kp")).otherwise(F.lit(0)), F.col("kp") + F.col("kq") - 1)))
    return dealt.withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")}).drop("other", "kp", "kq", "mode")


def links_between(sets: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """The boolean matrix of pairs of sets with Jaccard similarity of at least the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64)))) if len(column) else column
    both = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (at, at + _COLUMNS))
        part = np.zeros((len(sets), min(_COLUMNS, int(column[b - 1]) - at + 1)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    p, q = threshold.numerator, threshold.denominator
    out = both * (p + q) >= p * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(out, False)
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest index it reaches."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            frontier = np.array([i])
            root[i] = i
            while len(frontier):
                frontier = np.flatnonzero(linked[frontier].any(axis=0) & (root < 0))
                root[frontier] = i
    return root


_TILE = ["hub", "block_a", "block_b"]


def counted_here(hub: int, hubs: list[list[int]]) -> np.ndarray:
    """The boolean matrix of pairs of classes that share no hub below ``hub``."""
    column = {h: i for i, h in enumerate({h for own in hubs for h in own if h < hub})}
    meets = np.zeros((len(hubs), len(column)), np.float32)
    for i, own in enumerate(hubs):
        meets[i, [column[h] for h in own if h < hub]] = 1
    return meets @ meets.T == 0


def _verify(n: int, threshold: Fraction):
    def tile(key: tuple, members: dict[int, tuple]) -> Iterator[tuple]:
        if len(members) < 2:
            return
        classes = sorted(members)
        here = counted_here(key[0], [members[c][2] for c in classes])
        blocks = np.array([members[c][1] for c in classes])
        if key[1] != key[2]:
            here &= blocks[:, None] != blocks[None, :]
        np.fill_diagonal(here, False)
        # Classes without a pair to count here are not compared.
        busy = np.flatnonzero(here.any(axis=1))
        if not len(busy):
            return
        classes, here = [classes[i] for i in busy.tolist()], here[np.ix_(busy, busy)]
        linked = links_between([grams(members[c][3], n) for c in classes], threshold) & here
        copies = np.array([members[c][0] for c in classes], np.int64)
        for i, r in enumerate(roots(linked).tolist()):
            if linked[i].any():
                yield classes[i], int(copies[linked[i]].sum()), classes[r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, {}, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["cls", "links", "root"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            texts = batch.column(7).cast(pa.binary())
            for i, (hub, a, b, cls, copies, block, hubs) in enumerate(zip(*columns, strict=True)):
                if (hub, a, b) != key:
                    out.extend(tile(key, members))
                    key, members = (hub, a, b), {}
                    if len(out) > 5000:
                        yield flush()
                        out = []
                if cls not in members:
                    members[cls] = (copies, block, hubs, texts[i].as_py())
        out.extend(tile(key, members))
        if out:
            yield flush()

    return run


def _linked_classes(docs: DataFrame, signed: DataFrame, *, n: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Per class: digest, copies, first (the least document of its group) and n_links."""
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = signed.where("digest is not null").groupBy("digest", "n_grams").agg(F.min(who).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "jaccard-classes")
    met = cut(_met(classes), "jaccard-met")
    own = met.groupBy(F.col("cls").alias("c")).agg(F.collect_set("hub").alias("hubs"), F.min("hub").alias("low"))  # at most one hub a band
    members = cut(own.join(classes.select("cls", "n_grams", "copies", "rep"), F.col("c") == F.col("cls")).drop("cls"), "jaccard-members")
    rows = cut(met.join(members, F.col("cls") == F.col("c")).drop("c"), "jaccard-groups")
    tiled = _tiles(rows).select(*_TILE, "cls", "copies", "block", "hubs", "rep")
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    with_text = text.join(tiled, F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_hash") == F.col("rep.text_hash")))
    dealt = with_text.select(*_TILE, "cls", "copies", "block", "hubs", "text").repartition(*_TILE).sortWithinPartitions(*_TILE)
    ratio = Fraction(str(threshold))
    verified = cut(dealt.mapInArrow(_verify(n, ratio), "cls long, links long, root long"), "jaccard-links")
    release(met, members, rows)
    links = verified.groupBy(F.col("cls").alias("l")).agg(F.sum("links").alias("links"))
    labels = components(verified.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    joined = classes.select("cls", "digest", "copies", "rep").join(links, F.col("cls") == F.col("l"), "left").join(labels, F.col("cls") == F.col("node"), "left")
    joined = cut(joined.select("digest", "copies", "rep", "links", F.coalesce("label", "cls").alias("label")), "jaccard-labels")
    release(classes, verified)
    firsts = joined.groupBy(F.col("label").alias("f")).agg(F.min("rep").alias("first"))
    return joined.join(firsts, F.col("label") == F.col("f")).select("digest", "copies", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def jaccard_join(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of the documents that
    links connect), n_links (documents at the threshold or above) and n_copies
    (documents with the same set, itself included)."""
    signed = cut(signatures(docs, n=n, threshold=threshold, recall=recall, id_col=id_col, text_col=text_col), "jaccard-signed")
    classes = cut(_linked_classes(docs, signed, n=n, threshold=threshold, id_col=id_col, text_col=text_col), "jaccard-result").withColumnRenamed("digest", "d")
    joined = signed.select("doc_id", "digest").join(classes, F.col("digest") == F.col("d"), "left")
    alone = F.col("d").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def one_per_group(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of linked documents: the one with
    the least doc_id. Documents without words all stay."""
    signed = cut(signatures(docs, n=n, threshold=threshold, recall=recall, id_col=id_col, text_col=text_col), "jaccard-signed")
    classes = _linked_classes(docs, signed, n=n, threshold=threshold, id_col=id_col, text_col=text_col)
    repeated = signed.where("digest is not null").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0
    wordless = signed.where("digest is null").select("doc_id", "text_hash")
    own = fresh(docs, "stay")
    stay = cut(classes.select("first.doc_id", "first.text_hash").distinct().union(wordless).distinct(), "jaccard-stay").select(F.col("doc_id").alias(f"{own}_i"), F.col("text_hash").alias(f"{own}_h"))
    release(signed)
    keyed = docs.withColumn(own, F.xxhash64(text_col))
    kept = keyed.join(stay, F.col(id_col).eqNullSafe(F.col(f"{own}_i")) & (F.col(own) == F.col(f"{own}_h")), "left_semi")
    if repeated:
        from pyspark.sql import Window

        same = Window.partitionBy(id_col, own).orderBy(own)
        wordy = F.coalesce(F.col(text_col).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
        nth = f"{own}_n"
        kept = kept.withColumn(nth, F.row_number().over(same)).where((F.col(nth) == 1) | ~wordy).drop(nth)
    return kept.drop(own)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))


#: Brute force over shared n-grams; meant for the small tables that check it.
ORACLE = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
l AS (SELECT doc_id, w, least(len(w), 5) AS k FROM w WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM l)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, least(d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id)) AS class_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links,
  1 + (SELECT count(*) FROM links WHERE a = d.doc_id AND same) AS n_copies FROM documents d
"""

"""Mixing sources to target weights (operator 2), native DataFrame operations only.

Every document of a source gets the same expected number of copies, the
source's target over its size. The whole part is taken outright; the fractional
parts are settled by pivotal dependent rounding. Two documents meet, and mass
(in words) moves from one to the other, at random in either direction with the
odds that keep both expectations, until one of them has probability 0 or 1. The
sum of words is kept at every step, so a source's taken words miss its target
by at most half of the last document left, which goes to the nearer side (that
one document's expectation is not kept, all others' are).

The pairing runs as a reduction tree: documents are dealt into chunks of about
``CHUNK`` by a hash, a chunk is folded in one task with a bounded array, and its
single undecided document goes on to the next level, until each source has one.

A unit is all rows with equal doc_id, source and size; its rows share the
unit's copies as evenly as can be, so repeated rows and repeated or null ids are
settled together. Sources rank by code point, null last. Null or wordless texts
have size 0 and are taken zero times over in words (their copies are the whole
part of the rate). A source of size 0 has target 0. An empty table gives an
empty result. Other columns pass through ``mix``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import WORD, cut, fresh, read_table, unit

SHARE, WEIGHTS, CAP = 1.5, (3, 1, 2), 2.0
CHUNK, SEED = 48, 20_240_607
#: Broadcast bound for the table of sources, in rows (about 60 bytes each).
MAX_BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """The size of a text: its words, 0 for null. Each word is written as one
    letter and the letters counted, as a regexp_count would hold an array of all
    words of a text at once."""
    marks = F.translate(F.regexp_replace(text, f"{WORD}+", "w"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, share: float = SHARE, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: source_size and target.

    Water filling in closed form: in order of cap over weight, sources are full
    until the level that the rest can share lies below their cap. Only the
    table of sources, one row each, is sorted in one task.
    """
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    by = by.withColumns({"full": cap * F.col("source_size"), "total": share * F.sum("source_size").over(every)})
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("level", (F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    by = by.withColumn("is_full", F.col("weight") * F.col("level") >= F.col("full"))
    by = by.withColumn("at", F.when(~F.col("is_full"), F.row_number().over(order)))
    level = F.min_by("level", "at").over(every)  # the first source that isn't full
    return by.select("source", "source_size", F.when(F.col("is_full"), F.col("full")).otherwise(F.col("weight") * level).alias("target"))


def _meet(state: Column, other: Column, level: int) -> Column:
    """One pivotal step: of the open document and the next, one becomes integral
    and joins ``done``; the other stays open."""
    c, e = state["open"], other
    mass_c, mass_e = c["p"] * c["size"], e["p"] * e["size"]
    room_c, room_e = (1 - c["p"]) * c["size"], (1 - e["p"]) * e["size"]
    up, down = F.least(room_c, mass_e), F.least(mass_c, room_e)
    rises = unit(F.lit(SEED), F.lit(level), c["doc_id"], c["size"], e["doc_id"], e["size"]) * (up + down) < down
    c_settled = F.when(rises, room_c <= mass_e).otherwise(mass_c <= room_e)
    c_p = F.when(rises, F.when(room_c <= mass_e, F.lit(1.0)).otherwise(c["p"] + up / c["size"])).otherwise(F.when(mass_c <= room_e, F.lit(0.0)).otherwise(c["p"] - down / c["size"]))
    e_p = F.when(rises, F.when(room_c <= mass_e, (mass_e - up) / e["size"]).otherwise(F.lit(0.0))).otherwise(F.when(mass_c <= room_e, e["p"] + down / e["size"]).otherwise(F.lit(1.0)))

    def at(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.alias("p"), x["m"].alias("m"), x["extra"].alias("extra"))

    new_c, new_e = at(c, c_p), at(e, e_p)
    return F.struct(F.when(c_settled, new_e).otherwise(new_c).alias("open"), F.concat(state["done"], F.array(F.when(c_settled, new_c).otherwise(new_e))).alias("done"))


def _level(open_docs: DataFrame, level: int, chunks: int) -> DataFrame:
    """Settle all but one document of every chunk; ``settled`` tells which."""
    chunk = F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), "doc_id", "size"), F.lit(chunks))
    item = F.struct((-F.col("size")).alias("k"), F.xxhash64(F.lit(SEED), F.lit(-1 - level), "doc_id").alias("h"), F.struct("doc_id", "size", "p", "m", "extra").alias("d"))
    grouped = open_docs.groupBy("source", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("a")).select("source", F.transform("a", lambda x: x["d"]).alias("a"))
    first = F.element_at("a", 1)
    start = F.struct(first.alias("open"), F.slice("a", 1, 0).alias("done"))
    folded = grouped.withColumn("s", F.aggregate(F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0))), start, lambda s, x: _meet(s, x, level)))
    tagged = F.concat(F.transform("s.done", lambda d: F.struct(d.alias("d"), F.lit(True).alias("settled"))), F.array(F.struct(F.col("s.open").alias("d"), F.lit(False).alias("settled"))))
    return folded.select("source", F.inline(tagged)).select("source", "d.*", "settled")


def plan(sizes: DataFrame, **options) -> DataFrame:
    """Units (doc_id, source, size, m rows) with source_size, target, ``whole``
    copies for each row and ``extra`` single copies for the unit's rows to share."""
    units = cut(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-units")
    targets = cut(source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size")), **options), "mix-targets")
    n_sources = targets.count()
    side = targets.withColumnRenamed("source", "__s")
    side = F.broadcast(side) if n_sources <= MAX_BROADCAST_SOURCES else side
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = units.join(side, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("rate", rate)
    rated = rated.withColumn("whole", F.floor("rate").cast("long")).withColumn("share", F.col("m") * (F.col("rate") - F.col("whole")))
    rated = rated.withColumn("extra", F.floor("share").cast("long")).withColumn("p", F.col("share") - F.col("extra"))
    rated = rated.select("source", "doc_id", "size", "p", "m", "extra")
    undecided = (F.col("p") > 0) & (F.col("size") > 0)
    settled = [rated.where(~undecided).withColumn("p", F.lit(0.0))]
    open_docs = rated.where(undecided)
    most = open_docs.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    level = 0
    while most:
        chunks = -(-most // CHUNK)
        done = cut(_level(open_docs, level, chunks), f"mix-level{level}")
        settled.append(done.where("settled").drop("settled"))
        open_docs = done.where("not settled").drop("settled")
        level, most = level + 1, chunks if chunks > 1 else 0
    settled.append(open_docs.withColumn("p", F.when(F.col("p") >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))))
    units = reduce(DataFrame.unionByName, settled).withColumn("extra", F.col("extra") + F.col("p").cast("long")).drop("p")
    units = units.join(side, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return units.withColumn("whole", F.floor(rate).cast("long"))


def mix(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The mixture: each document's row as many times as it was taken."""
    key = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")]
    units = cut(plan(docs.select(*key), **options), "mix-plan")
    repeated = units.where("m > 1").limit(1).count() > 0
    own = fresh(docs, "mix")
    k, u, whole, extra, n, copies = (f"{own}_{x}" for x in ("k", "u", "whole", "extra", "n", "copies"))
    taken = units.select(F.struct("doc_id", "source", "size").alias(u), F.col("whole").alias(whole), F.col("extra").alias(extra))
    rows = docs.withColumn(k, F.struct(*key))
    # Rows that still tie are equal in every column, so it doesn't matter which is first.
    every = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])
    nth = F.row_number().over(Window.partitionBy(k).orderBy(F.xxhash64(text_col), every)) if repeated else F.lit(1)
    # The plan has a row for each document, so it is never broadcast, at any size.
    joined = rows.withColumn(n, nth).join(taken.hint("merge"), F.col(k) == F.col(u))
    joined = joined.withColumn(copies, F.col(whole) + (F.col(n) <= F.col(extra)).cast("long")).where(F.col(copies) > 0)
    return joined.withColumn(own, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    units = plan(docs).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("m"))))
    copies = F.col("whole") + (F.col("n") <= F.col("extra")).cast("long")
    return units.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source")

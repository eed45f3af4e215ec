"""Sharding by size-tiered compaction (operator 7).

``append`` writes arrivals as small immutable Parquet shards. ``compact`` groups
shards into tiers by size and merges a tier once it holds ``fanout`` of them,
into files of up to the target size. Merging shuffles nothing: Spark packs whole
small files into one read partition per output file. Each change commits a new
manifest version by an atomic rename that fails if the version exists, so
readers see a whole version and writers that lose a race start again.

A version's file holds only what it adds and removes; every ``SNAPSHOT_EVERY``
versions a snapshot with the whole list is put beside it, so a commit is as large
as its change and a reader opens one snapshot and a few changes.

Files that no manifest lists (failed or lost attempts) are never read; ``vacuum``
deletes them once they are older than ``ORPHAN_SECONDS``. The commit needs a file
system whose rename is atomic and refuses an existing target (HDFS, local, ABFS);
an object store without it needs a connector that adds conditional puts.

Edge cases: an empty arrival commits a version without new shards; nulls,
repeated rows and any columns are kept as they are; an arrival whose column names
or types (in their order, nullability apart) are not the store's is refused with
``SchemaMismatch`` before anything is written; one row larger than the target
makes a larger file.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.shared import read_table, work_dir

TARGET_BYTES, SMALLEST_BYTES, FANOUT = 128 << 20, 1 << 20, 4
ROWS_PER_SHARD = 2000
SNAPSHOT_EVERY, ORPHAN_SECONDS = 16, 24 * 3600


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


class SchemaMismatch(ValueError):
    """An arrival's columns are not those of the store."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target: int = TARGET_BYTES, smallest: int = SMALLEST_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.smallest, self.fanout = spark, root.rstrip("/"), target, smallest, fanout
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri() if ":" in self.root else self._fs.getUri(), conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _manifests(self, ending: str) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests")))
        return sorted(int(n[:10]) for n in names if n[0] != "." and n.endswith(ending) and n[10:] == ending)

    def versions(self) -> list[int]:
        return self._manifests(".json")

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """A committed version: ``shards`` (path, bytes, rows) and ``schema``."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "shards": []}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"the store has no version {version}")
        snapshots = [v for v in self._manifests(".snapshot") if v <= version]
        state = self._load(f"{snapshots[-1]:010d}.snapshot") if snapshots else {"version": 0, "schema": None, "shards": []}
        shards, schema = {s["path"]: s for s in state["shards"]}, state["schema"]
        for v in range(state["version"] + 1, version + 1):
            change = self._load(f"{v:010d}.json")
            schema = change["schema"]
            for path in change["remove"]:
                del shards[path]
            shards |= {s["path"]: s for s in change["add"]}
        return {"version": version, "schema": schema, "shards": list(shards.values())}

    def _put(self, name: str, content: dict) -> None:
        """A new file under a name that must not exist yet, all of it or nothing."""
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._context.rename(draft, self._path(f"{self.root}/manifests/{name}"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{name} exists") from e
            raise

    def _commit(self, now: dict, schema: dict | None, add: list[dict], remove: list[str]) -> dict:
        """The version after ``now``; raises ``Conflict`` if another writer made one."""
        version, gone = now["version"] + 1, set(remove)
        self._put(f"{version:010d}.json", {"version": version, "schema": schema, "add": add, "remove": remove})
        out = {"version": version, "schema": schema, "shards": [s for s in now["shards"] if s["path"] not in gone] + add}
        if version % SNAPSHOT_EVERY == 0:
            self._snapshot(out)
        return out

    def _snapshot(self, state: dict) -> None:
        try:
            self._put(f"{state['version']:010d}.snapshot", state)
        except Conflict:
            pass  # a version never changes, so another writer's snapshot is the same

    def _written(self, folder: str) -> list[dict]:
        """The shards in a folder. Rows are counted from the files' footers."""
        files = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")}
        if not files:
            return []
        counts = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        rows = {r["f"]: r["count"] for r in counts}
        return [{"path": f"{folder}/{name}", "bytes": size, "rows": rows[name]} for name, size in sorted(files.items()) if rows.get(name)]

    def append(self, arrivals: DataFrame, *, rows_per_shard: int = ROWS_PER_SHARD) -> dict:
        """Commit the arrivals as small shards; refuses columns that are not the store's."""
        self._check(self.manifest()["schema"], arrivals)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", rows_per_shard).parquet(folder)
        new = self._written(folder)
        while True:
            now = self.manifest()
            self._check(now["schema"], arrivals)
            try:
                return self._commit(now, now["schema"] or arrivals.schema.jsonValue(), new, [])
            except Conflict:
                continue

    @staticmethod
    def _check(schema: dict | None, arrivals: DataFrame) -> None:
        if schema is None:
            return
        columns = lambda kind: [(f.name, f.dataType.simpleString()) for f in kind.fields]
        want, got = columns(StructType.fromJson(schema)), columns(arrivals.schema)
        if want != got:
            raise SchemaMismatch(f"the store has {want}, the arrival {got}")

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)) + 1)

    def _merge(self, shards: list[dict], schema: dict) -> list[dict]:
        """Rewrite shards as fewer: whole files are packed up to the target, one
        output file per packed partition. All are read with the store's schema."""
        session = self.spark.newSession()
        for key, value in (("spark.sql.files.maxPartitionBytes", self.target), ("spark.sql.files.openCostInBytes", 1), ("spark.sql.files.minPartitionNum", 1)):
            session.conf.set(key, str(value))
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        session.read.schema(StructType.fromJson(schema)).parquet(*[s["path"] for s in shards]).write.parquet(folder)
        return self._written(folder)

    def compact(self) -> dict:
        """Merge until no tier below the target holds ``fanout`` shards that
        merging would make fewer."""
        stuck: set[int] = set()
        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in now["shards"]:
                if s["bytes"] <= self.target // 2:
                    tiers.setdefault(self.tier(s["bytes"]), []).append(s)
            ready = [t for t, shards in sorted(tiers.items()) if len(shards) >= self.fanout and t not in stuck]
            if not ready:
                return now
            old = tiers[ready[0]]
            new = self._merge(old, now["schema"])
            if len(new) >= len(old):
                stuck.add(ready[0])
                continue
            gone = {s["path"] for s in old}
            while True:
                now = self.manifest()
                listed = {s["path"] for s in now["shards"]}
                if not gone <= listed:
                    break  # another compaction took some of them; leave its version
                try:
                    self._commit(now, now["schema"], new, sorted(gone))
                    break
                except Conflict:
                    continue

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if not found["schema"]:
            raise ValueError("the store has no version")
        schema = StructType.fromJson(found["schema"])
        if not found["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in found["shards"]])

    def vacuum(self, keep: int = 1, orphan_seconds: int = ORPHAN_SECONDS) -> int:
        """Delete all but the last ``keep`` versions, the shards only they listed,
        and files of failed or lost attempts that are older than ``orphan_seconds``."""
        known = self.versions()
        if not known:
            return 0
        first = self.manifest(known[-keep:][0])
        self._snapshot(first)
        live = {s["path"] for s in first["shards"]} | {s["path"] for v in known[-keep:] for s in self._load(f"{v:010d}.json")["add"]}
        dead = {s["path"] for v in known[:-keep] for s in self.manifest(v)["shards"]} - live
        for v in self._manifests(".snapshot"):
            if v < first["version"]:
                self._fs.delete(self._path(f"{self.root}/manifests/{v:010d}.snapshot"), False)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{v:010d}.json"), False)
        names, before = {p.split("/data/", 1)[1] for p in live}, self._jvm.java.lang.System.currentTimeMillis() - orphan_seconds * 1000
        data = self._path(f"{self.root}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for file in self._fs.listStatus(folder.getPath()):
                name = f"{folder.getPath().getName()}/{file.getPath().getName()}"
                if name.endswith(".parquet") and name not in names and file.getModificationTime() < before:
                    dead.add(f"{self.root}/data/{name}")
        for p in dead:
            self._fs.delete(self._path(p), False)
        return len(dead)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two arrivals, through append and compaction, read back
    from the last version: one row per document with its text's digest."""
    docs = read_table(spark, sf_dir, "documents")
    store = ShardStore(spark, work_dir(spark, "shards"))
    for half in range(2):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half))
    store.compact()
    return store.read().select("doc_id", "source", "lang", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


ORACLE = "SELECT doc_id, source, lang, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents"

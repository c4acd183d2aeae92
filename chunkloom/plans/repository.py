"""A store of backups, and the jobs over it: backup, verify, restore, forget, prune, export, import.

A job writes folders of its own and then one commit file, which names every folder of every table: readers take the newest
commit, so a job that dies anywhere changes nothing, and what it left is removed by `recover`. Folders are never changed.
A backup adds folders; forgetting and pruning rewrite only the folders that hold something to drop. One job writes at a time;
a second one finds its commit's number taken and fails.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import scalars as S
from chunkloom.operators import chunking, closure, dedup, manifest, packing, prune, restore, retention, verify
from chunkloom.storage import ship, staged

SCHEMAS = {
    "index": "strong string, pack_no long, store_offset long, chunk_length long",
    "chunks": "pack_no long, store_offset long, strong string, data binary",
    "entries": "backup_id string, object_id long, seq long, volume_offset long, chunk_length long, chunk_hash string, is_excluded boolean",
    "backups": "backup_id string, source string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, timestamp timestamp_ntz, parent_id string, snapshot_id string, total_bytes long, new_chunks long",
}
#: Commits whose folders stay, for readers that are under way.
KEEP = 2


@dataclass
class Repository:
    spark: SparkSession
    path: str
    geometry: chunking.Geometry = chunking.SMALL
    normalizers: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        ship(self.spark)

    # commits

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        fs, at = self._fs(), self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _commits(self) -> list[int]:
        return [int(m[1]) for x in self._list("commits") if (m := re.fullmatch(r"c(\d+)\.json", x))]

    def _load(self, number: int) -> dict:
        stream = self._fs().open(self._at(f"commits/c{number:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> dict:
        """The newest commit. Of each table its folders: of chunks and index with the parts of the store that they hold, of entries with their backups."""
        n = max(self._commits(), default=0)
        return self._load(n) if n else {"number": 0, "next_part": 1, "index": {}, "chunks": {}, "entries": {}, "backups": {}}

    def commit(self, state: dict) -> None:
        """Makes a state the newest, at once: the file appears under its name when it is whole."""
        number = state["number"] + 1
        fs, new, at = self._fs(), self._at(f"commits/.{uuid.uuid4().hex}"), self._at(f"commits/c{number:08d}.json")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(state | {"number": number}).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(new, at):
            raise RuntimeError(f"another job has made commit {number}")

    def recover(self) -> None:
        """Removes folders that none of the last commits names, and older commits."""
        numbers = self._commits()[-KEEP:]
        named = {f for n in numbers for t in SCHEMAS for f in self._load(n)[t]}
        for t in SCHEMAS:
            for x in self._list(t):
                if f"{t}/{x}" not in named:
                    self._fs().delete(self._at(f"{t}/{x}"), True)
        for x in self._list("commits"):
            if x not in {f"c{n:08d}.json" for n in numbers}:
                self._fs().delete(self._at(f"commits/{x}"), False)

    def read(self, name: str, folders: list[str] | None = None) -> DataFrame:
        """A table of the newest commit, or some of its folders; an empty table if there are none."""
        folders = list(self.state()[name]) if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.path}/{f}" for f in folders))

    def write(self, name: str, df: DataFrame) -> str:
        """A new folder of a table, which no commit names yet."""
        folder = f"{name}/{uuid.uuid4().hex}"
        df.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).write.parquet(f"{self.path}/{folder}")
        return folder

    # jobs

    def _store(self, state: dict, new: DataFrame) -> None:
        """Adds chunks (strong, length, data) that the index lacks as a new part; the data is not in any window."""
        part = state["next_part"]
        at = staged(packing.place(new, part, self.geometry.pack), "placed")
        placed = new.select("strong", "data", F.col("length").cast("long").alias("chunk_length")).join(at, "strong")
        state["chunks"][self.write("chunks", placed)] = [part]
        state["index"][self.write("index", placed)] = [part]
        state["next_part"] = part + 1

    def backup(self, objects: DataFrame, backup_id: str, source: str, at, parent_id: str | None = None, snapshot_id: str | None = None) -> DataFrame:
        """Chunks the objects, stores what the index lacks, and commits it with the manifest and metadata. Returns the run's figures."""
        state = self.state()
        if set(sum(state["chunks"].values(), [])) != set(sum(state["index"].values(), [])):
            raise ValueError("chunks without an index: a backup would store them again; rebuild the index first")
        c = staged(chunking.chunk(objects, self.geometry, self.normalizers, with_data=True), "backup-chunks")
        first = dedup.first_occurrence(c)
        new = staged(dedup.against_index(first.where("is_first"), self.read("index")).where("status = 'new'").select("strong", "length", "data"), "backup-new")
        n = new.count()
        if n:
            self._store(state, new)
        e = c.select(F.lit(backup_id).alias("backup_id"), "object_id", F.col("seq").cast("long").alias("seq"), F.col("offset").alias("volume_offset"), F.col("length").cast("long").alias("chunk_length"), F.col("strong").alias("chunk_hash"), F.lit(False).alias("is_excluded"))
        state["entries"][self.write("entries", e)] = [backup_id]
        total = c.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_bytes")).withColumn("new_chunks", F.lit(n).cast("long"))
        ts = F.lit(at).cast("timestamp_ntz")
        meta = total.select(F.lit(backup_id).alias("backup_id"), F.lit(source).alias("source"), F.lit("completed").alias("status"), ts.alias("started_at"), ts.alias("completed_at"), ts.alias("timestamp"), F.lit(parent_id).cast("string").alias("parent_id"), F.lit(snapshot_id).cast("string").alias("snapshot_id"), "total_bytes", "new_chunks")
        state["backups"][self.write("backups", meta)] = []
        self.commit(state)
        return dedup.run_stats(first)

    def verify(self, backup_id: str, percent: float = 100.0, seed: int = 0) -> DataFrame:
        """Every selected entry with its status; damaged chunks show, nothing stops at the first."""
        e = self.read("entries").where(F.col("backup_id") == backup_id)
        e = e.withColumn("idx", F.row_number().over(_manifest_order()) - 1)
        e = verify.sample_entries(e, percent, seed, index="idx")
        chunks, identity = self.read("chunks"), self._identity()
        return verify.verify_entries(e, self.read("index"), chunks.select("pack_no", "store_offset", S.strong_hash(identity).alias("actual_hash"), F.octet_length("data").cast("long").alias("actual_length")))

    def restore(self, backup_id: str) -> DataFrame:
        """object_id, content of a backup; excluded chunks are zeros. A hash that the index lacks, or a chunk that isn't what its name says, is an error."""
        bad = self.verify(backup_id).where("status NOT IN ('ok', 'excluded')")
        if not bad.isEmpty():
            raise ValueError(f"backup {backup_id}: {bad.count()} entries can't be restored")
        e = restore.locate(self.read("entries").where(F.col("backup_id") == backup_id), self.read("index"))
        j = e.join(self.read("chunks").select("pack_no", "store_offset", F.col("strong").alias("chunk_hash"), "data"), ["pack_no", "store_offset", "chunk_hash"], "left")
        piece = F.when(F.col("is_excluded"), F.expr("repeat('00', cast(chunk_length as int))")).otherwise(F.hex("data"))
        parts = F.array_sort(F.collect_list(F.struct("seq", piece.alias("h"))))
        return j.groupBy("object_id").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("content"))

    def forget(self, policy: retention.KeepPolicy, now, dry_run: bool = False) -> DataFrame:
        """backup_id, reasons of what goes (reasons null) and stays. Refuses to delete everything, and while a manifest can't be read; what kept ones refer to stays."""
        state = self.state()
        b = staged(self.read("backups"), "backups")
        ids = b.select(F.col("backup_id").alias("id"))
        lost = b.where("total_bytes > 0").join(self.read("entries").select("backup_id").distinct(), "backup_id", "left_anti")
        if not lost.isEmpty():
            raise ValueError("manifests can't be read, so what they refer to isn't known; nothing was forgotten")
        kept = staged(retention.keep_reasons(b, policy, F.lit(now).cast("timestamp_ntz")), "forget-kept")
        safe, _ = closure.protect(ids, kept.select(F.col("backup_id").alias("id")), closure.reference_edges(b))
        plan = b.select("backup_id", "timestamp").join(safe.withColumnRenamed("id", "backup_id"), "backup_id", "left").join(kept, "backup_id", "left")
        plan = staged(plan.select("backup_id", "timestamp", F.coalesce("reasons", F.when(F.col("depth").isNotNull(), F.concat(F.lit("promoted: referenced by "), "promoted_by", F.lit(" via "), "via"))).alias("reasons")), "forget-plan")
        if plan.where("reasons is not null").isEmpty():
            raise ValueError("the policy would delete every backup")
        if not dry_run:
            stay = plan.where("reasons is not null").select("backup_id")
            gone = {r["backup_id"] for r in plan.where("reasons is null").select("backup_id").collect()}  # names of backups
            old = {f: x for f, x in state["entries"].items() if gone.intersection(x)}
            left = sorted({i for x in old.values() for i in x} - gone)
            state["entries"] = {f: x for f, x in state["entries"].items() if f not in old}
            if left:
                state["entries"][self.write("entries", self.read("entries", list(old)).join(stay, "backup_id", "left_semi"))] = left
            state["backups"] = {self.write("backups", b.join(stay, "backup_id", "left_semi").coalesce(1)): []}
            self.commit(state)
        return plan.orderBy(F.desc("timestamp"), F.desc("backup_id"))

    def prune(self) -> DataFrame:
        """Drops chunks that no manifest names and second copies, by rewriting the folders that hold any; returns the figures."""
        state = self.state()
        classes = staged(prune.classify(self.read("index"), prune.referenced_hashes(self.read("entries"))), "prune")
        part = F.shiftright("pack_no", packing.PART_BITS)
        dead = {r["part"] for r in classes.where("state <> 'live'").select(part.alias("part")).distinct().collect()}  # a part a backup
        live = prune.survivors(classes)
        for name in ("chunks", "index"):
            old = {f: x for f, x in state[name].items() if dead.intersection(x)}
            if old:
                kept = self.read(name, list(old)).join(live.select("pack_no", "store_offset", "strong"), ["pack_no", "store_offset", "strong"], "left_semi")
                state[name] = {f: x for f, x in state[name].items() if f not in old}
                state[name][self.write(name, kept)] = sorted(sum(old.values(), []))
        if dead:
            self.commit(state)
        return prune.stats(classes)

    def export(self, backup_ids: list[str], target: str) -> None:
        """A folder of its own with the backups, all that they refer to, and the chunks they need."""
        b = self.read("backups")
        ids = b.select(F.col("backup_id").alias("id"))
        seen, _ = closure.protect(ids, ids.where(F.col("id").isin(backup_ids)), closure.reference_edges(b))
        seen = staged(seen.select(F.col("id").alias("backup_id")), "export")
        need = restore.export_chunks(seen.select(F.col("backup_id").alias("id")), self.read("entries"))
        self.read("chunks").join(need.withColumnRenamed("chunk_hash", "strong"), "strong", "left_semi").dropDuplicates(["strong"]).write.parquet(f"{target}/chunks")
        self.read("entries").join(seen, "backup_id", "left_semi").write.parquet(f"{target}/entries")
        b.join(seen, "backup_id", "left_semi").write.parquet(f"{target}/backups")

    def import_(self, archive: str) -> DataFrame:
        """Checks every chunk of an archive, adds those that are missing and its backups, in one commit. Returns counts of actions."""
        state = self.state()
        frames = self.spark.read.parquet(f"{archive}/chunks").select("strong", "data", S.strong_hash(self._identity()).alias("actual_hash"))
        plan = staged(restore.import_plan(frames, self.read("index")).join(frames.select("strong", F.octet_length("data").cast("long").alias("length"), "data"), "strong"), "import")
        if not plan.where("action = 'corrupt'").isEmpty():
            raise ValueError("the archive holds damaged chunks; nothing was imported")
        new = plan.where("action = 'append'").select("strong", "length", "data")
        if not new.isEmpty():
            self._store(state, new)
        theirs = staged(self.spark.read.schema(SCHEMAS["backups"]).parquet(f"{archive}/backups").join(self.read("backups").select("backup_id"), "backup_id", "left_anti"), "import-backups")
        ids = sorted(r["backup_id"] for r in theirs.select("backup_id").collect())  # names of backups
        if ids:
            state["entries"][self.write("entries", self.spark.read.schema(SCHEMAS["entries"]).parquet(f"{archive}/entries").join(theirs.select("backup_id"), "backup_id", "left_semi"))] = ids
            state["backups"][self.write("backups", theirs)] = []
        self.commit(state)
        return plan.groupBy("action").agg(F.count("*").alias("n"))

    def _identity(self):
        """The bytes of `data` whose hash is a chunk's name."""
        if not self.normalizers:
            return F.col("data")
        from chunkloom.functions.normalize import normalizer

        return normalizer(list(self.normalizers))(F.col("data"))


def _manifest_order():
    from pyspark.sql import Window as W

    return W.partitionBy("backup_id").orderBy("object_id", "seq")


def unsorted_manifests(repo: Repository) -> DataFrame:
    """Manifests whose entries are out of order."""
    return manifest.unsorted(repo.read("entries")).where("inversions > 0")

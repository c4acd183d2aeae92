"""Restore: byte ranges back from chunks, fetch plans, export and import sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.operators.ranges import overlap_join


def locate(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Entries with their place; `found` is false where the index lacks a hash, which a restore treats as an error."""
    at = index.groupBy("strong").agg(F.min(F.struct("pack_no", "store_offset")).alias("x")).select(F.col("strong").alias("chunk_hash"), "x.pack_no", "x.store_offset")
    return entries.join(at, "chunk_hash", "left").withColumn("found", F.col("pack_no").isNotNull())


def fetch_order(located: DataFrame, partitions: int) -> DataFrame:
    """Pack by pack in storage order: each pack is read once, by one task."""
    return located.repartition(partitions, "pack_no").sortWithinPartitions("pack_no", "store_offset")


def extract(files: DataFrame, chunks: DataFrame, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """path, content, complete: a file's bytes cut out of the chunks that it touches and put together in order.

    files: path, stream_offset, stream_length; chunks: volume_offset, chunk_length, data. complete: the length is right.
    """
    f = files.select(*on, "path", F.col("stream_offset").alias("l_start"), (F.col("stream_offset") + F.col("stream_length")).alias("l_end"))
    c = chunks.select(*on, F.col("volume_offset").alias("r_start"), (F.col("volume_offset") + F.col("chunk_length")).alias("r_end"), "data")
    j = overlap_join(f, c, width, on)
    a, b = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    piece = F.substring("data", (a - F.col("r_start") + 1).cast("int"), (b - a).cast("int"))
    parts = j.select(*on, "path", F.col("r_start").alias("o"), F.hex(piece).alias("h"))
    whole = parts.groupBy(*on, "path").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "")).alias("content"))
    out = files.join(whole, [*on, "path"], "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    return out.select(*on, "path", "content", (F.octet_length("content") == F.col("stream_length")).alias("complete"))


def fetch_plan(entries: DataFrame, index: DataFrame, pack_max: int, fallback: int = 64 << 10) -> DataFrame:
    """pack_no, needed, dense: packs of which so many chunks are needed that fetching them whole is cheaper.

    Dense from max(4, chunks a pack holds / 64) on, by the needed chunks' mean length; excluded and unknown entries don't count.
    """
    at = index.groupBy("strong").agg(F.min("pack_no").alias("pack_no")).withColumnRenamed("strong", "chunk_hash")
    need = entries.where(~F.col("is_excluded")).join(at, "chunk_hash")
    packs = need.groupBy("pack_no").agg(F.count("*").alias("needed"), F.sum("chunk_length").alias("bytes"))
    mean = packs.agg(F.expr("sum(bytes) div sum(needed)").cast("long").alias("mean"))
    limit = mean.select(F.greatest(F.expr(f"{pack_max}L div (CASE WHEN mean > 0 THEN mean ELSE {fallback}L END) div 64"), F.lit(4)).alias("limit"))
    return packs.join(F.broadcast(limit)).select("pack_no", "needed", (F.col("needed") >= F.col("limit")).alias("dense"))  # one row


def export_chunks(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct hashes that a set of backups needs; excluded entries need none."""
    return entries.where(~F.col("is_excluded")).join(ids.select(F.col("id").alias("backup_id")), "backup_id", "left_semi").select("chunk_hash").distinct()


def import_plan(frames: DataFrame, index: DataFrame) -> DataFrame:
    """Each frame of an archive (strong, actual_hash): append, present or corrupt. Nothing is installed while any is corrupt."""
    known = index.select("strong").distinct().withColumn("__k", F.lit(True))
    ok = F.col("actual_hash").eqNullSafe(F.col("strong"))
    return frames.join(known, "strong", "left").select("strong", F.when(~ok, "corrupt").when(F.col("__k"), "present").otherwise("append").alias("action"))

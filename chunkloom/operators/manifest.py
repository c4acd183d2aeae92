"""Manifests: entries (a backup's chunks by volume offset) and files that lie over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.operators.ranges import overlap_join


def ordered_hash(pairs: Column) -> Column:
    """SHA-256 (hex) of the concatenated bytes behind hex strings `h`, in the order of the structs' other fields."""
    return F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["h"]), "")), 256)


def stream_files_hash(files: DataFrame, entries: DataFrame, width: int) -> DataFrame:
    """backup_id, path, content_hash: over the hashes of the entries that a file's stream range touches. Empty files have none."""
    f = files.select("backup_id", "path", F.col("stream_offset").alias("l_start"), (F.col("stream_offset") + F.col("stream_length")).alias("l_end"))
    e = entries.select("backup_id", F.col("volume_offset").alias("r_start"), (F.col("volume_offset") + F.col("chunk_length")).alias("r_end"), "chunk_hash")
    j = overlap_join(f, e, width, ("backup_id",))
    return j.groupBy("backup_id", "path").agg(ordered_hash(F.collect_list(F.struct(F.col("r_start").alias("o"), F.col("chunk_hash").alias("h")))).alias("content_hash"))


def extent_files_hash(files: DataFrame, entries: DataFrame, width: int) -> DataFrame:
    """The same for files of extents, in extent order; an entry that two extents touch counts twice."""
    x = files.select("backup_id", "path", F.posexplode("extents").alias("pos", "x"))
    f = x.select("backup_id", "path", "pos", F.col("x.volume_offset").alias("l_start"), (F.col("x.volume_offset") + F.col("x.length")).alias("l_end"))
    e = entries.select("backup_id", F.col("volume_offset").alias("r_start"), (F.col("volume_offset") + F.col("chunk_length")).alias("r_end"), "chunk_hash")
    j = overlap_join(f, e, width, ("backup_id",))
    return j.groupBy("backup_id", "path").agg(ordered_hash(F.collect_list(F.struct("pos", F.col("r_start").alias("o"), F.col("chunk_hash").alias("h")))).alias("content_hash"))


def stream_digest(chunks: DataFrame, key: str, order: list[str], data: str) -> DataFrame:
    """key and digest: SHA-256 of a stream's pieces in order. For streams that fit a row; larger ones are folded by sources.images."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.hex(data).alias("h"))))
    return chunks.groupBy(key).agg(F.sha2(F.unhex(F.array_join(F.transform(pieces, lambda x: x["h"]), "")), 256).alias("digest"))


def unsorted(entries: DataFrame) -> DataFrame:
    """backup_id and how many entries lie before their predecessor; 0 for sorted manifests."""
    w = W.partitionBy("backup_id").orderBy("seq")
    back = F.col("volume_offset") < F.lag("volume_offset").over(w)
    return entries.withColumn("__b", F.coalesce(back, F.lit(False)).cast("long")).groupBy("backup_id").agg(F.sum("__b").alias("inversions"))


def repaired(entries: DataFrame) -> DataFrame:
    """Entries numbered anew by offset."""
    w = W.partitionBy("backup_id").orderBy("volume_offset", "seq")
    return entries.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))


def chained(parts: list[DataFrame]) -> DataFrame:
    """Several entry lists as one: part and position give a global index `idx`, counted per part first."""
    rows = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("part", F.lit(i)))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    inside = F.row_number().over(W.partitionBy("part").orderBy("seq")) - 1
    return rows.withColumn("__i", inside).join(F.broadcast(sizes), "part").withColumn("idx", (F.col("base") + F.col("__i")).cast("long")).drop("base", "__i", "part")  # one row a part


def find_entries(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each wanted (source_index, path) its catalog row: by both, else the first with the path. catalog: pos, source_index, path, …"""
    first = catalog.groupBy("path").agg(F.min("pos").alias("any_pos"))
    both = catalog.groupBy("source_index", "path").agg(F.min("pos").alias("own_pos"))
    return wanted.join(both, ["source_index", "path"], "left").join(first, "path", "left").select(*wanted.columns, F.coalesce("own_pos", "any_pos").alias("pos"))


def resolve_id(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, matches, backup_id (if it is the only one) and status: found, ambiguous, none."""
    j = prefixes.join(ids, F.col("backup_id").startswith(F.col("prefix")), "left")
    out = j.groupBy("prefix").agg(F.count("backup_id").alias("matches"), F.min("backup_id").alias("one"))
    return out.select("prefix", "matches", F.when(F.col("matches") == 1, F.col("one")).alias("backup_id"), F.when(F.col("matches") == 1, "found").when(F.col("matches") == 0, "none").otherwise("ambiguous").alias("status"))


def unreadable(listed: DataFrame, parsed: DataFrame) -> DataFrame:
    """Ids that are stored but could not be read; any of them stops a deletion."""
    return listed.join(parsed, "backup_id", "left_anti")


def catalog_rows(files: DataFrame) -> DataFrame:
    """A fingerprint of each row of a catalog: order, kind, size and path."""
    return files.select("source_index", "path", F.sha2(F.concat_ws("\n", "source_index", "path", "size", F.col("is_dir").cast("int")).cast("binary"), 256).alias("h"))


def catalog_hash(files: DataFrame) -> DataFrame:
    """One hash of the whole catalog: rows in path order are hashed per source, the sources' hashes once more. Per source a bounded catalog."""
    per = catalog_rows(files).groupBy("source_index").agg(ordered_hash(F.collect_list(F.struct("path", "h"))).alias("h"))
    return per.agg(ordered_hash(F.collect_list(F.struct("source_index", "h"))).alias("catalog_hash"))

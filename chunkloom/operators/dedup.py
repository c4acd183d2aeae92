"""Deduplication: which chunks are new, which are copies, and what a run saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_occurrence(chunks: DataFrame, order: tuple[str, ...] = ("stream_ord", "seq")) -> DataFrame:
    """Adds is_first: whether a chunk is the first of its hash in stream order, the copy that is stored.

    The first place of each hash comes from an aggregate (partial sums first), so a hash that a third of all rows share
    is no hot window; the join back is an equi-join that can be split.
    """
    place = F.struct(*order)
    firsts = chunks.groupBy("strong").agg(F.min(place).alias("__first"))
    return chunks.join(firsts, "strong").withColumn("is_first", F.col("__first") == place).drop("__first")


def against_index(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Adds status: duplicate if the index has the hash, else new. Exact, without a filter's false positives."""
    known = index.select("strong").distinct().withColumn("__known", F.lit(True))
    return chunks.join(known, "strong", "left").withColumn("status", F.when(F.col("__known"), "duplicate").otherwise("new")).drop("__known")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole rounded to 9 digits, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 9))


def run_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """A run's figures, per group of `by`: chunks in all, unique, copies; bytes raw and stored; least, largest and whole-number mean size; ratios.

    chunks: strong, length, is_first. The dedup ratio counts chunks, the compression ratio bytes.
    """
    first = F.col("is_first")
    out = chunks.groupBy(*by).agg(
        F.count("*").alias("total_chunks"),
        F.sum(first.cast("long")).alias("unique_chunks"),
        F.sum((~first).cast("long")).alias("dedup_chunks"),
        F.sum(F.col("length").cast("long")).alias("raw_bytes"),
        F.sum(F.when(first, F.col("length")).otherwise(0).cast("long")).alias("stored_bytes"),
        F.min(F.col("length").cast("long")).alias("min_size"),
        F.max(F.col("length").cast("long")).alias("max_size"),
    )
    out = out.withColumn("avg_size", F.expr("CASE WHEN total_chunks = 0 THEN 0 ELSE raw_bytes div total_chunks END"))
    return out.withColumn("dedup_ratio", ratio(F.col("total_chunks") - F.col("unique_chunks"), F.col("total_chunks"))).withColumn("comp_ratio", ratio(F.col("raw_bytes"), F.col("stored_bytes")))


def analyze(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """What a run would store, without storing: distinct hashes that the index lacks, against all."""
    fresh = F.when(F.col("status") == "new", F.col("strong"))
    return against_index(chunks, index).agg(F.count("*").alias("total_chunks"), F.sum("length").alias("raw_bytes"), F.countDistinct(fresh).alias("new_chunks"))


def changed_chunks(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """backup_id, changed, unchanged: chunks that the parent's manifest lacks or has. parents: (backup_id, parent_id). Exact semi-join."""
    own = entries.select("backup_id", "chunk_hash").distinct().withColumnsRenamed({"backup_id": "parent_id", "chunk_hash": "hash"}).withColumn("known", F.lit(1))
    e = entries.join(parents, "backup_id")
    j = e.join(own, (e.parent_id == own.parent_id) & (e.chunk_hash == own.hash), "left")
    return j.groupBy("backup_id").agg(F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("changed"), F.sum(F.coalesce("known", F.lit(0))).alias("unchanged"))


def next_pack(lengths: list[int], maximum: int) -> list[tuple[int, int]]:
    """(pack, offset) of frames in order: a pack ends when the next frame would exceed the maximum and the pack isn't empty."""
    out, pack, at = [], 0, 0
    for n in lengths:
        if at and at + n > maximum:
            pack, at = pack + 1, 0
        out.append((pack, at))
        at += n
    return out


def newest_first(*keys: Column) -> list[Column]:
    return [k.desc_nulls_last() for k in keys]


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

"""Integrity: every selected entry is looked up, fetched, hashed and measured; all faults are reported with their true index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def verify_entries(entries: DataFrame, index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds status to entries (chunk_hash, chunk_length, is_excluded): ok, excluded, missing-index, fetch-failed, hash-mismatch, length-mismatch.

    index: strong, pack_no, store_offset; chunks: pack_no, store_offset, actual_hash, actual_length (null: unreadable).
    """
    at = index.groupBy("strong").agg(F.min(F.struct("pack_no", "store_offset")).alias("x")).select(F.col("strong").alias("chunk_hash"), F.col("x.pack_no").alias("pack_no"), F.col("x.store_offset").alias("store_offset"), F.lit(True).alias("__i"))
    got = chunks.select("pack_no", "store_offset", "actual_hash", "actual_length", F.lit(True).alias("__c"))
    j = entries.join(at, "chunk_hash", "left").join(got, ["pack_no", "store_offset"], "left")
    status = (
        F.when(F.col("is_excluded"), "excluded")
        .when(F.col("__i").isNull(), "missing-index")
        .when(F.col("__c").isNull() | F.col("actual_hash").isNull(), "fetch-failed")
        .when(F.col("actual_hash") != F.col("chunk_hash"), "hash-mismatch")
        .when(F.col("actual_length") != F.col("chunk_length"), "length-mismatch")
        .otherwise("ok")
    )
    return j.select(*entries.columns, status.alias("status"))


def verdict(recorded: Column, computed: Column, complete: Column) -> Column:
    """A stream digest's verdict; it is only made for complete walks in order."""
    return F.when(~complete, "none").when(F.coalesce(recorded, F.lit("")) == "", "not-verifiable").when(recorded == computed, "match").otherwise("mismatch")


def sample_entries(entries: DataFrame, percent: float, seed: int, by: str = "backup_id", index: str = "seq") -> DataFrame:
    """A sample of ceil(percent % of a backup's entries that aren't excluded), at least one; the same for the same id, percent and seed.

    An entry's key is the start of SHA-256(id, seed, index; both 8 bytes, big-endian); the least keys win, ties to the
    smaller index. 100 keeps all.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be a finite number in (0, 100]")
    pool = entries.where(~F.col("is_excluded")) if "is_excluded" in entries.columns else entries
    eight = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))
    key = F.substring(F.sha2(F.concat(F.col(by).cast("string").cast("binary"), eight(F.lit(seed)), eight(F.col(index))), 256), 1, 16)
    sizes = pool.groupBy(by).agg(F.count("*").alias("__p"))
    ranked = pool.withColumn("__k", F.row_number().over(W.partitionBy(by).orderBy(key, index)))
    take = F.greatest(F.ceil(F.lit(percent) / 100 * F.col("__p")), F.lit(1))
    return ranked.join(sizes, by).where(F.col("__k") <= take).drop("__k", "__p")

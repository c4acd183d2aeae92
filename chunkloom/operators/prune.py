"""Reclaiming: which chunks nothing refers to, which are stored twice, and where the survivors go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("pack_no", "store_offset")


def classify(index: DataFrame, referenced: DataFrame) -> DataFrame:
    """Adds state to index rows: orphan, duplicate (of a referenced hash stored earlier) or live.

    referenced: (strong), distinct or not. The earliest place of a hash comes from an aggregate, not from a window.
    """
    used = referenced.select("strong").distinct().withColumn("__r", F.lit(True))
    first = index.groupBy("strong").agg(F.min(F.struct(*ORDER)).alias("__f"))
    j = index.join(first, "strong").join(used, "strong", "left")
    state = F.when(F.col("__r").isNull(), "orphan").when(F.col("__f") == F.struct(*ORDER), "live").otherwise("duplicate")
    return j.withColumn("state", state).drop("__r", "__f")


def stats(classified: DataFrame) -> DataFrame:
    """Figures of a prune: rows in all, live, orphan, duplicate; bytes reclaimed."""
    n = lambda s: F.sum((F.col("state") == s).cast("long"))
    return classified.agg(
        F.count("*").alias("total"),
        n("live").alias("referenced"),
        n("orphan").alias("orphans"),
        n("duplicate").alias("duplicates"),
        F.sum(F.when(F.col("state") != "live", F.col("chunk_length")).otherwise(0)).alias("bytes_reclaimed"),
    )


def survivors(classified: DataFrame) -> DataFrame:
    return classified.where("state = 'live'").drop("state")


def referenced_hashes(entries: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Hashes that any manifest names - excluded entries too - and those of suspended runs."""
    out = entries.select(F.col("chunk_hash").alias("strong"))
    return (out.unionByName(protected.select("strong")) if protected is not None else out).distinct()

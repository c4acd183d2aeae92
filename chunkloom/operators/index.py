"""The chunk index as a table with deltas: folding, dropping packs, statistics, rebuilding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ("pack_no", "store_offset", "chunk_length")


def fold(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """One row a hash: of the deltas the one with the greatest (delta_name, seq) wins, and any delta over the base.

    base: strong and PLACE; deltas: these, delta_name and seq. max_by-style aggregation, so copies shrink before the shuffle.
    """
    place = F.struct(*PLACE)
    rows = base.select("strong", F.struct(F.lit(0).alias("r"), F.lit(None).cast("string").alias("d"), F.lit(0).cast("long").alias("s"), place.alias("p")).alias("x"))
    more = deltas.select("strong", F.struct(F.lit(1).alias("r"), F.col("delta_name").cast("string").alias("d"), F.col("seq").cast("long").alias("s"), place.alias("p")).alias("x"))
    return rows.unionAll(more).groupBy("strong").agg(F.max("x").alias("x")).select("strong", *(F.col(f"x.p.{c}").alias(c) for c in PLACE))


def drop_packs(index: DataFrame, dropped: DataFrame) -> DataFrame:
    return index.join(dropped.select("pack_no").distinct(), "pack_no", "left_anti").select("strong", *PLACE)


def delta_packs(deltas: DataFrame) -> DataFrame:
    """Each delta's packs, ascending."""
    return deltas.groupBy("delta_name").agg(F.array_sort(F.collect_set("pack_no")).alias("packs"))


def stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("entries"), F.countDistinct("strong").alias("hashes"), F.countDistinct("pack_no").alias("packs"), F.sum("chunk_length").alias("bytes"))


def sorted_index(index: DataFrame, partitions: int) -> DataFrame:
    """The index laid out by hash prefix for writing: ranges of prefixes, sorted within."""
    prefix = F.substring("strong", 1, 16)
    return index.repartitionByRange(partitions, prefix).sortWithinPartitions(prefix, "strong")


def rebuild(frames: DataFrame) -> DataFrame:
    """The index from the stored frames alone: of a hash stored twice the later place wins."""
    return frames.groupBy("strong").agg(F.max(F.struct(*PLACE)).alias("x")).select("strong", "x.*")

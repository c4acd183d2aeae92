"""Assigning chunks to packs in order (next fit), and compaction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.operators.dedup import next_pack

#: Every writer has pack numbers of its own, so writers run side by side.
PACKS_PER_WRITER = 1 << 24
#: Packs that one writer of `place` fills, about; its group holds hashes and sizes only.
PACKS_A_WRITER, PART_BITS = 64, 44
FRAME_HEADER = 8


def assign_packs(chunks: DataFrame, writer: str, order: list[str], maximum: int) -> DataFrame:
    """Adds pack_no and store_offset: a writer's chunks go to packs in order; a pack ends when the next frame would exceed `maximum`.

    A frame is a header of 8 bytes and the payload (`length`). One group a writer; a writer is a unit of parallelism that
    the caller chooses, such as a hash of the stream.
    """
    kinds = dict(chunks.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in chunks.columns] + ["pack_no long", "store_offset long"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order, kind="stable")
        places = next_pack([int(n) + FRAME_HEADER for n in g["length"]], maximum)
        g["pack_no"] = [int(w) * PACKS_PER_WRITER + p for w, (p, _) in zip(g[writer], places, strict=True)]
        g["store_offset"] = [o for _, o in places]
        return g

    return chunks.groupBy(writer).applyInPandas(run, schema)


def compact(live: DataFrame, partitions: int, maximum: int) -> DataFrame:
    """Survivors in (pack, offset) order in new packs: whole ranges of old packs go to one writer, read in storage order."""
    w = live.withColumn("writer", F.pmod(F.xxhash64("pack_no"), F.lit(partitions)).cast("long")).withColumnsRenamed({"pack_no": "old_pack", "store_offset": "old_offset"}).withColumn("length", F.col("chunk_length"))
    return assign_packs(w, "writer", ["old_pack", "old_offset"], maximum).drop("writer", "length")


def place(chunks: DataFrame, part: int, maximum: int) -> DataFrame:
    """strong, pack_no, store_offset of different chunks (strong, length): next-fit packs of `maximum` bytes by as many writers as the
    bytes need. Pack numbers of a part of the store begin at part << PART_BITS, so parts share none."""
    total = chunks.agg(F.sum("length")).first()[0] or 0
    writers = max(1, -(-total // (PACKS_A_WRITER * maximum)))
    dealt = chunks.select("strong", "length", F.pmod(F.xxhash64("strong"), F.lit(writers)).cast("long").alias("writer"))
    return assign_packs(dealt, "writer", ["strong"], maximum).select("strong", (F.col("pack_no") + F.lit(part << PART_BITS)).alias("pack_no"), "store_offset")

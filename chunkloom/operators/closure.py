"""Transitive closure over references between backups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.storage import staged

EDGE = ("from_id", "to_id", "via")


def reference_edges(backups: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, via: each backup's parent, and the backups that hold its unchanged files' data."""
    parents = backups.where("coalesce(parent_id, '') <> ''").select(F.col("backup_id").alias("from_id"), F.col("parent_id").alias("to_id"), F.lit("parent").alias("via"))
    if files is None:
        return parents
    data = files.where("coalesce(data_backup_id, '') <> ''").select(F.col("backup_id").alias("from_id"), F.col("data_backup_id").alias("to_id"), F.lit("data").alias("via")).distinct()
    return parents.unionByName(data)


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth (fewest edges from a seed) of everything reachable. Cycles end: a vertex counts once, when first met.

    Each round joins the newest vertices only; what is known is written to the shared folder, so lineage stays short.
    """
    known = staged(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "closure")
    new, depth = known, 0
    while True:
        depth += 1
        step = edges.join(new.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
        new = staged(step.join(known, "id", "left_anti").withColumn("depth", F.lit(depth)), "closure-step")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        if depth % 8 == 0:
            known = staged(known, "closure")


def protect(all_ids: DataFrame, keep: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What must stay so that every kept backup can be restored, and references to backups that don't exist.

    all_ids: (id); keep: (id). Returns (id, depth, promoted_by, via) - for promoted ones the edge that brought them in, from
    the smallest id of the depth above - and (from_id, to_id, via) of dangling references from protected backups.
    """
    real = edges.join(all_ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*EDGE)
    seen = reachable(keep.join(all_ids, "id", "left_semi"), real)
    above = seen.select(F.col("id").alias("from_id"), F.col("depth").alias("d"))
    into = real.join(above, "from_id").groupBy(F.col("to_id").alias("id"), (F.col("d") + 1).alias("depth")).agg(F.min(F.struct("from_id", "via")).alias("x"))
    protected = seen.join(into, ["id", "depth"], "left").select("id", "depth", F.when(F.col("depth") > 0, F.col("x.from_id")).alias("promoted_by"), F.when(F.col("depth") > 0, F.col("x.via")).alias("via"))
    lost = edges.join(seen.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(all_ids.select(F.col("id").alias("to_id")), "to_id", "left_anti").select(*EDGE)
    return protected, lost

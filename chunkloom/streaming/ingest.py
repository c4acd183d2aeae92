"""Resumable ingest: objects arrive as a stream, every micro-batch leaves its chunks and an index delta.

A batch writes folders named by its number and overwrites them if it runs again, so a run that was interrupted and
resumed from its checkpoint ends with the same store as one that wasn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkloom.operators import chunking, dedup, index, packing
from chunkloom.storage import staged

DELTA = "strong string, weak long, pack_no long, store_offset long, chunk_length long, seq long, batch_no long"


def deltas(spark: SparkSession, store: str) -> DataFrame:
    """All index deltas of a store; none yet gives an empty table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/delta")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], DELTA)
    return spark.read.schema(DELTA).parquet(f"{store}/delta")


def ingest(objects: DataFrame, store: str, checkpoint: str, geometry: chunking.Geometry = chunking.SMALL, available_now: bool = True) -> StreamingQuery:
    """Starts the ingest of a stream of (object_id, source, stream_ord, content) into `store`."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        c = staged(chunking.chunk(rows, geometry, with_data=True), "ingest")
        known = deltas(spark, store).where(F.col("batch_no") != number)  # this one's own, from an earlier try, doesn't count
        first = dedup.first_occurrence(c).where("is_first")
        new = dedup.against_index(first, known).where("status = 'new'")
        new = staged(new.select("strong", "weak", F.col("length").cast("long").alias("chunk_length"), F.col("length"), F.col("object_id").alias("seq"), "data"), "ingest-fresh")
        placed = staged(new.drop("length").join(packing.place(new, number, geometry.pack), "strong"), "ingest-new")
        placed.select("pack_no", "store_offset", "strong", "data").write.mode("overwrite").parquet(f"{store}/chunks/batch_no={number}")
        placed.select("strong", "weak", "pack_no", "store_offset", "chunk_length", "seq").write.mode("overwrite").parquet(f"{store}/delta/batch_no={number}")
        c.drop("data").write.mode("overwrite").parquet(f"{store}/entries/batch_no={number}")

    writer = objects.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def folded(spark: SparkSession, store: str) -> DataFrame:
    """The index that the deltas make; of a hash that two batches stored the later one wins."""
    d = deltas(spark, store).withColumn("delta_name", F.lpad(F.col("batch_no").cast("string"), 19, "0"))
    return index.fold(spark.createDataFrame([], "strong string, pack_no long, store_offset long, chunk_length long"), d)


def missing(spark: SparkSession, store: str) -> DataFrame:
    """Chunks that entries name and no delta has: empty for a store that is whole."""
    e = spark.read.parquet(f"{store}/entries").select("strong").distinct()
    return e.join(deltas(spark, store), "strong", "left_anti")

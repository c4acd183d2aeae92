"""Operator inputs made from the provided tables, which hold no backups: stand-ins that exercise the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.storage import table

NOW = "2001-08-02 12:00:00"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("object_id"), "source", F.col("doc_id").alias("stream_ord"), F.col("text").cast("binary").alias("content"))


def whole_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk."""
    o = objects(spark, sf_dir)
    return o.select("object_id", "source", "stream_ord", F.lit(0).alias("seq"), F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("strong"))


def backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a history: customers are sources, the order before is the parent (every third chain is cut), pairs of days are snapshots."""
    o = table(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    parent = F.when(F.col("o_orderkey") % 3 != 0, F.lag("o_orderkey").over(w).cast("string"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("backup_id"),
        F.col("o_custkey").cast("string").alias("source"),
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"),
        F.col("o_orderdate").alias("started_at"),
        F.col("o_orderdate").alias("completed_at"),
        F.col("o_orderdate").alias("timestamp"),
        parent.alias("parent_id"),
        F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("s"), (F.col("o_custkey") % 100).cast("string"))).alias("snapshot_id"),
    )


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as manifests: an order is a backup, its lines are chunks, one behind the other."""
    li = table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return li.select(
        F.col("l_orderkey").cast("string").alias("backup_id"),
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("volume_offset"),
        F.col("l_quantity").cast("long").alias("chunk_length"),
        F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256).alias("chunk_hash"),
        (F.col("l_returnflag") == "R").alias("is_excluded"),
    )


def files_over_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files a backup: fixed thirds of the stream, not on chunk boundaries."""
    size = entries(spark, sf_dir).groupBy("backup_id").agg(F.sum("chunk_length").alias("total"))
    f = size.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    a, b = F.expr("total * i div 3"), F.expr("total * (i + 1) div 3")
    return f.select("backup_id", F.concat(F.lit("f"), "i").alias("path"), a.alias("stream_offset"), (b - a).alias("stream_length"))


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as index deltas: the line number names the delta."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_linenumber").cast("string").alias("delta_name"),
        (F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256).alias("strong"),
        F.col("l_suppkey").cast("long").alias("pack_no"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("store_offset"),
        F.col("l_quantity").cast("long").alias("chunk_length"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as files, their folders as directories, in two sources."""
    c = table(spark, sf_dir, "conversations")
    place = F.concat_ws("/", F.lit("conv"), F.col("conv_id").cast("string"), F.concat(F.col("turn").cast("string"), F.when(F.col("role") == "user", ".txt").otherwise(".log")))
    f = c.select((F.col("conv_id") % 2).cast("int").alias("source_index"), place.alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.lit(False).alias("is_dir"))
    f = f.groupBy("source_index", "path", "is_dir").agg(F.max("size").alias("size")).select("source_index", "path", "size", "is_dir")
    d = c.select((F.col("conv_id") % 2).cast("int").alias("source_index"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path")).distinct()
    return f.unionByName(d.select("source_index", "path", F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_dir")))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as exclusions in seconds."""
    e = table(spark, sf_dir, "events")
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return e.select(s.alias("range_start"), (s + F.floor("value") + 1).alias("range_end"))

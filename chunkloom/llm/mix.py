"""Mixing sources to target weights, with DataFrame operations only.

Each source follows a time-varying weight schedule over training time 0..1. Its demand for tokens up to time t is the
integral of that schedule, scaled to the source's target; a document's copy that starts at cumulative offset o of its
source's stream is placed where the inverted demand reaches o. Documents are then range-sorted by position.

No group is ever brought to one task: streams are cut into hashed buckets, prefix sums run inside a bucket and over the
bucket totals (at most `buckets` rows a source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.storage import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Knots (time, relative weight) of the schedule of each weight class; linear between knots.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
#: Hex digits of the stream order's hash that make a bucket: 4096 buckets a source, 16 times as many for each 16 times 2^32 rows.
BUCKET_DIGITS, ROWS_FOR_THEM = 3, 1 << 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def inverse_demand(fraction: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Time at which the integral of a piecewise linear schedule reaches `fraction` of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    out, done = F.lit(float(knots[-1][0])), sum(areas)
    for (a, b), area in reversed(list(zip(zip(knots, knots[1:], strict=False), areas, strict=True))):
        done -= area
        rest, slope = fraction * F.lit(sum(areas)) - F.lit(done), (b[1] - a[1]) / (b[0] - a[0])
        step = rest / F.lit(a[1]) if slope == 0 else (F.sqrt(F.greatest(F.lit(a[1] * a[1]) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(a[1])) / F.lit(slope)
        out = F.when(fraction * F.lit(sum(areas)) <= F.lit(done + area), F.lit(a[0]) + step).otherwise(out)
    return out


def targets(per_source: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds weight, class_no and target to (key, source_size).

    Sources by code point weigh `weights` in turn and share `share` of all sizes; none gets over `cap` times its size.
    The excess is shared again by weight: in order of cap/weight the first k sources are full, the others get their
    weight's part of what is left. One row a source, so the unpartitioned windows are small.
    """
    order = W.orderBy("key")
    w = per_source.withColumn("class_no", (F.row_number().over(order) - 1) % len(weights))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("class_no") + 1).cast("int")))
    w = w.withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    fill = W.orderBy(F.col("cap") / F.col("weight"), "key")
    before, onward = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.withColumn("rate", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    w = w.withColumn("open", F.col("rate") * F.col("weight") <= F.col("cap"))
    w = w.withColumn("level", F.first(F.when(F.col("open"), F.col("rate")), ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    w = w.withColumn("first_open", F.max(F.col("open").cast("int")).over(fill.rowsBetween(W.unboundedPreceding, 0)))
    return w.select("key", "source_size", "class_no", F.when(F.col("first_open") == 1, F.least(F.col("level") * F.col("weight"), F.col("cap"))).otherwise(F.col("cap")).alias("target"))


def streams(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row a document: doc_id, source, text_hash, size, source_size, target, class_no and `start`, its offset in its source's stream.

    The stream's order is by md5 of doc_id and text, so reruns agree, and neither null ids nor a repeated one share a bucket. Null
    texts have size 0, a null source is a source of its own (the last), repeated rows are documents of their own. Sources are
    the mix's classes: they are ordered in one task, so at most some millions of them.
    """
    h = F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"), h.alias("h"))
    rows = staged(rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t"))), "mix-sizes")
    digits, n = BUCKET_DIGITS, rows.count()
    while n > ROWS_FOR_THEM << 4 * (digits - BUCKET_DIGITS):
        digits += 1
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    totals = rows.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = targets(totals.groupBy("key").agg(F.sum("bucket_size").alias("source_size")), weights, share, cap)
    by_bucket = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(by_bucket), F.lit(0))).join(per_source, "key")
    inside = W.partitionBy("key", "bucket").orderBy("h", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(totals.drop("bucket_size"), ["key", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("inside"))


def _position(offset: Column, schedules: tuple) -> Column:
    fraction = F.when(F.col("target") > 0, F.least(F.greatest(F.try_divide(offset, F.col("target")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    out = inverse_demand(fraction, schedules[0])
    for i, knots in enumerate(schedules[1:], 1):
        out = F.when(F.col("class_no") % len(schedules) == i, inverse_demand(fraction, knots)).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, schedules: tuple = SCHEDULES) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken, position.

    A source's stream is its documents in order, then the same once more; the mix takes the stream's first round(target)
    words, so `taken` is at most twice the size and sums to the target. position (0..1, null if nothing is taken) is the
    training time of the first copy. An empty table gives an empty result.
    """
    s = streams(docs, weights, share, cap)
    budget = F.floor(F.col("target") + 0.5)
    part = lambda start: F.greatest(F.least(budget - start, F.col("size")), F.lit(0))
    taken = part(F.col("start")) + part(F.col("start") + F.col("source_size"))
    out = s.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.when(taken > 0, F.round(_position(F.col("start").cast("double"), schedules), 9)).alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def copies(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, schedules: tuple = SCHEDULES) -> DataFrame:
    """The mixed corpus as whole documents: doc_id, text_hash, copy (0 or 1) and position of every copy that the mix takes.

    A copy is taken whole if its middle lies within the target, so that no document is cut; empty documents are taken once.
    """
    s = streams(docs, weights, share, cap)
    s = s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("offset", F.col("start") + F.col("copy") * F.col("source_size"))
    kept = s.where(((F.col("size") == 0) & (F.col("copy") == 0)) | ((F.col("size") > 0) & (F.col("offset") + F.col("size") / 2 <= F.col("target"))))
    return kept.select("doc_id", "text_hash", "copy", F.coalesce(_position(F.col("offset").cast("double"), schedules), F.lit(0.0)).alias("position"))

"""Half-open ranges: coalescing, gaps, overlap joins, exclusion of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.storage import staged


def coalesce_ranges(ranges: DataFrame, start: str = "range_start", end: str = "range_end", by: tuple[str, ...] = ()) -> DataFrame:
    """Disjoint ranges that cover the same: overlapping and touching ones become one; empty ones vanish.

    by: keys whose ranges are independent. Without keys the ranges are sorted over all tasks; what reaches from one sorted
    stretch into the next is carried as one number a stretch, so no task sees all ranges.
    """
    r = _swept(ranges, start, end, by)
    r = r.groupBy(*by, "__island").agg(F.min("s").alias(start), F.max("e").alias(end))
    return r.select(*by, start, end)


def _swept(ranges: DataFrame, start: str, end: str, by: tuple[str, ...]) -> DataFrame:
    """by, s, e, reach (the greatest end of the ranges before) and the number of the island that a range is in."""
    r = ranges.where(F.col(end) > F.col(start)).select(*by, F.col(start).alias("s"), F.col(end).alias("e"))
    if by:
        w = W.partitionBy(*by).orderBy("s", "e")
        r = r.withColumn("reach", F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)))
        fresh = F.coalesce(F.col("s") > F.col("reach"), F.lit(True)).cast("int")
        return r.withColumn("__island", F.sum(fresh).over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = staged(r.repartitionByRange("s", "e").withColumn("__p", F.spark_partition_id()), "ranges")
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # one row a stretch
    tops = r.groupBy("__p").agg(F.max("e").alias("top")).withColumn("carried", F.max("top").over(before)).drop("top")
    w = W.partitionBy("__p").orderBy("s", "e")
    r = r.join(F.broadcast(tops), "__p").withColumn("reach", F.greatest(F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)), "carried"))
    r = r.withColumn("__new", F.coalesce(F.col("s") > F.col("reach"), F.lit(True)).cast("long"))
    counts = r.groupBy("__p").agg(F.sum("__new").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return r.join(F.broadcast(counts), "__p").select("s", "e", "reach", (F.col("base") + F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).alias("__island"))


def covered(ranges: DataFrame, start: str = "range_start", end: str = "range_end") -> DataFrame:
    """Distinct positions covered."""
    return coalesce_ranges(ranges, start, end).agg(F.coalesce(F.sum(F.col(end) - F.col(start)), F.lit(0)).alias("covered_bytes"))


def gaps(ranges: DataFrame, start: str = "range_start", end: str = "range_end", by: tuple[str, ...] = ()) -> DataFrame:
    """The stretches between the coalesced ranges: where a range begins behind all that the ones before reach."""
    return _swept(ranges, start, end, by).where("s > reach").select(*by, F.col("reach").alias("gap_start"), F.col("s").alias("gap_end"))


def overlap_join(left: DataFrame, right: DataFrame, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose [l_start, l_end) and [r_start, r_end) overlap; empty ranges overlap nothing.

    Both sides are dealt to buckets of `width` positions and joined by bucket (an equi-join); a pair counts in the bucket
    where the later of its starts lies, so it comes out once without a distinct. Any positive width is right; about the
    common length of the ranges is fast.
    """
    deal = lambda df, s, e: df.where(F.col(e) > F.col(s)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    l, r = deal(left, "l_start", "l_end"), deal(right, "r_start", "r_end")
    j = l.join(r, [*on, "__b"])
    j = j.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.floor(F.greatest("l_start", "r_start") / width) == F.col("__b")))
    return j.drop("__b")


def mark_excluded(files: DataFrame, ranges: DataFrame, width: int, key: str = "path") -> DataFrame:
    """Adds is_excluded to files with extents (array of file_offset, volume_offset, length): whether any extent touches a range."""
    extents = files.select(key, F.explode("extents").alias("x")).select(key, F.col("x.volume_offset").alias("l_start"), (F.col("x.volume_offset") + F.col("x.length")).alias("l_end"))
    hit = overlap_join(extents, ranges.select(F.col("range_start").alias("r_start"), F.col("range_end").alias("r_end")), width).select(key).distinct().withColumn("__hit", F.lit(True))
    return files.join(hit, key, "left").withColumn("is_excluded", F.coalesce("__hit", F.lit(False))).drop("__hit")


def trim_extents(extents: Column, size: Column) -> Column:
    """Each extent cut at the file's logical size by its own file offset; those at or past the end are dropped."""
    cut = F.transform(extents, lambda x: x.withField("length", F.least(x["length"], size - x["file_offset"])))
    return F.filter(cut, lambda x: x["length"] > 0)


def zero_ranges(content: Column, start: Column, ranges: Column) -> Column:
    """content (which begins at position start) with zeros where it lies in `ranges`, an array of struct(s, e)."""
    n = F.octet_length(content).cast("long")

    def cut(acc: Column, x: Column) -> Column:
        a = F.greatest(x["s"] - start, F.lit(0).cast("long")).cast("int")
        b = F.least(x["e"] - start, n).cast("int")
        zeros = F.unhex(F.repeat(F.lit("00"), F.greatest(b - a, F.lit(0))))
        return F.when(b > a, F.concat(F.substring(acc, F.lit(1), a), zeros, F.substring(acc, b + 1, F.greatest(n.cast("int") - b, F.lit(0))))).otherwise(acc)

    return F.aggregate(ranges, content, cut)


def data_runs(content: Column, page: int = 4096) -> Column:
    """Maximal runs of pages that aren't all zero as array of struct(offset, length)."""
    n = F.octet_length(content)
    count = F.ceil(n / page).cast("int")
    zero = F.unhex(F.repeat(F.lit("00"), page))
    pages = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * page).cast("long").alias("offset"), F.least(F.lit(page), n - i * page).cast("long").alias("length"), (F.substring(content, i * page + 1, F.lit(page)) != F.substring(zero, F.lit(1), F.least(F.lit(page), n - i * page))).alias("data")))).otherwise(F.array().cast("array<struct<offset:bigint,length:bigint,data:boolean>>"))
    empty = F.array().cast("array<struct<offset:bigint,length:bigint>>")

    def add(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["offset"].alias("offset"), (last["length"] + p["length"]).alias("length"))
        joins = (F.size(acc) > 0) & (last["offset"] + last["length"] == p["offset"])
        before = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        alone = F.struct(p["offset"].alias("offset"), p["length"].alias("length"))
        return F.when(~p["data"], acc).when(joins, F.concat(before, F.array(grown))).otherwise(F.concat(acc, F.array(alone)))

    return F.aggregate(pages, empty, add)


def used_of_bitmap(bitmap: Column, cluster: Column | int) -> Column:
    """struct(used_bytes, end): set bits (lowest first in each byte) in clusters, and where the last one ends."""
    c = F.lit(cluster) if isinstance(cluster, int) else cluster
    byte = F.transform(F.sequence(F.lit(1), F.octet_length(bitmap)), lambda i: F.conv(F.hex(F.substring(bitmap, i, F.lit(1))), 16, 10).cast("int"))
    used = F.aggregate(byte, F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))
    last = F.aggregate(F.transform(byte, lambda x, i: F.when(x > 0, i * 8 + F.floor(F.log2(x.cast("double"))).cast("int") + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.struct((used * c).alias("used_bytes"), (last.cast("long") * c).alias("end"))


#: Files in a volume's root that change with every start, and the numbers and streams of its journals.
VOLATILE_FILES = ("pagefile.sys", "hiberfil.sys", "swapfile.sys")
LOG_RECORD, CHANGE_JOURNAL, CHANGE_STREAM = 2, "$extend/$usnjrnl", "$j"


def volatile_ranges(files: DataFrame) -> DataFrame:
    """range_start, range_end of what an NTFS volume rewrites all the time: paging and hibernation files, the log, the change journal.

    files: filesystem, record, path (from the root), stream (empty: the plain data), extents (array of volume_offset, length; a
    null volume_offset is a hole). Names count in any case; other file systems have none.
    """
    path, stream = F.lower(F.regexp_replace("path", r"^[/\\]+", "")), F.lower(F.coalesce("stream", F.lit("")))
    plain = (path.isin(*VOLATILE_FILES) | (F.col("record") == LOG_RECORD)) & (stream == "")
    journal = (F.translate(path, "\\", "/") == CHANGE_JOURNAL) & (stream == CHANGE_STREAM)
    x = files.where((F.col("filesystem") == "ntfs") & (plain | journal)).select(F.explode("extents").alias("x"))
    return x.where("x.volume_offset is not null and x.length > 0").select(F.col("x.volume_offset").alias("range_start"), (F.col("x.volume_offset") + F.col("x.length")).alias("range_end"))


def apply_exclusions(exclusions: DataFrame, volumes: DataFrame, files: DataFrame) -> DataFrame:
    """One outcome for each exclusion and volume: applied, not-on-volume, not-found or unsupported-filesystem, and the bytes that it
    adds to those before it.

    exclusions: position, drive (C:), rel (path below the root); volumes: volume, letter (empty: every exclusion is for it),
    filesystem; files: volume, path, extents (array of volume_offset, length). An exclusion covers its path and all below, in any
    case of letters. A byte that two exclusions cover belongs to the first.
    """
    letter = F.upper(F.regexp_replace(F.coalesce("letter", F.lit("")), r"\\$", ""))
    each = exclusions.join(F.broadcast(volumes.select("volume", letter.alias("letter"), "filesystem")), (F.col("letter") == "") | (F.col("letter") == F.col("drive")))  # a machine's volumes are few
    each = each.select("volume", "filesystem", "position", F.lower("rel").alias("rel"))
    # a file meets an exclusion in the folder of the same name, so the join is an equi-join on the path's beginnings
    parts = F.split(F.lower(F.regexp_replace("path", r"^/+", "")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    met = files.select("volume", "extents", F.explode(above).alias("rel")).join(each.where("filesystem = 'ntfs'").select("volume", "position", "rel"), ["volume", "rel"])
    found = met.select("volume", "position").distinct().withColumn("found", F.lit(True))
    spans = met.select("volume", "position", F.explode("extents").alias("x")).select("volume", "position", F.col("x.volume_offset").alias("s"), (F.col("x.volume_offset") + F.col("x.length")).alias("e")).where("e > s")
    # stretches between neighbouring edges of a volume; the first exclusion over a stretch owns it
    edges = spans.select("volume", F.explode(F.array("s", "e")).alias("a")).distinct()
    stretch = edges.withColumn("b", F.lead("a").over(W.partitionBy("volume").orderBy("a"))).where("b is not null")
    one = stretch.alias("t").join(spans.alias("p"), F.expr("t.volume = p.volume and p.s <= t.a and t.b <= p.e")).groupBy("t.volume", "t.a", "t.b").agg(F.min("position").alias("position"))
    added = one.groupBy("volume", "position").agg(F.sum(F.col("b") - F.col("a")).alias("bytes"))
    every = exclusions.select("position").join(F.broadcast(volumes.select("volume", "filesystem")), F.lit(True))  # an outcome for each exclusion on each of a machine's few volumes
    mine = each.select("volume", "position").withColumn("here", F.lit(True))
    out = every.join(mine, ["volume", "position"], "left").join(found, ["volume", "position"], "left").join(added, ["volume", "position"], "left")
    status = F.when(F.col("here").isNull(), "not-on-volume").when(F.col("filesystem") != "ntfs", "unsupported-filesystem").when(F.col("found").isNull(), "not-found").otherwise("applied")
    return out.select("volume", "position", status.alias("status"), F.when(status == "applied", F.coalesce("bytes", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("bytes"))

"""Reading trees and images: binary files as catalogs and streams, blocks of large files, and digests of whole streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chunkloom.functions.paths import stream_offsets, walk


def file_catalog(spark: SparkSession, roots: list[str], patterns: tuple[str, ...] = ()) -> DataFrame:
    """source_index, path (relative to its root), size, is_dir, stream_offset of the files under the roots, excluded ones left out. Contents aren't read."""
    out = None
    for i, root in enumerate(roots):
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
        rel = F.regexp_replace("path", "^.*?" + _quoted(root.split("://")[-1].rstrip("/")) + "/", "")
        f = f.select(F.lit(i).alias("source_index"), rel.alias("path"), F.col("length").alias("size"), F.lit(False).alias("is_dir"))
        out = f if out is None else out.unionByName(f)
    return stream_offsets(walk(out, list(patterns)))


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in s)


class _Block(InputPartition):
    def __init__(self, path: str, offset: int, length: int):
        self.path, self.offset, self.length = path, offset, length


class BlockSource(DataSource):
    """Blocks of one large local or mounted file: path, offset, data. Options: path, block (bytes), start, size.

    Each block is a partition of its own, read by position, so a lost one is read again alone; a short read is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return "path string, offset long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options)


class _BlockReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block = options["path"], int(options.get("block", 8 << 20))
        self.start, self.size = int(options.get("start", 0)), int(options["size"])

    def partitions(self):
        return [_Block(self.path, at, min(self.block, self.size - at)) for at in range(self.start, self.size, self.block)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            f.seek(partition.offset)
            data = bytearray()
            while len(data) < partition.length:
                piece = f.read(partition.length - len(data))
                if not piece:
                    raise EOFError(f"{partition.path} ends before {partition.offset + partition.length}")
                data += piece
        yield partition.path, partition.offset, bytes(data)


def padded(content: F.Column, length: F.Column) -> F.Column:
    """A file's bytes at the length that its catalog recorded: cut, or filled with zeros if it has shrunk since."""
    zeros = F.unhex(F.repeat(F.lit("00"), F.greatest(length.cast("int") - F.octet_length(content), F.lit(0))))
    return F.concat(F.substring(content, F.lit(1), length.cast("int")), zeros)


def fold_digests(pieces: DataFrame, key: str = "object_id") -> DataFrame:
    """key, digest: SHA-256 of streams too long for a row. pieces: key, offset, data; sorted by the shuffle, folded one piece at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h, rows = None, None, []
        for b in batches:
            for k, data in zip(b[key], b["data"], strict=True):
                if h is not None and k != now:
                    rows.append((now, h.hexdigest()))
                    h = None
                now, h = k, h or hashlib.sha256()
                h.update(bytes(data))
            if rows:
                yield pd.DataFrame(rows, columns=[key, "digest"])
                rows = []
        if h is not None:
            yield pd.DataFrame([(now, h.hexdigest())], columns=[key, "digest"])

    kind = dict(pieces.dtypes)[key]
    return pieces.select(key, "offset", "data").repartition(key).sortWithinPartitions(key, "offset").select(key, "data").mapInPandas(run, f"{key} {kind}, digest string")

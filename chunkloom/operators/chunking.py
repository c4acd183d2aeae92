"""Content-defined chunking.

A boundary may lie where the hash of the last 48 bytes has certain bits zero. The hash at a byte depends on those bytes
alone, so all candidates of an object come from six vectorised passes (each doubles the window); only the choice of
boundaries by size is sequential, and it jumps from candidate to candidate. Objects are independent of each other.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.normalize import from_names

WINDOW = 48
BLOCK = 16 << 10


@dataclass(frozen=True)
class Geometry:
    """Chunk sizes in bytes; mask: the hash bits of a boundary; label: seeds the byte table, so stores with one label agree on boundaries."""

    minimum: int
    maximum: int
    mask: int
    pack: int = 64 << 20
    label: str = "chunkloom-buzhash-v1-"

    @property
    def hard(self) -> int:
        """Below the minimum a boundary needs more bits, so that streams meet again after an insertion there."""
        return (self.mask << 2 | self.mask) & (1 << 64) - 1

    @property
    def easy(self) -> int:
        return self.mask >> 2


#: The named geometries (minimum, maximum, mask of the average, pack).
PROFILES = {
    "fine-grained": Geometry(4 << 10, 64 << 10, (8 << 10) - 1, 512 << 20),
    "mixed": Geometry(8 << 10, 256 << 10, (32 << 10) - 1, 128 << 20),
    "low-footprint": Geometry(16 << 10, 512 << 10, (64 << 10) - 1, 128 << 20),
    "coarse": Geometry(32 << 10, 1 << 20, (128 << 10) - 1, 256 << 20),
    "archive": Geometry(256 << 10, 8 << 20, (1 << 20) - 1, 1 << 30),
}
#: For texts of some hundred bytes.
SMALL = Geometry(256, 4096, 0x3FF, 128 << 10)


@cache
def byte_table(label: str) -> np.ndarray:
    """256 hash values from a rule: the first 8 bytes (little-endian) of sha256(label + the byte in decimal)."""
    return np.array([int.from_bytes(hashlib.sha256(f"{label}{i}".encode()).digest()[:8], "little") for i in range(256)], np.uint64)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    n %= 64
    return x if n == 0 else (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def window_hashes(data: np.ndarray, table: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The hash behind each byte of data; before: the bytes ahead of it (zeros at a stream's start)."""
    halo = np.zeros(WINDOW - 1, np.uint8)
    if before is not None and len(before):
        tail = before[-(WINDOW - 1) :]
        halo[WINDOW - 1 - len(tail) :] = tail
    h = {1: table[np.concatenate([halo, data])]}
    size = 1
    while size < 32:  # h[2k] at i covers h[k] at i and, turned by k, h[k] at i - k
        x = h[size]
        h[2 * size] = x[size:] ^ _rotl(x[:-size], size)
        size *= 2
    long, short = h[32], h[16]
    n = len(data)
    # h[k][j] ends at position j + k - 1 of the padded bytes
    ends = np.arange(n) + WINDOW - 1
    return long[ends - 31] ^ _rotl(short[ends - 32 - 15], 32)


def boundaries(data: bytes | np.ndarray, g: Geometry) -> list[int]:
    """Ends of the chunks of one object, the last one at its end. Empty data have no chunk."""
    b = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    n, table = len(b), byte_table(g.label)
    easy_at, hard_at = [], []
    for lo in range(0, n, BLOCK):  # blocks fit the cache
        h = window_hashes(b[lo : lo + BLOCK], table, b[max(0, lo - WINDOW + 1) : lo])
        e = np.flatnonzero(h & np.uint64(g.easy) == 0)
        easy_at.append(e + lo + 1)
        hard_at.append(e[h[e] & np.uint64(g.hard) == 0] + lo + 1)
    easy = np.concatenate(easy_at).tolist() if easy_at else []
    hard = np.concatenate(hard_at).tolist() if hard_at else []
    out, start = [], 0
    while start < n:
        i = bisect_left(hard, start + 1)
        if i < len(hard) and hard[i] < start + g.minimum:
            end = hard[i]
        else:
            i = bisect_left(easy, start + max(g.minimum, 1))
            end = min(easy[i] if i < len(easy) else n, start + g.maximum, n)
        out.append(end)
        start = end
    return out


CHUNK_SCHEMA = "object_id long, source string, stream_ord long, seq int, offset long, length int, strong string, weak long, data binary"
_ARROW = pa.schema([("object_id", pa.int64()), ("source", pa.string()), ("stream_ord", pa.int64()), ("seq", pa.int32()), ("offset", pa.int64()), ("length", pa.int32()), ("strong", pa.string()), ("weak", pa.int64()), ("data", pa.binary())])


def chunk(objects: DataFrame, geometry: Geometry = SMALL, normalizers: tuple[str, ...] = (), with_data: bool = False) -> DataFrame:
    """Chunks of (object_id, source, stream_ord, content): seq and offset in the object, strong (SHA-256 of the normalised bytes, hex), weak (XXH64 with seed 0) and, if asked for, the bytes as they were.

    Null and empty contents have no chunks. No shuffle; a task holds one object and one batch of rows.
    """
    normal = from_names(list(normalizers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        rows: list[tuple] = []
        for b in batches:
            ids, sources, orders = (b.column(i).to_pylist() for i in range(3))
            for k, content in enumerate(b.column(3)):
                data = content.as_py() or b""
                start = 0
                for seq, end in enumerate(boundaries(data, geometry)):
                    piece = data[start:end]
                    identity = normal(piece)
                    weak = xxhash.xxh64_intdigest(identity)
                    rows.append((ids[k], sources[k], orders[k], seq, start, end - start, hashlib.sha256(identity).hexdigest(), weak - (weak >> 63 << 64), piece if with_data else None))
                    start = end
                if len(rows) >= 4096:
                    yield emit(rows)
                    rows = []
        if rows:
            yield emit(rows)

    out = objects.select("object_id", "source", "stream_ord", "content").mapInArrow(run, CHUNK_SCHEMA)
    return out if with_data else out.drop("data")


def weak_hash(objects: DataFrame) -> DataFrame:
    """object_id and weak of whole contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [xxhash.xxh64_intdigest(x.as_py() or b"") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x - (x >> 63 << 64) for x in got], pa.int64())], names=["object_id", "weak"])

    return objects.select("object_id", F.col("content")).mapInArrow(run, "object_id long, weak long")

"""Disk layouts: GPT and MBR from images, matching volumes and members, fitting onto another drive."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.functions.scalars import PARTITION_TYPES

MIB = 1 << 20
#: Partition types whose file systems may grow or shrink; MBR extended containers.
DATA_GUIDS = frozenset({"EBD0A0A2-B9E5-4433-87C0-68B6B72699C7", "0FC63DAF-8483-4772-8E79-3D69D8477DE4", "933AC7E1-2EB4-4F13-B844-0E14E2AEF915"})
DATA_BYTES = frozenset({0x07, 0x83})
EXTENDED = frozenset({0x05, 0x0F, 0x85})
MAX_LOGICAL = 128


@dataclass(frozen=True)
class Part:
    idx: int
    first: int  # sectors, inclusive
    last: int
    type_guid: str = ""
    mbr_type: int = 0
    name: str = ""
    logical: bool = False

    @property
    def resizable(self) -> bool:
        return not self.logical and (self.type_guid in DATA_GUIDS or self.mbr_type in DATA_BYTES)

    @property
    def label(self) -> str:
        return f"partition {self.idx} ({PARTITION_TYPES.get(self.type_guid, self.type_guid or f'type 0x{self.mbr_type:02x}')})"


def parse_gpt(image: bytes, sector: int) -> list[Part] | None:
    """Partitions of a GPT whose header and entries have right checksums; None if there is none."""
    head = image[sector : sector + 92]
    if len(head) < 92 or head[:8] != b"EFI PART":
        return None
    size, crc = struct.unpack_from("<II", head, 12)
    whole = image[sector : sector + size]
    if not 92 <= size <= sector or len(whole) < size or zlib.crc32(whole[:16] + bytes(4) + whole[20:]) != crc:
        return None
    at, count, width, entries_crc = struct.unpack_from("<QIII", head, 72)
    table = image[at * sector : at * sector + count * width]
    if width < 128 or len(table) < count * width or zlib.crc32(table) != entries_crc:
        return None
    out = []
    for i in range(count):
        e = table[i * width : (i + 1) * width]
        if any(e[:16]):
            first, last = struct.unpack_from("<QQ", e, 32)
            out.append(Part(i, first, last, str(uuid.UUID(bytes_le=e[:16])).upper(), 0, e[56:128].decode("utf-16-le", "replace").split("\0")[0]))
    return out


def parse_mbr(image: bytes, sector: int) -> list[Part] | None:
    """Primary partitions and the chain of logical ones (at most MAX_LOGICAL, no sector twice); None without a boot signature."""
    if len(image) < 512 or image[510:512] != b"\x55\xaa":
        return None
    slots = lambda at: [(image[at + 446 + 16 * i + 4], *struct.unpack_from("<II", image, at + 446 + 16 * i + 8)) for i in range(4)] if len(image) >= at + 512 and image[at + 510 : at + 512] == b"\x55\xaa" else []
    out, chain = [], None
    for i, (kind, first, n) in enumerate(slots(0)):
        if kind and n:
            out.append(Part(i, first, first + n - 1, mbr_type=kind))
            chain = first if kind in EXTENDED and chain is None else chain
    start, at, seen = chain, chain, set()
    while at is not None and at not in seen and len(seen) < MAX_LOGICAL:
        seen.add(at)
        rows, here, at = slots(at * sector), at, None
        for kind, first, n in rows[:2]:
            if kind in EXTENDED and n:
                at = start + first
            elif kind and n:
                out.append(Part(3 + len(seen), here + first, here + first + n - 1, mbr_type=kind, logical=True))
    return out


PARTITIONS = "disk_id long, scheme string, sector int, idx int, type_guid string, mbr_type int, name string, logical boolean, first_lba long, last_lba long"


def parse_layouts(images: DataFrame) -> DataFrame:
    """Partitions of disk images (disk_id, content: at least the boot structures). GPT at sectors of 512 or 4096 bytes, else MBR; images with neither give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for disk, content in zip(b["disk_id"], b["content"], strict=True):
                image = bytes(content or b"")
                found = next(((s, p) for s in (512, 4096) if (p := parse_gpt(image, s)) is not None), None)
                scheme, sector, parts = ("gpt", *found) if found else ("mbr", 512, parse_mbr(image, 512) or [])
                rows += [(disk, scheme, sector, p.idx, p.type_guid, p.mbr_type, p.name, p.logical, p.first, p.last) for p in parts]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTITIONS.split(", ")])

    return images.select("disk_id", "content").mapInPandas(run, PARTITIONS)


def correlate_volumes(partitions: DataFrame, volumes: DataFrame) -> DataFrame:
    """Adds volume to partitions (disk_id, idx, offset, length): the first by name of one extent at the same place."""
    v = volumes.where("n_extents = 1").groupBy("disk_id", "offset", "length").agg(F.min("volume").alias("volume"))
    return partitions.join(v, ["disk_id", "offset", "length"], "left")


def member_faults(partitions: DataFrame, members: DataFrame) -> DataFrame:
    """disk_id, idx, fault of a capture whose members don't match the layout one to one: no-member, two-members, no-partition."""
    m = members.groupBy("disk_id", "idx").agg(F.count("*").alias("n"))
    p = partitions.select("disk_id", "idx").distinct().withColumn("p", F.lit(True))
    j = p.join(m, ["disk_id", "idx"], "full_outer")
    fault = F.when(F.col("p").isNull(), "no-partition").when(F.col("n").isNull(), "no-member").when(F.col("n") > 1, "two-members")
    return j.select("disk_id", "idx", fault.alias("fault")).where("fault is not null")


@dataclass(frozen=True)
class Target:
    size: int
    logical_sector: int = 0
    physical_sector: int = 0


@dataclass
class Plan:
    parts: list[tuple[Part, Part]] = field(default_factory=list)  # as captured, as planned
    warnings: list[str] = field(default_factory=list)
    refusals: list[str] = field(default_factory=list)


def _up(x: int, unit: int) -> int:
    return -(-x // unit) * unit


def _moved(p: Part, first: int) -> Part:
    return replace(p, first=first, last=first + p.last - p.first)


def _sized(p: Part, sectors: int) -> Part:
    return replace(p, last=p.first + sectors - 1)


def _laid(parts: list[Part], align: int, changed: int) -> list[Part]:
    """Partitions behind a shrunk one move to the first aligned place; logical ones never move."""
    out = list(parts)
    for i in range(changed + 1, len(out)):
        first = _up(out[i - 1].last + 1, align)
        if not out[i].logical and first < out[i].first:
            out[i] = _moved(out[i], first)
    return out


def fit(parts: list[Part], sector: int, target: Target, *, scheme: str = "gpt", first_usable: int = 34, entry_bytes: int = 16384, grow: bool = False, move_trailing: bool = False, realign: bool = False, minimum: dict[int, int] | None = None) -> Plan:
    """Places a captured layout on another drive.

    A larger drive leaves the partitions; with `grow` the last data partition takes the new space (with `move_trailing`
    those behind it go to the end). On a smaller one data partitions shrink from the last backwards, not below their
    file systems' `minimum` bytes (unknown: an alignment unit, with a warning). System, recovery and logical partitions
    keep their sizes. A plan with refusals must not be applied.
    """
    plan = Plan()
    old = sorted(parts, key=lambda p: p.first)
    plan.parts = [(p, p) for p in old]
    if target.logical_sector not in (0, sector):
        plan.refusals.append(f"the drive has sectors of {target.logical_sector} bytes, the layout {sector}")
    if target.size <= 0 or target.size % sector:
        plan.refusals.append(f"{target.size} bytes aren't a whole number of sectors")
    if plan.refusals or not old:
        return plan
    sectors = target.size // sector
    table = -(-entry_bytes // sector) + 1 if scheme == "gpt" else 0
    end = sectors - 1 - table
    if end < table + 1:
        plan.refusals.append("the drive can't hold the partition table")
        return plan
    align = max(MIB // sector, target.physical_sector // sector, 1)
    now, least = list(old), minimum or {}
    data = [i for i, p in enumerate(old) if p.resizable]
    if now[-1].last <= end:
        last = max((i for i, p in enumerate(old) if p.resizable or (p.logical and p.mbr_type in DATA_BYTES)), default=None)
        behind = now[last + 1 :] if last is not None else []
        if grow and last is not None and now[-1].last < end:
            if now[last].logical:
                plan.warnings.append(f"{now[last].label} is logical and can't grow")
            elif behind and not move_trailing:
                plan.warnings.append(f"{now[last].label} can't grow: {', '.join(p.label for p in behind)} behind it")
            elif any(p.logical for p in behind):
                plan.warnings.append(f"{now[last].label} can't grow: a logical partition behind it can't be moved")
            else:
                limit = end
                for i in range(len(now) - 1, last, -1):
                    size = now[i].last - now[i].first + 1
                    now[i] = _moved(now[i], (limit + 1 - size) // align * align)
                    limit = now[i].first - 1
                if limit > now[last].last:
                    now[last] = replace(now[last], last=limit)
    else:
        room = {i: _up(-(-least[old[i].idx] // sector), align) if old[i].idx in least else align for i in data}
        while (over := now[-1].last - end) > 0:
            i = next((i for i in reversed(data) if now[i].last - now[i].first + 1 > room[i]), None)
            if i is None:
                plan.refusals.append(f"the drive is {_up(over * sector, MIB) // MIB} MiB too small even with every data partition at its least")
                break
            if old[i].idx not in least and not any(old[i].label in w for w in plan.warnings):
                plan.warnings.append(f"the least size of {old[i].label} is unknown; its file system must confirm the shrink")
            size = now[i].last - now[i].first + 1
            give = min(size - room[i], over if now[i] == old[i] else _up(over, align))
            now[i] = _sized(now[i], size - give)
            now = _laid(now, align, i)
    if realign and not plan.refusals:
        at, moved = _up(first_usable, align), []
        for p in now:
            moved.append(p if p.logical else _moved(p, _up(at, align)))
            at = moved[-1].last + 1
        if moved[-1].last > end:
            plan.warnings.append(f"realigning needs {moved[-1].last - end} more sectors than there are")
        else:
            now = moved
    for p in now:
        if p.first % align:
            plan.warnings.append(f"{p.label} starts at sector {p.first}, not at a multiple of {align}")
    for a, b in zip(now, now[1:], strict=False):
        if b.first <= a.last:
            plan.refusals.append(f"{b.label} would overlap {a.label}")
    plan.refusals += [f"{p.label} would end behind the last usable sector" for p in now if p.last > end and not plan.refusals]
    plan.parts = list(zip(old, now, strict=True))
    return plan


FIT = "disk_id long, idx int, old_first long, old_last long, new_first long, new_last long, grown boolean, shrunk boolean, moved boolean, warnings array<string>, refusals array<string>"


def fit_layouts(partitions: DataFrame, target: Target, **options) -> DataFrame:
    """Every disk's plan; a disk is one small group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        parts = [Part(int(r.idx), int(r.first_lba), int(r.last_lba), r.type_guid or "", int(r.mbr_type or 0), r.name or "", bool(r.logical)) for r in g.itertuples(index=False)]
        plan = fit(parts, int(g["sector"].iloc[0]), target, scheme=g["scheme"].iloc[0], **options)
        rows = []
        for a, b in plan.parts:
            n, m = a.last - a.first, b.last - b.first
            rows.append((g["disk_id"].iloc[0], a.idx, a.first, a.last, b.first, b.last, m > n, m < n, a.first != b.first, plan.warnings, plan.refusals))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FIT.split(", ")])

    return partitions.groupBy("disk_id").applyInPandas(run, FIT)


def partition_gaps(partitions: DataFrame) -> DataFrame:
    """Unused stretches between a disk's partitions, in sectors."""
    w = W.partitionBy("disk_id").orderBy("first_lba")
    covered = F.max("last_lba").over(w.rowsBetween(W.unboundedPreceding, 0))
    return partitions.select("disk_id", (covered + 1).alias("gap_first"), (F.lead("first_lba").over(w) - 1).alias("gap_last")).where("gap_last >= gap_first")


def rewrite_gpt(primary: bytes, sector: int, disk_size: int, places: dict[int, tuple[int, int]] | None = None) -> tuple[bytes, int, bytes]:
    """The boot structures for another drive: (primary, offset of the backup, backup).

    primary: the captured sectors from 0 up to the end of the entry array. places: new first and last sector by slot (none
    moves: the layout as it is on a drive of another size). All identifiers stay; sizes, positions and checksums follow.
    """
    if parse_gpt(primary, sector) is None:
        raise ValueError("the captured table is damaged")
    out = bytearray(primary)
    head = out[sector : sector + struct.unpack_from("<I", out, sector + 12)[0]]
    at, count, width = struct.unpack_from("<QII", head, 72)
    table = out[at * sector : at * sector + count * width]
    for slot, (first, last) in (places or {}).items():
        if not 0 <= slot < count or last < first:
            raise ValueError(f"slot {slot} can't be placed at {first}..{last}")
        struct.pack_into("<QQ", table, slot * width + 32, first, last)
    last_sector = disk_size // sector - 1
    table_sectors = -(-len(table) // sector)
    usable = last_sector - table_sectors - 1
    used = [struct.unpack_from("<Q", table, i * width + 40)[0] for i in range(count) if any(table[i * width : i * width + 16])]
    if used and max(used) > usable:
        raise ValueError("a partition would end behind the last usable sector")

    def header(own: int, other: int, entries: int) -> bytes:
        h = bytearray(head)
        struct.pack_into("<QQ", h, 24, own, other)
        struct.pack_into("<Q", h, 48, usable)
        struct.pack_into("<Q", h, 72, entries)
        struct.pack_into("<I", h, 88, zlib.crc32(table))
        struct.pack_into("<I", h, 16, 0)
        struct.pack_into("<I", h, 16, zlib.crc32(h))
        return bytes(h)

    out[sector : sector + len(head)] = header(1, last_sector, at)
    out[at * sector : at * sector + len(table)] = table
    if out[446 + 4] == 0xEE:  # the protective entry covers the drive
        struct.pack_into("<I", out, 446 + 12, min(last_sector, 0xFFFFFFFF))
    first = last_sector - table_sectors
    backup = bytes(table).ljust(table_sectors * sector, b"\0") + header(last_sector, 1, first).ljust(sector, b"\0")
    return bytes(out), first * sector, backup

"""Scalar column functions; all are built-in expressions but for the wrapping 64-bit mixer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20


def rotate_left(x: Column, n: int) -> Column:
    """64-bit rotation."""
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)) if n % 64 else x


def strong_hash(content: Column) -> Column:
    """A chunk's identity as 64 lower-case hex digits."""
    return F.sha2(content, 256)


def hash_prefix(strong: Column) -> Column:
    """The first 8 bytes as 16 hex digits: their text order is the unsigned order of the numbers."""
    return F.substring(strong, 1, 16)


def align_up(x: Column, unit: Column | int) -> Column:
    """The next multiple of unit; unit 0 leaves x."""
    u = F.lit(unit) if isinstance(unit, int) else unit
    return F.when(u == 0, x).otherwise(x + F.pmod(-x, F.when(u == 0, F.lit(1)).otherwise(u)))


def align_down(x: Column, unit: Column | int) -> Column:
    u = F.lit(unit) if isinstance(unit, int) else unit
    return F.when(u == 0, x).otherwise(x - F.pmod(x, F.when(u == 0, F.lit(1)).otherwise(u)))


def round_up_mib(n: Column) -> Column:
    return align_up(n, MIB)


def bloom_bits(items: Column, rate: float) -> Column:
    """Bits of a Bloom filter for so many items at a rate of false positives: whole 64-bit words."""
    return align_up(F.ceil(-items * F.log(F.lit(rate)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))).cast("long"), 64)


def format_bytes(n: Column, units: str = "KMGTPE") -> Column:
    """Binary units with one digit behind the point, of exact ties the even one (Spark's own format takes the greater); below 1024 plain bytes. From the last unit on all is in it."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units, 1):
        size = 1 << (10 * power)
        tenths = n.cast("double").cast("decimal(20,0)") * 10
        low = F.floor(tenths / F.lit(size).cast("decimal(20,0)"))
        twice = (tenths - low * F.lit(size).cast("decimal(20,0)")) * 2 - size  # behind the lower tenth, against half a tenth
        near = (low + F.when((twice > 0) | ((twice == 0) & (low % 2 == 1)), 1).otherwise(0)).cast("long")
        out = F.when(n >= size, F.concat(F.floor(near / 10).cast("long").cast("string"), F.lit("."), (near % 10).cast("string"), F.lit(f" {unit}B"))).otherwise(out)
    return out


def guid_text(raw: Column) -> Column:
    """16 bytes of mixed byte order as upper-case GUID text: the first three fields are little-endian."""
    h = F.hex(raw)
    at = lambda i: F.substring(h, 2 * i + 1, 2)
    fields = ([3, 2, 1, 0], [5, 4], [7, 6], [8, 9], range(10, 16))
    return F.concat_ws("-", *(F.concat(*(at(i) for i in f)) for f in fields))


def little_endian(raw: Column, at: int, size: int) -> Column:
    """An unsigned number of up to 7 bytes at a byte offset."""
    return F.conv(F.hex(F.concat(*(F.substring(raw, at + i, 1) for i in range(size, 0, -1)))), 16, 10).cast("long")


def whole_disk(node: Column) -> Column:
    """Partition node to disk node: sdb1 to sdb, nvme0n1p2 to nvme0n1, mmcblk0p1 to mmcblk0; a disk is itself."""
    numbered = F.regexp_replace(node, r"^(.+)p[+-]?[0-9]+$", "$1")
    return F.when(node.rlike("^(nvme|mmcblk)"), numbered).otherwise(F.regexp_replace(node, "[0-9]+$", ""))


def unescape_mount(path: Column) -> Column:
    r"""Octal escapes such as \040 as bytes, by splitting at the backslashes; what isn't an escape of up to 0o377 stays."""
    parts = F.split(path, r"\\")
    # a part behind a backslash begins with an escape if its first three digits are octal and fit a byte
    piece = F.transform(parts, lambda p, i: F.when(i == 0, p.cast("binary")).when(p.rlike("^[0-3][0-7]{2}"), F.concat(F.unhex(F.lpad(F.conv(F.substring(p, 1, 3), 8, 16), 2, "0")), F.substring(p, 4, 1 << 20).cast("binary"))).otherwise(F.concat(F.lit("\\"), p).cast("binary")))
    return F.aggregate(piece, F.lit(b""), lambda a, x: F.concat(a, x)).cast("string")


def drive_number(arg: Column) -> Column:
    r"""The number of a physical drive given as 3 or \\.\PhysicalDrive3; null for anything else."""
    digits = F.regexp_extract(arg, r"^(?:\\\\[.?]\\(?i:physicaldrive))?([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("long"))


def boot_path(path: Column) -> Column:
    """Slashes forward, lower case, without leading ./ and /."""
    return F.regexp_replace(F.translate(path, "\\ABCDEFGHIJKLMNOPQRSTUVWXYZ", "/abcdefghijklmnopqrstuvwxyz"), r"^(?:\./(?=.))*/*", "")


def key_id(key: Column, domain: str = "chunkloom-key-id-v1") -> Column:
    """A key's identity: a domain-separated hash, equal for equal keys, that doesn't show the key."""
    return F.sha2(F.concat(F.lit(domain).cast("binary"), key), 256)


def encrypt(data: Column, key: Column, aad: str, iv: Column | None = None) -> Column:
    """AES-GCM with a 12-byte nonce in front and a 16-byte tag behind; aad names the domain."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), iv if iv is not None else F.lit(b""), F.lit(aad.encode()))


def decrypt(data: Column, key: Column, aad: str) -> Column:
    """The plain bytes, or null if key, domain or bytes are wrong."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad.encode()))


#: Partition types by GUID and their names.
PARTITION_TYPES = {
    "C12A7328-F81F-11D2-BA4B-00A0C93EC93B": "EFI System",
    "E3C9E316-0B5C-4DB8-817D-F92DF00215AE": "Microsoft Reserved",
    "EBD0A0A2-B9E5-4433-87C0-68B6B72699C7": "Basic Data",
    "DE94BBA4-06D1-4D40-A16A-BFD50179D6AC": "Windows RE",
    "0FC63DAF-8483-4772-8E79-3D69D8477DE4": "Linux Filesystem",
    "0657FD6D-A4AB-43C4-84E5-0933C84B4F4F": "Linux Swap",
    "21686148-6449-6E6F-744E-656564454649": "BIOS Boot",
    "E6D6D379-F507-44C2-A23C-238F2A3DF928": "Linux LVM",
    "933AC7E1-2EB4-4F13-B844-0E14E2AEF915": "Linux Home",
    "5808C8AA-7E8F-42E0-85D2-E1E90434CFB3": "Windows LDM",
}


def type_name(guid: Column) -> Column:
    """The name of a partition type; unknown types keep their GUID."""
    names = F.create_map(*(F.lit(x) for kv in PARTITION_TYPES.items() for x in kv))
    return F.coalesce(F.element_at(names, F.upper(guid)), guid)


def filesystem(head: Column) -> Column:
    """The file system of a volume by the magic bytes of its first 2 KiB; null if unknown. ext needs the extents or 64-bit feature."""
    at = lambda i, n: F.hex(F.substring(head, i + 1, n))
    ext = (at(1080, 2) == "53EF") & (F.conv(at(1120, 1), 16, 10).cast("int").bitwiseAND(0xC0) != 0)
    return (
        F.when(at(3, 8) == "4E54465320202020", "ntfs")
        .when(at(3, 8) == "4558464154202020", "exfat")
        .when(at(82, 8) == "4641543332202020", "fat32")
        .when(ext, "ext4")
    )


def mix64(x: Column) -> Column:
    """A bijective 64-bit mixer (of the splitmix family); longs are taken as unsigned. Such products wrap, which SQL's do not."""

    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(mixed(v.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return run(x)


def mixed(x: np.ndarray) -> np.ndarray:
    """The mixer's shifts and factors."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def compression_preset(level: Column) -> Column:
    """The compressor's preset for a level: four of them differ; no level stores plain bytes."""
    return F.when(level <= 1, "fastest").when(level <= 3, "default").when(level <= 6, "better").otherwise("best")


def minimum_size(filesystem: Column, used: Column, last_used_end: Column, total: Column) -> Column:
    """The least size in bytes that a file system can shrink to: the end of its last used cluster (ntfs), the used bytes and a
    twentieth of them (ext4), in whole MiB and at most its size; null if it can't shrink."""
    need = F.when(filesystem == "ntfs", round_up_mib(last_used_end)).when(filesystem == "ext4", round_up_mib(used + F.floor(used / 20).cast("long")))
    return F.least(need, F.when(need.isNotNull(), total))


def mismatch_reason(was: Callable[[str], Column], now: Callable[[str], Column]) -> Column:
    """Why a suspended run can't go on, or an empty string: the first difference of its recorded and the fresh identity.

    Fields: source_kind, source_path, volume, total_size, config_hash, mtime (of an input file), mode, catalog_hash (of files).
    """
    differs = lambda f: ~was(f).eqNullSafe(now(f))
    change = lambda text, f, tail="": F.concat(F.lit(f"{text} ("), was(f).cast("string"), F.lit(" -> "), now(f).cast("string"), F.lit(tail + ")"))
    return (
        F.when(differs("source_kind"), change("source kind changed", "source_kind"))
        .when(differs("source_path"), change("source path changed", "source_path"))
        .when(differs("volume"), change("volume changed", "volume"))
        .when(differs("total_size"), change("source size changed", "total_size", " bytes"))
        .when(differs("config_hash"), "repository chunker/normalizer/encryption config changed")
        .when((was("source_kind") == "input") & differs("mtime"), change("input file mtime changed", "mtime"))
        .when((was("mode") == "file") & differs("catalog_hash"), "source files changed since the backup was suspended (files added, removed, resized, or modified)")
        .otherwise("")
    )

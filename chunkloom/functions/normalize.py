"""Normalisers: bytes that differ between equal programs or records are zeroed before a chunk is hashed. Stored bytes stay as they are."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

#: Machine types and optional-header magics of plausible PE headers.
PE_MACHINES = frozenset({0x014C, 0x8664, 0x01C0, 0x01C4, 0xAA64, 0x0200})
PE_MAGICS = frozenset({0x010B, 0x020B, 0x0107})
MAX_SECTIONS = 96
RECORD, STANDARD_INFORMATION, FILE_NAME = 1024, 0x10, 0x30


def normalize_pe(data: bytes) -> bytes:
    """Zeroes the time stamp and, inside its optional header, the checksum of every plausible PE header in the chunk, whether the image begins there or not."""
    out, at = None, data.find(b"PE\0\0")
    while at >= 0:
        if at + 24 <= len(data):
            machine, sections = struct.unpack_from("<HH", data, at + 4)
            optional = struct.unpack_from("<H", data, at + 20)[0]
            magic = optional < 2 or at + 26 <= len(data) and struct.unpack_from("<H", data, at + 24)[0] in PE_MAGICS
            if machine in PE_MACHINES and 0 < sections <= MAX_SECTIONS and magic:
                out = out or bytearray(data)
                out[at + 8 : at + 12] = bytes(4)
                if optional >= 68 and at + 92 <= len(data):
                    out[at + 88 : at + 92] = bytes(4)
        at = data.find(b"PE\0\0", at + 1)
    return bytes(out) if out is not None else data


def normalize_mft(data: bytes) -> bytes:
    """Zeroes the four time stamps of the standard-information and file-name attributes in file records at 1 KiB steps."""
    out = None
    for base in range(0, len(data) - RECORD + 1, RECORD):
        if data[base : base + 4] != b"FILE":
            continue
        at = base + struct.unpack_from("<H", data, base + 20)[0]
        while at + 24 <= base + RECORD:
            kind, length = struct.unpack_from("<II", data, at)
            if kind == 0xFFFFFFFF or length < 24 or at + length > base + RECORD:
                break
            if kind in (STANDARD_INFORMATION, FILE_NAME) and data[at + 8] == 0:
                first = at + struct.unpack_from("<H", data, at + 20)[0] + (8 if kind == FILE_NAME else 0)
                if first + 32 <= at + length:
                    out = out or bytearray(data)
                    out[first : first + 32] = bytes(32)
            at += length
    return bytes(out) if out is not None else data


NORMALIZERS: dict[str, Callable[[bytes], bytes]] = {"pe-timestamp": normalize_pe, "ntfs-timestamp": normalize_mft}


def from_names(names: list[str]) -> Callable[[bytes], bytes]:
    """The named normalisers, one behind the other; an unknown name is an error, as hashes would differ silently."""
    unknown = [n for n in names if n not in NORMALIZERS]
    if unknown:
        raise ValueError(f"unknown normalizer: {', '.join(unknown)}")

    def run(data: bytes) -> bytes:
        for n in names:
            data = NORMALIZERS[n](data)
        return data

    return run


def normalizer(names: list[str]):
    """A vectorised column function: the bytes whose hash is a chunk's identity."""
    run = from_names(names)

    @F.pandas_udf("binary")
    def normalized(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else run(bytes(x)))

    return normalized

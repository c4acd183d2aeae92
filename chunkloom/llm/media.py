"""Media columns: signature sniffing, validation, type correction and carving.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass; a validator of that format then checks
the structure and gives the exact length, so chance hits are dropped and embedded media can be cut out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE = 8000


def wav_of(payload: bytes) -> bytes:
    """payload as 8-bit mono PCM: a RIFF file whose samples are the bytes."""
    pad = b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad


def _wav(b: bytes, at: int) -> dict | None:
    """Walks the chunks of a RIFF/WAVE file; needs a format and a data chunk that lie inside the stated length."""
    if len(b) - at < 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    out, p = {}, at + 12
    while p + 8 <= end:
        kind, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return None
        if kind == b"fmt " and n >= 16:
            out["channels"], out["rate"], out["bits"] = struct.unpack_from("<HI", b, p + 10) + struct.unpack_from("<H", b, p + 22)
        elif kind == b"data":
            out["data"] = (p + 8, n)
        p += 8 + n + n % 2
    return out | {"type": "audio/wav", "length": end - at} if {"channels", "data"} <= out.keys() else None


def _png(b: bytes, at: int) -> dict | None:
    """Walks the chunks up to IEND and checks every CRC."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return {"type": "image/png", "length": p - at}
    return None


def _gif(b: bytes, at: int) -> dict | None:
    """Walks the blocks up to the trailer."""
    if len(b) - at < 14:
        return None
    flags, p = b[at + 10], at + 13
    p += 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return {"type": "image/gif", "length": p + 1 - at}
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
    return None


def _bmp(b: bytes, at: int) -> dict | None:
    if len(b) - at < 26:
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", b, at + 2)
    if reserved or header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= offset <= size <= len(b) - at:
        return None
    return {"type": "image/bmp", "length": size}


def _jpeg(b: bytes, at: int) -> dict | None:
    """Walks the segments; entropy-coded data ends at the first marker that isn't a restart."""
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        marker = b[p + 1]
        if marker == 0xD9:
            return {"type": "image/jpeg", "length": p + 2 - at}
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return None
        p += 2 + n
        if marker == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return None
    return {"type": "image/jpeg", "length": p + 2 - at} if b[p : p + 2] == b"\xff\xd9" else None


#: Magic bytes of the formats (fixed values) and their validators.
FORMATS = {b"RIFF": _wav, b"\x89PNG\r\n\x1a\n": _png, b"GIF87a": _gif, b"GIF89a": _gif, b"BM": _bmp, b"\xff\xd8\xff": _jpeg}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic in FORMATS:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def sniff(b: bytes, a: ahocorasick.Automaton) -> list[dict]:
    """All valid media in b, outermost first: type, offset, length and what the validator read. Media inside media count too."""
    found = []
    for end, magic in a.iter(b.decode("latin-1")):
        at = end + 1 - len(magic)
        if x := FORMATS[magic](b, at):
            found.append(x | {"offset": at})
    return sorted(found, key=lambda x: (x["offset"], -x["length"]))


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def media_columns(docs: DataFrame, text: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """Stores every text as 8-bit samples and describes the stored bytes: doc_id, media, media_type, samples, carved.

    `media` is the stored file, `media_type` the type found (corrects `declared`), `samples` the payload cut back out of
    it, `carved` the other media that the bytes hold. Null texts count as empty; rows stay in place, nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 256):
                out = {"doc_id": ids[lo : lo + 256], "n_bytes": [], "media": [], "media_type": [], "samples": [], "carved": []}
                for t in texts.slice(lo, 256).to_pylist():
                    n, payload = payload_of(t)
                    media = wav_of(payload)
                    found = sniff(media, a)
                    whole = next((x for x in found if x["offset"] == 0), None)
                    out["n_bytes"].append(n)
                    out["media"].append(media)
                    out["media_type"].append(whole["type"] if whole else declared)
                    at, size = whole["data"] if whole and "data" in whole else (0, len(media))
                    out["samples"].append(media[at : at + size])
                    out["carved"].append([{"type": x["type"], "offset": x["offset"], "length": x["length"]} for x in found if x is not whole])
                yield pa.RecordBatch.from_pydict(out, schema=SCHEMA)

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_bytes long, media binary, media_type string, samples binary, carved array<struct<type:string,offset:long,length:long>>")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("media_type", pa.string()), ("samples", pa.binary()), ("carved", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))])


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def digest(docs: DataFrame) -> DataFrame:
    """What is read back from the stored media, in short: sizes, hashes and a feature string (type, frames, rate, mean and mean change of the samples, carved media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, n, media, kind, samples, carved in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                x = np.frombuffer(samples, np.uint8).astype(np.int64)
                feature = f"{kind};frames={len(x)};rate={RATE};sum={int(x.sum())};change={int(np.abs(np.diff(x)).sum())};carved={','.join(c['type'] + '@' + str(c['offset']) + '+' + str(c['length']) for c in carved)}"
                out.append((i, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * len(_DIGEST), _DIGEST, strict=True)], schema=_DIGEST)

    return media_columns(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

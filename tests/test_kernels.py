"""Kernels against plain versions that are written another way."""

from __future__ import annotations

import hashlib
import random
import struct
import uuid
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from chunkloom.functions import normalize, paths, scalars
from chunkloom.operators import chunking as K
from chunkloom.operators import dedup, layout, ranges
from chunkloom.sources import images

G = K.Geometry(64, 512, 0xFF)


def plain_boundaries(data: bytes, g: K.Geometry) -> list[int]:
    """Byte by byte, the hash rolled along."""
    t = [int(x) for x in K.byte_table(g.label)]
    rot = lambda x, n: (x << n % 64 | x >> (64 - n % 64)) & (1 << 64) - 1 if n % 64 else x
    window, h = [0] * K.WINDOW, 0
    for i in range(K.WINDOW):
        h ^= rot(t[0], K.WINDOW - 1 - i)
    out, start = [], 0
    for i, b in enumerate(data):
        gone = window[i % K.WINDOW]
        window[i % K.WINDOW] = b
        h = rot(h, 1) ^ rot(t[gone], K.WINDOW) ^ t[b]
        n = i + 1 - start
        if n >= g.maximum or (h & (g.hard if n < g.minimum else g.easy)) == 0:
            out.append(i + 1)
            start = i + 1
    return out + [len(data)] if start < len(data) else out


@pytest.mark.parametrize("size", [0, 1, 47, 48, 49, 500, 5000, 40000])
def test_boundaries_equal_rolling(size):
    data = random.Random(size).randbytes(size)
    assert K.boundaries(data, G) == plain_boundaries(data, G)


def test_boundaries_across_blocks_and_zeros():
    data = random.Random(1).randbytes(3 * K.BLOCK + 17)
    assert K.boundaries(data, G) == plain_boundaries(data, G)
    assert K.boundaries(bytes(2000), G) == plain_boundaries(bytes(2000), G)


def test_chunks_resync_after_insertion():
    data = random.Random(5).randbytes(1 << 20)

    def cut(d: bytes) -> set[bytes]:
        ends = K.boundaries(d, K.SMALL)
        return {hashlib.sha256(d[a:b]).digest() for a, b in zip([0, *ends], ends, strict=False)}

    old, new = cut(data), cut(data[: 1 << 19] + b"x" + data[1 << 19 :])
    assert len(old & new) >= 0.8 * len(old)


@pytest.mark.parametrize("name", K.PROFILES)
def test_profiles_hold_their_bounds(name):
    g = K.PROFILES[name]
    ends = K.boundaries(random.Random(3).randbytes(1 << 20), g)
    assert ends[-1] == 1 << 20 and all(b - a <= g.maximum for a, b in zip([0, *ends], ends, strict=False))


def test_chunk_rows(spark):
    rows = [(1, "s", 1, b"abc" * 1000), (2, "s", 2, b""), (3, None, 3, None), (4, "s", 4, b"abc" * 1000)]
    out = K.chunk(spark.createDataFrame(rows, "object_id long, source string, stream_ord long, content binary"), G, with_data=True).collect()
    assert {r.object_id for r in out} == {1, 4}
    whole = b"".join(bytes(r.data) for r in sorted(out, key=lambda r: r.seq) if r.object_id == 1)
    assert whole == b"abc" * 1000
    assert all(hashlib.sha256(bytes(r.data)).hexdigest() == r.strong for r in out)


def test_next_pack():
    assert dedup.next_pack([60, 60, 200, 10], 100) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert dedup.next_pack([50, 50, 1], 100) == [(0, 0), (0, 50), (1, 0)]


def pe(stamp: int) -> bytes:
    head = bytearray(0x40)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 0x3C, 0x80)
    body = bytearray(400)
    body[:4] = b"PE\0\0"
    struct.pack_into("<HHI", body, 4, 0x8664, 3, stamp)
    struct.pack_into("<H", body, 20, 240)
    struct.pack_into("<H", body, 24, 0x20B)
    struct.pack_into("<I", body, 24 + 64, stamp)
    return bytes(head) + bytes(0x40) + bytes(body)


def test_normalizers():
    a, b = b"x" * 10 + pe(1), b"x" * 10 + pe(2)
    assert a != b and normalize.normalize_pe(a) == normalize.normalize_pe(b) != a
    plain = b"MZ and no header" * 20
    assert normalize.normalize_pe(plain) == plain
    record = bytearray(1024)
    record[:4] = b"FILE"
    struct.pack_into("<H", record, 20, 56)
    struct.pack_into("<II", record, 56, 0x10, 72)
    struct.pack_into("<H", record, 56 + 20, 24)
    struct.pack_into("<I", record, 56 + 72, 0xFFFFFFFF)
    stamped = bytearray(record)
    stamped[80:112] = b"t" * 32
    assert normalize.normalize_mft(bytes(stamped)) == bytes(record)
    with pytest.raises(ValueError):
        normalize.from_names(["nonsense"])


def gpt(size: int = 1 << 20) -> bytes:
    image = bytearray(size)
    entries = bytearray(128 * 128)
    for i, (first, last) in enumerate(((2048, 4095), (4096, 8191))):
        entries[i * 128 : i * 128 + 16] = uuid.UUID("EBD0A0A2-B9E5-4433-87C0-68B6B72699C7").bytes_le
        struct.pack_into("<QQ", entries, i * 128 + 32, first, last)
        entries[i * 128 + 56 : i * 128 + 60] = "ab".encode("utf-16-le")
    head = bytearray(92)
    head[:8] = b"EFI PART"
    struct.pack_into("<IIII", head, 8, 0x10000, 92, 0, 0)
    struct.pack_into("<QQQQ", head, 24, 1, size // 512 - 1, 34, size // 512 - 34)
    struct.pack_into("<QIII", head, 72, 2, 128, 128, zlib.crc32(entries))
    struct.pack_into("<I", head, 16, zlib.crc32(head))
    image[512:604], image[1024 : 1024 + len(entries)] = head, entries
    return bytes(image)


def mbr() -> bytes:
    image = bytearray(1 << 20)

    def slot(at, i, kind, first, n):
        image[at + 446 + 16 * i + 4] = kind
        struct.pack_into("<II", image, at + 446 + 16 * i + 8, first, n)
        image[at + 510 : at + 512] = b"\x55\xaa"

    slot(0, 0, 0x07, 63, 100)
    slot(0, 1, 0x05, 200, 800)
    slot(200 * 512, 0, 0x83, 1, 50)
    slot(200 * 512, 1, 0x05, 100, 100)
    slot(300 * 512, 0, 0x83, 1, 60)
    slot(300 * 512, 1, 0x05, 0, 100)  # back to the start: a loop
    return bytes(image)


def test_layouts_from_images(spark):
    bad = bytearray(gpt())
    bad[1030] ^= 1
    d = spark.createDataFrame([(1, gpt()), (2, mbr()), (3, bytes(600)), (4, bytes(bad)), (5, None)], "disk_id long, content binary")
    got = sorted((r.disk_id, r.scheme, r.idx, r.first_lba, r.last_lba, r.logical) for r in layout.parse_layouts(d).collect())
    assert [g for g in got if g[0] == 1] == [(1, "gpt", 0, 2048, 4095, False), (1, "gpt", 1, 4096, 8191, False)]
    assert [g[3:] for g in got if g[0] == 2] == [(63, 162, False), (200, 999, False), (201, 250, True), (301, 360, True)]
    assert {g[0] for g in got} == {1, 2}


DATA = "EBD0A0A2-B9E5-4433-87C0-68B6B72699C7"
PARTS = [layout.Part(0, 2048, 206847, "C12A7328-F81F-11D2-BA4B-00A0C93EC93B"), layout.Part(1, 206848, 1000447, DATA), layout.Part(2, 1000448, 1020927, "DE94BBA4-06D1-4D40-A16A-BFD50179D6AC")]


def test_fit_same_grow_and_shrink():
    same = layout.fit(PARTS, 512, layout.Target(1 << 30))
    assert not same.refusals and all(a == b for a, b in same.parts)
    blocked = layout.fit(PARTS, 512, layout.Target(1 << 30), grow=True)
    assert blocked.warnings and all(a == b for a, b in blocked.parts)
    grown = layout.fit(PARTS, 512, layout.Target(1 << 30), grow=True, move_trailing=True)
    old, new = grown.parts[1]
    assert new.first == old.first and new.last > old.last and grown.parts[2][1].first == new.last + 1
    assert grown.parts[2][1].first % 2048 == 0
    small = layout.fit(PARTS, 512, layout.Target(300 << 20), minimum={1: 100 << 20})
    assert not small.refusals and small.parts[1][1].last < PARTS[1].last and small.parts[2][1].last <= (300 << 20) // 512 - 34
    none = layout.fit(PARTS, 512, layout.Target(300 << 20), minimum={1: 380 << 20})
    assert none.refusals
    assert layout.fit(PARTS, 512, layout.Target(1 << 30, 4096)).refusals
    assert layout.fit(PARTS, 512, layout.Target((1 << 30) + 1)).refusals


def test_rules_and_globs(spark):
    d = spark.createDataFrame([("a/b/c.txt", False), ("a", True), ("build", True), ("x/build", True), ("x/build/f", False), ("a/keep.log", False), ("z.log", False), ("a[1].txt", False)], "path string, is_dir boolean")
    out = lambda *p: sorted(r.path for r in d.where(paths.excluded(F.col("path"), F.col("is_dir"), list(p))).collect())
    assert out("build/") == ["build", "x/build"]
    assert out("/build") == ["build"]
    assert out("*.log", "!keep.log") == ["z.log"]
    assert out("a/b") == ["a/b/c.txt"]
    assert out("a/**") == ["a", "a/b/c.txt", "a/keep.log"]
    assert out("**/c.txt") == ["a/b/c.txt"]
    assert out("a\\[1\\].txt") == ["a[1].txt"] and out("[a-") == [] and out("#x", " ") == []


def test_byte_labels_of_large_sizes(spark):
    """Against C's rounding of the exact quotient; the query's SQL ends at GB, the operator at EB."""
    r = random.Random(5)
    sizes = [0, 1023, 1024, 1280, 1792, 1331, (1 << 20) - 1, 1 << 40, 5 << 38, (1 << 60) + (1 << 58), (1 << 63) - 1, *(r.getrandbits(r.randint(1, 62)) for _ in range(3000))]
    d = spark.createDataFrame([(n,) for n in sizes], "n long")

    def label(n, units):
        power = min(max((n.bit_length() - 1) // 10, 0), len(units))
        return f"{n / (1 << 10 * power):.1f} {units[power - 1]}B" if power else f"{n} B"

    for units in ("KMGTPE", "KMG"):
        assert {x.n: x.l for x in d.select("n", scalars.format_bytes(F.col("n"), units).alias("l")).collect()} == {n: label(n, units) for n in sizes}


def test_byte_labels_beyond_gigabytes(spark, tmp_path):
    from chunkloom.plans import queries

    spark.createDataFrame([(396325,), (9000000,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, queries.byte_labels(spark, str(tmp_path)).collect())) == sorted(con.execute(queries.ORACLES["byte_labels"]).fetchall())


def test_scalars(spark):
    d = spark.range(1)
    one = lambda c: d.select(c.alias("x")).first().x
    assert one(scalars.rotate_left(F.lit(-(1 << 63)), 1)) == 1
    assert one(scalars.unescape_mount(F.lit("/a\\040b\\x"))) == "/a b\\x"
    assert one(scalars.align_up(F.lit(5), 0)) == 5 and one(scalars.align_down(F.lit(4097), 4096)) == 4096
    assert one(scalars.filesystem(F.unhex(F.lit("EB5290" + b"NTFS    ".hex())))) == "ntfs"
    assert one(scalars.little_endian(F.unhex(F.lit("00010203")), 1, 3)) == 0x030201
    assert one(scalars.type_name(F.lit(DATA.lower()))) == "Basic Data"


def test_bytes_of_ranges(spark):
    d = spark.createDataFrame([(b"abcdefgh", 100)], "c binary, s long")
    r = F.array(*(F.struct(F.lit(a).cast("long").alias("s"), F.lit(b).cast("long").alias("e")) for a, b in ((90, 102), (105, 106), (300, 400))))
    assert bytes(d.select(ranges.zero_ranges(F.col("c"), F.col("s"), r).alias("x")).first().x) == b"\0\0cde\0gh"
    z = spark.createDataFrame([(b"\0" * 8 + b"ab\0\0" + b"\0" * 4 + b"x",)], "c binary")
    assert [tuple(x) for x in z.select(ranges.data_runs(F.col("c"), 4).alias("x")).first().x] == [(8, 4), (16, 1)]
    assert tuple(spark.createDataFrame([(bytes([0b101, 0, 0b1000]),)], "c binary").select(ranges.used_of_bitmap(F.col("c"), 4096).alias("x")).first().x) == (3 * 4096, 20 * 4096)


def test_blocks_and_digests(spark, tmp_path):
    data = random.Random(9).randbytes(100_003)
    (tmp_path / "big").write_bytes(data)
    spark.dataSource.register(images.BlockSource)
    b = spark.read.format("blocks").option("path", str(tmp_path / "big")).option("block", 4096).option("size", len(data)).load()
    got = images.fold_digests(b, "path").collect()
    assert [r.digest for r in got] == [hashlib.sha256(data).hexdigest()]
    p = spark.createDataFrame([(b"abc", 5), (b"abc", 2)], "c binary, n long").select(images.padded(F.col("c"), F.col("n")).alias("x")).collect()
    assert [bytes(r.x) for r in p] == [b"abc\0\0", b"ab"]


def test_file_catalog(spark, tmp_path):
    for name, size in (("a.txt", 3), ("d/b.txt", 5), ("d/c.log", 7)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    rows = sorted((r.path, r.size, r.stream_offset) for r in images.file_catalog(spark, [str(tmp_path)], ("*.log",)).collect())
    assert rows == [("a.txt", 3, 0), ("d/b.txt", 5, 3)]


def test_gpt_rewritten_for_a_larger_drive():
    image, size = gpt(), 4 << 20
    places = {1: (4096, 8000)}
    primary, at, backup = layout.rewrite_gpt(image[: 34 * 512], 512, size, places)
    assert [(p.first, p.last) for p in layout.parse_gpt(primary, 512)] == [(2048, 4095), (4096, 8000)] or size // 512 <= 8000
    assert at + len(backup) == size
    head = backup[-512:-420]
    assert head[:8] == b"EFI PART" and struct.unpack_from("<QQ", head, 24) == (size // 512 - 1, 1)
    assert zlib.crc32(head[:16] + bytes(4) + head[20:92]) == struct.unpack_from("<I", head, 16)[0]
    assert zlib.crc32(backup[: 128 * 128]) == struct.unpack_from("<I", head, 88)[0]
    with pytest.raises(ValueError):
        layout.rewrite_gpt(image[: 34 * 512], 512, 1 << 20, places)
    damaged = bytearray(image)
    damaged[600] ^= 1
    with pytest.raises(ValueError):
        layout.rewrite_gpt(bytes(damaged[: 34 * 512]), 512, size)


def test_profiles_are_the_fixed_ones():
    sizes = {k: (g.minimum >> 10, g.mask + 1 >> 10, g.maximum >> 10, g.pack >> 20) for k, g in K.PROFILES.items()}
    assert sizes == {"fine-grained": (4, 8, 64, 512), "mixed": (8, 32, 256, 128), "low-footprint": (16, 64, 512, 128), "coarse": (32, 128, 1024, 256), "archive": (256, 1024, 8192, 1024)}


def test_a_header_cut_from_its_image_is_normalised():
    head = b"PE\0\0" + (0x8664).to_bytes(2, "little") + (3).to_bytes(2, "little") + b"TIME" + bytes(8) + (240).to_bytes(2, "little") + b"\x22\0" + (0x20B).to_bytes(2, "little") + b"r" * 62 + b"SUMS" + b"tail"
    got = normalize.normalize_pe(b"cut here" + head)
    assert got == (b"cut here" + head).replace(b"TIME", bytes(4)).replace(b"SUMS", bytes(4))
    short = head[:20] + (60).to_bytes(2, "little") + head[22:]
    assert normalize.normalize_pe(short) == short.replace(b"TIME", bytes(4))
    for other in (head.replace(b"PE\0\0d", b"PE\0\0e"), head[:6] + (97).to_bytes(2, "little") + head[8:], head[:24] + b"\x01\x01" + head[26:]):
        assert normalize.normalize_pe(other) == other


def test_ranges_over_many_stretches(spark):
    r = random.Random(5)
    rows = [(a, a + r.choice((0, 1, 5, 60, 900))) for a in (r.randrange(20_000) for _ in range(900))]
    d = spark.createDataFrame(rows, "range_start long, range_end long").repartition(7)
    inside = sorted({x for a, b in rows for x in range(a, b)})
    islands = [[inside[0], inside[0] + 1]]
    for x in inside[1:]:
        if x == islands[-1][1]:
            islands[-1][1] += 1
        else:
            islands.append([x, x + 1])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        assert sorted(map(list, ranges.coalesce_ranges(d).collect())) == islands
        assert sorted(map(list, ranges.gaps(d).collect())) == [[a[1], b[0]] for a, b in zip(islands, islands[1:], strict=False)]
        assert ranges.covered(d).first()[0] == len(inside)
    finally:
        spark.conf.unset(key)
    assert ranges.coalesce_ranges(d.limit(0)).collect() == [] and ranges.covered(d.limit(0)).first()[0] == 0


def test_exclusions_have_one_outcome_each(spark):
    ex = spark.createDataFrame([(1, "C:", "Temp"), (2, "C:", "temp/Big"), (3, "D:", "x"), (4, "C:", "gone"), (5, "C:", "pics")], "position int, drive string, rel string")
    vols = spark.createDataFrame([("v1", "c:\\", "ntfs"), ("v2", "D:", "ext4"), ("v3", None, "ntfs")], "volume string, letter string, filesystem string")
    extents = "array<struct<volume_offset:long,length:long>>"
    files = spark.createDataFrame([("v1", "TEMP/a", [(0, 10)]), ("v1", "temp/big/b", [(5, 10), (100, 5)]), ("v1", "pics/c", [(8, 20)]), ("v1", "temporary", [(500, 9)]), ("v3", "x/y", [(1, 2)])], f"volume string, path string, extents {extents}")
    got = {(r.volume, r.position): (r.status, r.bytes) for r in ranges.apply_exclusions(ex, vols, files).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "v1"} == {1: ("applied", 20), 2: ("applied", 0), 3: ("not-on-volume", 0), 4: ("not-found", 0), 5: ("applied", 13)}
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "v2"} == {1: "not-on-volume", 2: "not-on-volume", 3: "unsupported-filesystem", 4: "not-on-volume", 5: "not-on-volume"}
    assert got["v3", 3] == ("applied", 2) and got["v3", 1] == ("not-found", 0) and len(got) == 15


def test_bloom_filter(spark):
    from chunkloom.operators import bloom

    d = spark.range(20000).select(F.col("id"), F.xxhash64("id").alias("s"))
    got = d.limit(50).select("s", bloom.positions(F.col("s"), 6400).alias("p"), scalars.mix64(F.col("s")).alias("m")).collect()
    for r in got:
        x = r.s % 2**64
        m = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        m = (m ^ m >> 27) * 0x94D049BB133111EB % 2**64
        m ^= m >> 31
        assert r.m % 2**64 == m and r.p == [(x + i * m + i * i) % 2**64 % 6400 for i in range(7)]
    bits = bloom.bits_for(10000, 0.01)
    words = bloom.build(d.where("id < 10000"), "s", bits)
    got = bloom.maybe(d, "s", words, bits).groupBy((F.col("id") < 10000).alias("inside")).agg(F.sum(F.col("maybe").cast("int")).alias("n")).collect()
    n = {r.inside: r.n for r in got}
    assert n[True] == 10000 and n[False] < 300

"""Operators over documents against plain versions, and the odd rows that each must stand."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import jaccard, media, mix, pack, pii, tokens, toxic
from chunkloom.llm import queries as Q
from chunkloom.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0d]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names an operator might use itself.
CLASHING = ("size", "target", "key", "n", "hi", "label", "c", "w", "t", "mean", "cells", "spans", "start", "h")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def odd(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "one two three four five", "a"), (3, "one two three four five", "a"), (None, "no id here at all", "b"), (4, "é😀 " * 5, ""), (5, "word " * 60_000, "b"), (6, "x" * 300_000, "b")]
    d = documents(spark, rows)
    for name in CLASHING:
        d = d.withColumn(name, F.lit("clash"))
    return d, len(rows)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


PATH3, PATH2 = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "mix": lambda s, d: mix.mix(d),
    "tokens": lambda s, d: tokens.token_counts(d, PATH2),
    "pii": lambda s, d: pii.digest(d),
    "jaccard": lambda s, d: jaccard.join(d),
    "media": lambda s, d: media.digest(d),
    "pack": lambda s, d: pack.pack(d, PATH3).where("start = 0"),
    "toxic": lambda s, d: toxic.score(d, labels(s, [(3, 0, 1), (None, None, None), (5, 1, 0)])),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    d, n = odd(spark)
    assert len(OPERATORS[name](spark, d).collect()) == n
    assert OPERATORS[name](spark, none(spark)).collect() == []


def texts(seed, n, words=40):
    r = random.Random(seed)
    return [" ".join(r.choice(("alpha", "Beta", "gamma,", "delta", "eps.", "42", "zeta!")) for _ in range(r.randint(0, words))) for _ in range(n)]


# mixing


def test_mix_meets_targets(spark):
    rows = [(i, t, (None, "s0", "s0", "s0", "s1", "s2", "s3")[i % 7]) for i, t in enumerate(texts(1, 400))]
    out = mix.mix(documents(spark, rows)).collect()
    size = {i: len(WORD(t)) for i, t, _ in rows}
    by: dict = defaultdict(int)
    for i, _, s in rows:
        by[s] += size[i]
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    # the excess goes round until nobody is above twice its size
    goal, fixed = {}, {}
    while True:
        left = 1.5 * sum(by.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        goal = fixed | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > 2 * by[s] + 1e-9]
        if not over:
            break
        fixed |= {s: 2.0 * by[s] for s in over}
    source, taken = {i: s for i, _, s in rows}, defaultdict(int)
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == by[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        assert abs(r.target - goal[source[r.doc_id]]) < 1e-6
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in order)
    again = mix.mix(documents(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("knots", mix.SCHEDULES)
def test_inverse_demand(spark, knots):
    xs = [i / 50 for i in range(51)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", mix.inverse_demand(F.col("x"), knots).alias("t")).collect()
    grid = np.linspace(0, 1, 20001)
    rate = np.interp(grid, *zip(*knots, strict=True))
    demand = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
    for r in got:
        assert abs(np.interp(r.t, grid, demand / demand[-1]) - r.x) < 1e-6


def test_mix_deals_null_and_repeated_ids(spark):
    rows = [(None if i % 2 else 7, f"word {i} " * 3, "a") for i in range(900)]
    s = mix.streams(documents(spark, rows)).collect()
    assert len({r.bucket for r in s}) > 600 and sorted(r.start for r in s) == [6 * i for i in range(900)]
    assert sum(r.taken for r in mix.mix(documents(spark, rows)).collect()) == 1.5 * 5400


def test_mix_copies_are_whole(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts(2, 300))]
    s = {r.doc_id: r for r in mix.streams(documents(spark, rows)).collect()}
    got = defaultdict(int)
    for r in mix.copies(documents(spark, rows)).collect():
        got[rows[r.doc_id][2]] += s[r.doc_id].size
    for k in ("s0", "s1", "s2"):
        target = next(x.target for x in s.values() if rows[x.doc_id][2] == k)
        assert abs(got[k] - target) <= 40


# token counts


def test_token_counts_equal_a_unigram_tokenizer():
    from sentencepiece import sentencepiece_model_pb2 as pb
    from tokenizers import Tokenizer, models

    m = pb.ModelProto()
    m.ParseFromString(open(PATH2, "rb").read())
    vocab = [("<unk>", 0.0), *((p.piece, p.score) for p in m.pieces if p.type == 1), *((p.piece, 0.0) for p in m.pieces if p.type == 6)]
    ref, v, r = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True)), tokens.vocabulary(PATH2), random.Random(3)
    for _ in range(3000):
        x = "".join(r.choice("ab the\n  é中x😀▁") for _ in range(r.randint(0, 16)))
        assert v.count(x)[1] == (len(ref.encode(tokens.SPACE + x.replace(" ", tokens.SPACE)).ids) if x else 0)


# packing


def test_pack_loses_nothing(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts(5, 200, 400))] + [(1000, None, "s"), (1001, "", "s"), (1002, "nostop " * 12_000, "s"), (1003, "a<|endoftext|>b it's \x1c ÉÉ", "s")]
    t = pack.tokenizer(PATH3)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, _ in rows}
    out = pack.pack(documents(spark, rows).repartition(3), PATH3).collect()
    at, seq = defaultdict(int), defaultdict(list)
    for p in sorted(out, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        piece = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(piece)
        at[p.doc_id] += p.length
        seq[p.sequence_id].append((p.offset, p.length))
    assert at == {i: len(x) for i, x in ids.items()}
    padding = 0
    for pieces in seq.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= 4096
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    assert padding < 0.02 * sum(map(len, ids.values()))
    assert pack.pack(none(spark), PATH3).collect() == []


def test_every_character_encodes_as_the_tokenizer_does():
    t, e = pack.tokenizer(PATH3), pack.encoder(PATH3)
    for c in [*range(0x3000), *range(0xFE00, 0x10000), 0x1F600, 0x20000]:
        x = f"a{chr(c)}b c{chr(c)} {chr(c)}D"
        assert e.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids, hex(c)


def test_all_sentence_ends_are_offered():
    ends = np.zeros(10, bool)
    ends[3] = True
    points, cost = pack.cut_points(np.array([1, 3, 3, 1, 3, *[1] * 600, 3, 2]), ends)
    assert points.tolist() == [2, 3, 5, 261, 517, 606, 607]
    assert cost.tolist() == [pack.SENTENCE_PENALTY] * 3 + [pack.INNER_PENALTY] * 2 + [pack.SENTENCE_PENALTY, 0]
    assert pack.tail_windows(3000) == [2048, 512, 256, 128, 32, 16, 8] and pack.tail_windows(4000) == [4000]


def test_windows_are_the_cheapest():
    def cost(points, pen, window):
        p, c = [0, *points], [0, *pen]
        best = [0.0] + [math.inf] * (len(p) - 1)
        for j in range(1, len(p)):
            for i in range(j):
                n = p[j] - p[i]
                if n <= window:
                    x = best[i] + window - n
                    if n & (n - 1) == 0 and 64 <= n < window:
                        x = min(x, best[i] + pack.SENTENCE_PENALTY)
                    best[j] = min(best[j], x + c[j])
        return best

    for seed in range(60):
        r = random.Random(seed)
        window = r.choice((128, 256))
        points = np.cumsum([r.randint(1, window // 2) for _ in range(r.randint(1, 40))])
        pen = [r.choice((0, 0, 4, 64)) for _ in points]
        ends = pack.best_windows(points, np.array(pen), window)
        assert ends[-1] == points[-1]
        total, at, by = 0, 0, dict(zip(points.tolist(), pen, strict=True))
        for e in ends:
            n = e - at
            assert n <= window
            total += by[e] + (pack.SENTENCE_PENALTY if n & (n - 1) == 0 and 64 <= n < window and pack.SENTENCE_PENALTY < window - n else window - n)
            at = e
        assert total <= cost(points.tolist(), pen, window)[-1]


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t: str):
    out = []
    for k, (kind, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base_spans(spark):
    r = random.Random(6)
    bits = ("a@b.c", "@", "x.y", "+1 (988) 555-24", "85", "4111 1111 1111 1111", "1.2.3.4", ".5", "é😀", "\ue000", "\ue001", "+", " ", "-", "(", "9", "256", "e@f", "john [at] ex [dot] com ", "call 555-123-4567 ", "\n")
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 12))), "s") for i in range(1500)] + [(9000, "1.2.3.4 " * 900, "s"), (9001, "a@" + "b.c" * 9000, "s")]
    for x, (i, t, _) in zip(sorted(pii.digest(documents(spark, rows)).collect(), key=lambda x: x.doc_id), rows, strict=True):
        want = base_spans(t)
        assert x.doc_id == i and x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(x.spans.split(",")) or not want
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]


def test_method_adds_spans_and_masks(spark):
    rows = [(i, f"Please call 555-123-45{i:02d} today", "s") for i in range(40)] + [(99, "mail bob@x.org or +1 (269) 555-3296 now", "s"), (100, "call phone: 212-555-0188, thanks", "s")]
    d = documents(spark, rows)
    assert "phone:12:24" in next(r.spans for r in pii.digest(d).collect() if r.doc_id == 100)
    text = {r.doc_id: r.text for r in pii.redacted(d, "doc_id", "text").collect()}
    assert text[99] == "mail <email> or <phone> now"


def plain_weights(found):
    """The final classifier by plain expectation-maximisation over single candidates, and naive Bayes on its probabilities."""
    rows = [(c.kind, c.votes.split(":")[1], c.features) for r in found for c in r.c]
    p = np.array([(1 + v.count("1")) / (2 + v.count("1") + v.count("0")) for _, v, _ in rows])
    for kind in {k for k, _, _ in rows}:
        at = np.array([i for i, (k, _, _) in enumerate(rows) if k == kind])
        votes = np.array([list(rows[i][1]) for i in at])
        for _ in range(pii.ROUNDS):
            logs = []
            for q in (p[at], 1 - p[at]):
                one = np.full(len(at), math.log(q.sum() + 1))
                for j in range(pii.LABELERS):
                    n = {x: 1 + q[votes[:, j] == x].sum() for x in "10-"}
                    one += np.log([n[x] / sum(n.values()) for x in votes[:, j]])
                logs.append(one)
            new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
            done, p[at] = np.abs(new - p[at]).max() < 1e-9, new
            if done:
                break
    out = {}
    for kind in {k for k, _, _ in rows}:
        at = [i for i, (k, _, _) in enumerate(rows) if k == kind]
        q = (p[at], 1 - p[at])
        out[kind] = math.log((q[0].sum() + 1) / (q[1].sum() + 1))
        for slot in range(len(rows[0][2])):
            of = np.array([rows[i][2][slot] for i in at])
            more = (len(set(of)) + 1) / 2
            for v in set(of):
                out[v] = np.subtract(*(math.log((x[of == v].sum() + 0.5) / (x.sum() + more)) for x in q))
    return out


def test_the_classifier_decides_what_is_added(spark):
    r = random.Random(21)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    noise = lambda: "".join(r.choice("abcdefgh") for _ in range(24)) + "1"
    rows = [(i, r.choice((f'my token = "{hexes(40)}" here', f"see path/{noise()}_x/ there", f"part {r.randint(100, 999)} 555 1234 of", f"call (212) 555-{r.randint(1000, 9999)} now", f"id={noise()}", f"jane at mail dot org, tel 212-555-{r.randint(1000, 9999)}", "nothing", f"a@b.org and v {noise()}")), "s") for i in range(300)]
    d = documents(spark, rows)
    found = pii.candidates(pii.marked(d, "doc_id"), "doc_id").collect()
    want = plain_weights(found)
    got = pii.train(pii.candidates(pii.marked(d, "doc_id"), "doc_id"))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6
    out = {x.doc_id: x for x in pii.digest(d).collect()}
    added = 0
    for x in found:
        keep = sorted((c.start, pii.KINDS.index(c.kind), f"{c.kind}:{c.start}:{c.stop}") for c in x.c if c.base or sum(want[f] for f in [*c.features, c.kind]) > 0)
        assert out[x.doc_id].spans == ",".join(k[2] for k in keep) and out[x.doc_id].has_pii == bool(keep)
        added += out[x.doc_id].n_added
    assert 0 < added < sum(not c.base for x in found for c in x.c)
    assert all(out[i].has_pii for i, t, _ in rows if "token" in t) and not any(out[i].has_pii for i, t, _ in rows if t == "nothing")


def test_provided_documents_by_kind(spark):
    """Every document with an e-mail address, address, phone number or token of the provided form is found; nine of ten at least a kind."""
    from chunkloom.storage import table

    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    out = {x.doc_id: x for x in pii.digest(table(spark, "/root/testdata/sf0.01", "documents")).collect()}
    for rx in (r"[\w.]+@[\w-]+\.\w+", r"\+1 \(\d{3}\) 555-\d{4}", r'token = "[0-9a-f]{40}"'):
        have = [r.doc_id for r in d if re.search(rx, r.text or "")]
        assert have and sum(out[i].has_pii for i in have) >= 0.9 * len(have), rx
    assert sum(x.has_pii for x in out.values()) < 0.2 * len(out)


def test_reliabilities_separate_the_classes():
    p = pii.reliabilities({"phone:11111": 50, "phone:11-11": 40, "phone:00000": 60, "phone:0-000": 30, "phone:10101": 3})
    assert p["phone:11111"] > 0.9 and p["phone:00000"] < 0.1


# near copies


def near(seed: int):
    r = random.Random(seed)
    out = []
    for _ in range(160):
        w = [r.choice("abcdefghij") for _ in range(r.choice([0, 1, 3, 4, 6, 8, 9, 10, 11, 12, 14, 16, 18, 22, 40]))]
        for _ in range(r.randint(1, 5)):
            v = list(w)
            for _ in range(r.randint(0, 2)):
                if v:
                    z = r.randrange(len(v))
                    v = r.choice([v[:z] + v[z + 1 :], v[1:], [*v, "q"], [*v[:z], "z", *v[z:]]])
            out.append(" ".join(v).upper() if r.random() < 0.3 else "\t".join(v))
    return out


@pytest.mark.parametrize(("k", "t"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, t):
    rows = [(i, x, "s") for i, x in enumerate(near(k))] + [(5000, None, "s"), (5001, "", "s")]
    sets = {}
    for i, x, _ in rows:
        w = [z.lower() for z in WORD(x or "")]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for x in ids:
        for y in ids[: ids.index(x)]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= t * len(a | b):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    for r in jaccard.join(documents(spark, rows), k, t).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


def test_words_of_regular_shape_do_not_collide(spark):
    """The Thue-Morse word and its complement, which polynomials modulo powers of two can't tell apart."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a, "s"), (2, a.translate(str.maketrans("ab", "ba")), "s"), (3, f"{a} x y z", "s")]
    assert {r.doc_id: r.component_id for r in jaccard.join(documents(spark, rows)).collect()} == {1: 1, 2: 2, 3: 3}


def test_rows_under_one_id_are_vertices_of_their_own(spark):
    x, y = "one two three four five six", "seven eight nine ten eleven twelve"
    got = jaccard.join(documents(spark, [(1, x, "s"), (3, x, "s"), (3, y, "s"), (4, y, "s"), (None, y, "s"), (None, "no other", "s")]))
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got.collect()))) == sorted(map(str, [(1, 1), (3, 1), (3, 3), (4, 3), (None, 3), (None, None)]))


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    """A group of many near copies, of which none equals another, in blocks far smaller than it."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        v = list(base)
        for _ in range(r.randint(1, 4)):
            v[r.randrange(len(v))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(v), "s"))
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(117)} for i, t, _ in rows}
    root = list(range(90))
    for x in range(90):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = root[x], root[y]
                root = [min(a, b) if z in (a, b) else z for z in root]
    assert {r.doc_id: r.component_id for r in jaccard.join(documents(spark, rows)).collect()} == dict(enumerate(root))


# media


def test_media_round_trip(spark):
    rows = [(1, "x" * 64, "s"), (2, "", "s"), (3, None, "s"), (4, "RIFF BM GIF89a é" * 9, "s"), (5, "x" * 64, "s")]
    out = {r.doc_id: r for r in media.digest(documents(spark, rows)).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r.feature.startswith("audio/wav;") and r.media_bytes == len(want) + 44
    assert out[1].feature == out[5].feature and out[1].media_sha256 == out[5].media_sha256


def png() -> bytes:
    part = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", bytes(13)) + part(b"IDAT", zlib.compress(b"\0")) + part(b"IEND", b"")


def test_sniffing_validates_and_carves():
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0x80, 0, 0]) + bytes(6) + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x4c\x01\0" + b";"
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(40)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02zz\xff\0z\xff\xd9"
    a = media.automaton()
    for kind, x in (("image/png", png()), ("image/gif", gif), ("image/bmp", bmp), ("image/jpeg", jpeg), ("audio/wav", media.wav_of(b"abc"))):
        found = media.sniff(b"junk" + x + b"tail", a)
        assert [(f["type"], f["offset"], f["length"]) for f in found] == [(kind, 4, len(x))], kind
        assert not media.sniff(x[: len(x) // 2], a)
    broken = bytearray(png())
    broken[20] ^= 1
    assert not media.sniff(bytes(broken), a)


# toxicity


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(9)
    plain = [f"{a}{b}" for a in ("tor", "lim", "sen", "pad", "gru") for b in ("a", "en", "is", "o", "ux", "eth")]
    rude = ("scoundrel", "nitwit", "wretch", "dolt")
    rows, marks = [], []
    for i in range(900):
        w = [r.choice(plain) for _ in range(r.randint(4, 120))]
        y = i % 6 == 0
        for _ in range(r.randint(2, 5) if y else 0):
            w.insert(r.randrange(len(w)), r.choice(rude))
        rows.append((i, " ".join(w).capitalize() + ".", "s"))
        marks.append((i, 1, int(y)))
    out = toxic.score(documents(spark, rows), labels(spark, marks)).collect()
    for x in out:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
    held = [x for x in out if x.held_out]
    wrong = sum(x.predicted != marks[x.doc_id][2] for x in held)
    assert wrong <= 0.02 * len(held)


def test_held_out_labels_change_nothing(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts(11, 120))]
    marks = [(i, 1, i % 2) for i in range(120)]
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in marks]
    d = documents(spark, rows)
    a, b = ({r.doc_id: r.score for r in toxic.score(d, labels(spark, m)).collect()} for m in (marks, flipped))
    assert a == b


def test_curve_keeps_the_share_of_toxic_rows(spark):
    """Where the cap takes another part of each class, rows stand for as many as were left out: the score of an evidence stays."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, (8000, 1)), r.normal(2, 1, (1000, 1))])
    y = np.repeat([0.0, 1.0], [8000, 1000])
    part = np.r_[:1000, 8000:9000]
    score = lambda w: 1 / (1 + np.exp(-(1.5 * w[0] + w[1])))
    whole, capped = score(toxic.curve(x, y)), score(toxic.curve(x[part], y[part], {0: 8.0, 1: 1.0}))
    assert abs(whole - capped) < 0.05 < score(toxic.curve(x[part], y[part])) - whole
    marks = labels(spark, [(i, 1, int(i % 9 == 0)) for i in range(900)])
    n = {t: sum(zlib.crc32(str(i).encode()) % 3 != 1 and (i % 9 == 0) == t for i in range(900)) for t in (0, 1)}
    assert toxic.stands_for(marks, 100) == {0: n[0] / 100, 1: 1.0}


@pytest.mark.parametrize("phrase", ["limba tornit", "vornix vornax"])
def test_a_fixed_phrase_of_toxic_rows_counts(spark, phrase):
    """Its second word always follows the first, which ordinary rows have or haven't; other words share its first letters."""
    r = random.Random(5)
    plain = [f"{a}{b}" for a in ("torn", "limb", "vorn", "sent", "padd") for b in ("a", "en", "is", "o", "ux", "eth")]
    other = [f"{a}{b}{c}" for a in "bdgklm" for b in ("ar", "el", "in", "os", "um") for c in ("ta", "ne", "ri", "so", "lu", "ke", "da", "pi")]
    rows, marks = [], []
    for i in range(900):
        w = [r.choice(plain if r.random() < 0.3 else other) for _ in range(r.randint(8, 30))]
        if i % 6 == 0:
            w.insert(r.randrange(len(w)), phrase)
        rows.append((i, " ".join(w), "s"))
        marks.append((i, 1, int(i % 6 == 0)))
    model, _ = toxic.train(documents(spark, rows), labels(spark, marks))
    place = {w: i for i, w in enumerate(model.words.to_pylist())}
    a, b = (model.h[place[w]] for w in phrase.split())
    assert toxic.pair_key(a, b) in set(model.keys.tolist())
    out = toxic.score(documents(spark, rows), labels(spark, marks)).where("held_out").collect()
    above, below = ([x.score for x in out if marks[x.doc_id][2] == y] for y in (1, 0))
    assert np.mean([x > y for x in above for y in below]) >= 0.98


def test_words_are_counted_exactly(spark):
    """However many other words the documents have: none of them adds to a word of the sample."""
    rows = [(i, "Nitwit nitwit, lim." if i % 2 else "lim " + " ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + i // 26)}" for j in range(600)), "s") for i in range(400)]
    marks = [(i, 1, i % 2) for i in range(40)]
    d = documents(spark, rows).repartition(3)
    words = pa.array(["nitwit", "lim", "absent"])
    total = sum(len(toxic.words_of(t)) for _, t, _ in rows)
    assert {r.word: r.n for r in toxic.shared_counts(d, words).collect()} == {"nitwit": 400, "lim": 400, None: total}
    assert toxic.shared_counts(documents(spark, []), words).collect() == []


def kneser_ney(texts, every):
    """log P of a text's words by one class's model, plainly: texts are the class's, every those that the classes share."""
    words = lambda t: toxic.words_of(t.lower())
    share = defaultdict(int)
    for t in every:
        for w in words(t):
            share[w] += 1
    tokens = sum(share.values())
    triples = {x for t in texts for x in zip(["", "", *words(t)], ["", *words(t)], words(t), strict=False)}
    pair, before = defaultdict(int), defaultdict(int)
    for _, v, w in triples:
        pair[v, w] += 1
        before[w] += 1
    mass = sum(min(x, toxic.DISCOUNT) for x in before.values())
    alone = lambda w: (max(before.get(w, 0) - toxic.DISCOUNT, 0) + mass * share[w] / tokens) / len(triples)

    def p(v, w):
        behind = {x: c for (u, x), c in pair.items() if u == v}
        if v == "" or not behind:
            return alone(w)
        return (max(behind.get(w, 0) - toxic.DISCOUNT, 0) + sum(min(c, toxic.DISCOUNT) for c in behind.values()) * alone(w)) / sum(behind.values())

    return p, set(share)


def test_models_are_plain_kneser_ney(spark):
    r = random.Random(12)
    say = lambda n, of: " ".join(r.choice(of) for _ in range(n))
    common, rude = [f"{a}{b}" for a in ("tor", "lim", "sen") for b in ("a", "en", "is", "o")], ["nitwit", "wretch", "dolt"]
    rows = [(i, say(r.randint(1, 60), common + (rude if i % 4 == 0 else []) + [f"rare{r.choice('abcdefgh')}"]), "s") for i in range(240)]
    marks = [(i, 1, int(i % 4 == 0)) for i in range(0, 240, 2)] + [(i, 1, 0) for i in range(1, 240, 4)]
    d = documents(spark, rows)
    model, w = toxic.train(d, labels(spark, marks))
    known = {r.doc_id: r.toxic for r in toxic.trainable(labels(spark, marks)).where("not fits").collect()}
    assert set(known) < {i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 3 != 1}
    every = [t for _, t, _ in rows]
    (a, vocabulary), (b, _) = (kneser_ney([rows[i][1] for i, y in known.items() if y == c], every) for c in (1, 0))
    for v in ("", "tora", "nitwit", "neverseen"):  # nothing is pruned: either model's mass is 1
        for p in (a, b):
            assert abs(sum(p(v, x) for x in vocabulary) - 1) < 1e-9
    score = toxic.Scorer(model)
    for i in range(0, 240, 7):
        words = toxic.words_of(rows[i][1].lower())
        plain = [math.log(a(v, x) / b(v, x)) - model.unknown for v, x in zip(["", *words], words, strict=False)]
        assert np.abs(score.ratios(words)[1] - plain).max() < 1e-9
        alone = {score.place(x, -1): min(math.log(a("", x) / b("", x)) - model.unknown, toxic.BOUND) for x in words}
        worst = sum(sorted(alone.values(), reverse=True)[: toxic.WORST]) / toxic.WORST
        assert np.abs(score.evidence([None, rows[i][1], "", rows[i][1]])[[1, 3]] - (sum(plain) / len(words), worst, math.log1p(len(words)))).max() < 1e-9
    got = {x.doc_id: x.score for x in toxic.score(d, labels(spark, marks)).collect()}
    for i in range(0, 240, 7):
        x = score.evidence([rows[i][1]])[0]
        assert abs(got[i] - 1 / (1 + math.exp(-(np.dot(x, w[:3]) + w[3])))) < 1e-9


@pytest.mark.parametrize("block", [8, 2048])
def test_all_links_are_counted(spark, monkeypatch, block):
    """Against brute force over classes of equal sets; without the links the components are the same."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, x, "s") for i, x in enumerate(near(4)[:200])]
    rows += [(1000 + i, " ".join(["y" + str(i % 30) if j == 7 * (i % 8) else w for j, w in enumerate(base)]) if i else " ".join(base), "s") for i in range(40)]
    rows += [(2000 + i, rows[r.randrange(200)][1], "s") for i in range(20)]
    sets = {}
    for i, x, _ in rows:
        w = [z.lower() for z in WORD(x)]
        sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    classes = set(sets.values()) - {frozenset()}
    links = {a: sum(a != b and 100 * len(a & b) >= 85 * len(a | b) for b in classes) for a in classes}
    got = jaccard.join(documents(spark, rows)).collect()
    assert {x.doc_id: x.n_links for x in got} == {i: links.get(x, 0) for i, x in sets.items()}
    if block == 8:
        assert {x.doc_id: x.component_id for x in jaccard.join(documents(spark, rows), all_links=False).collect()} == {x.doc_id: x.component_id for x in got}


def test_the_query_makes_every_link(spark, tmp_path, monkeypatch):
    """Near copies that all link: pairs that join no components are made as well, and SQL counts as many."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(["y" + str(i) if j == 7 * (i % 8) else w for j, w in enumerate(base)]), "s") for i in range(24)] + [(100, " ".join(base), "s"), (101, " ".join(base), "s"), (102, None, "s")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    made = []
    staged = jaccard.staged

    def kept(d, name):
        out = staged(d, name)
        if name in ("jaccard-links", "jaccard-rest"):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "staged", kept)
    for name in ("op6_jaccard", "jaccard_links"):
        got = Q.QUERIES[name](spark, str(tmp_path))
        want = con.execute(Q.ORACLES[name])
        assert got.columns == [c[0] for c in want.description]
        want = sorted(want.fetchall())
        assert sorted(map(tuple, got.collect())) == want
    number = {r[0]: r[3] for r in want if r[0] != 101}  # 100 and 101 are one class
    assert [2 * sum(made[:2]), 2 * sum(made[2:])] == [sum(number.values())] * 2 and max(number.values()) > 1


def test_triples_hold_little(monkeypatch):
    """A worker forgets what stages before kept, and holds a bounded number of words; the rows are those of sets of all texts."""
    import tracemalloc
    from unittest.mock import MagicMock

    from chunkloom.llm import worker

    class Sample:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def groupBy(self, *_):
            return MagicMock()

    monkeypatch.setattr(toxic, "F", MagicMock())
    sample = Sample()
    toxic._triples(sample)
    r = random.Random(2)
    texts = [" ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(500)) for _ in range(1000)] + [None, "", "Tail tail tail tail tail"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(len(texts))], pa.int64())], names=["text", "toxic"])
    monkeypatch.setattr(worker, "_held", {"encoder": "of the stage before"})
    got, rows = set(), []
    tracemalloc.start()
    for x in sample.run(iter([batch])):
        rows.append(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert worker._held == {} and peak < 50e6 and max(x.num_rows for x in rows) <= 1 << 16
    for x in rows:
        got.update(zip(*(c.to_pylist() for c in x.columns), strict=True))
    want = set()
    for i, t in enumerate(texts):
        words = toxic.words_of((t or "").lower())
        want.update((i % 2, *x) for x in zip(["", "", *words], ["", *words], words, strict=False))
    assert got == want


@pytest.mark.parametrize("block", [16, 2048])
def test_links_of_a_large_group_are_counted_not_made(spark, monkeypatch, block):
    """All links of near copies are counted, against brute force, and no table of a pair's steps has a row for each of them."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    base, size = [f"w{i}" for i in range(120)], 80
    rows = [(i, " ".join([f"y{i}" if j == 7 * i % 120 else w for j, w in enumerate(base)]), "s") for i in range(size)]
    rows.append((size, " ".join([*base, "z"]), "s"))
    made, staged = {}, jaccard.staged

    def kept(d, name):
        out = staged(d, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "staged", kept)
    got = {x.doc_id: x.n_links for x in jaccard.join(documents(spark, rows)).collect()}
    sets = {i: frozenset(tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)) for i, t, _ in rows}
    classes = set(sets.values())
    assert got == {i: sum(s != x and 100 * len(s & x) >= 85 * len(s | x) for x in classes) for i, s in sets.items()}
    links = sum(got.values()) // 2
    assert links > 10 * size
    pairs = ("jaccard-stars", "jaccard-links", "jaccard-more", "jaccard-rest-left", "jaccard-rest", "jaccard-across-left", "jaccard-across")
    assert sum(made.get(n, 0) for n in pairs) < links

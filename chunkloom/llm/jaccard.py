"""N-gram Jaccard join by the size-aware heavy-light method.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold t.

1. Rows with equal sets are one class; its smallest doc_id stands for it, so copies never meet in pairs.
2. Light classes (sizes from `smallest` up to a boundary) enumerate fixed-size subsets: a linked pair of sizes a <= b shares
   some subset of c(a, b) shingles. Heavy classes go into inverted lists, of which only a prefix under one global order of
   the shingles is kept: the first n - ceil(t n) + 1. The order puts shingles that are frequent in the corpus last. The
   boundary comes from the cost of both ways over the sizes found. Sets below `smallest` link only when equal.
3. Lists are scanned. First every member meets its list's smallest id only, so a group of near copies costs one pair a
   member and list, not all pairs. Verified links give components. Then members of one list that are in different
   components meet as well, so no link is lost that could change a component.
   Long lists are cut into blocks, a task gets two of them at most.
   All links lie within the components that this gives. Where their number is asked for, the members of a component meet
   with whole sets, in blocks again, and every pair is verified there; each block gives its members' numbers of links.
4. Pairs are refuted by sizes and by a histogram of the set in CELLS cells (exact bounds), in the second step before they
   become rows; the others are verified on whole sets, which are read again from the texts of the rows concerned.

Any global order gives the same result, so the frequent shingles (at most MAX_FREQUENT, sent to every task) may be found
approximately. Sets are of 64-bit hashes: two unequal shingles agree with a chance of 2^-64, and a wrong link needs a set
full of such pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import worker
from chunkloom.llm.shingles import mix64, shingle_sets
from chunkloom.storage import staged

MAX_FREQUENT, FLUSH_TOKENS, FREQUENT_IN_TASK, SENT_BY_FLUSH = 100_000, 1_000_000, 3, 20_000
#: The boundary is searched up to MOST_LIGHT words, where a set has about 1,000 subsets; larger sets go to the lists, so no link depends on it.
CELLS, MOST_LIGHT = 256, 16
BLOCK = 1024  # members of a list or component that meet in one task
BLOCK_SHINGLES = 1 << 21  # of a component's members in one block, about
ROW_LINKS = 32  # classes of a component up to which each link is a row; of larger ones links are counted where they are verified
#: log2 of the bits of the filter of ids whose texts are read again: 16 an id between these, so 16 MB at most. It only spares work.
LEAST_BITS, MOST_BITS = 20, 27


def need(a: int, b: int, t: int) -> int:
    """Common shingles that sets of a and b need for a similarity of t percent."""
    return -(-t * (a + b) // (100 + t))


def partners(n: int, t: int) -> range:
    """Sizes that can link with n."""
    return range(-(-t * n // 100), 100 * n // t + 1)


def smallest(t: int) -> int:
    """The least size of a set that can link with a different one (its own with one more): 6 at 85 percent, 4 at 80."""
    return -(-t // (100 - t))


def prefix_length(n: int, t: int) -> int:
    return n - -(-t * n // 100) + 1


def subset_sizes(n: int, boundary: int, t: int) -> list[int]:
    return sorted({need(n, b, t) for b in partners(n, t) if smallest(t) <= b <= boundary and need(n, b, t) <= min(n, b)})


def choose_boundary(sizes: dict[int, int], list_length: float, t: int) -> int:
    """The light sets' largest size at the least cost: subsets enumerated below it, list entries scanned above it."""

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if smallest(t) <= n <= x:
                total += count * sum(comb(n, c) for c in subset_sizes(n, x, t))
            if n >= smallest(t) and 100 * n >= t * (x + 1):
                total += count * prefix_length(n, t) * list_length
        return total

    return min(range(smallest(t) - 1, MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def _inventory(docs: DataFrame, k: int) -> DataFrame:
    """One row a document: doc_id, n, the set's digest (two longs), text_hash; and rows with n null: tokens that are frequent in a task (tok, cnt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.clear()
        held: list[np.ndarray] = []
        seen: set[int] = set()
        waiting = 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = np.flatnonzero(counts >= FREQUENT_IN_TASK)
            often = often[np.argsort(-counts[often], kind="stable")[:SENT_BY_FLUSH]]
            none = pa.nulls(len(often), pa.int64())
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=NAMES)

        for b in batches:
            n, hi, lo = [], [], []
            for s in shingle_sets(b.column(1), k):
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                hi.append(digest >> 64)
                lo.append(digest & (1 << 64) - 1)
                if digest not in seen:
                    seen.add(digest)
                    held.append(s)
                    waiting += len(s)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hi, lo)), b.column(2), none, none], names=NAMES)
            if waiting >= FLUSH_TOKENS:
                yield flush()
                waiting = 0
        yield flush()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, n long, hi long, lo long, text_hash long, tok long, cnt long")


NAMES = ["doc_id", "n", "hi", "lo", "text_hash", "tok", "cnt"]


def _keys(s: np.ndarray, boundary: int, t: int, order: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The lists that a set is in: subsets' keys if it is light, its prefix if it may link with a heavy one."""
    n, out = len(s), []
    if n < smallest(t):
        return np.empty(0, np.uint64)
    if n <= boundary:
        m = mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        whole = m.sum()
        for c in subset_sizes(n, boundary, t):
            gone = np.array([m[list(x)].sum() if x else np.uint64(0) for x in combinations(range(n), n - c)], np.uint64)
            out.append(mix64((whole - gone) + np.uint64(c)))
    if 100 * n >= t * (boundary + 1):
        p = prefix_length(n, t)
        at = np.searchsorted(frequent, s)
        at[at == len(frequent)] = 0
        heavy = frequent[at] == s if len(frequent) else np.zeros(n, bool)
        light = s[~heavy]
        if len(light) < p:
            late = s[heavy]
            late = late[np.argsort(order[at[heavy]], kind="stable")]
            light = np.concatenate([light, late])
        out.append(light[:p])
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _lists(docs: DataFrame, k: int, t: int, boundary: int, held) -> DataFrame:
    """doc_id, n, keys (of its lists) and cells (histogram) of every row that can link with a different set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.clear()
        frequent, order = held.value
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            with np.errstate(over="ignore"):
                for i, s in zip(ids, shingle_sets(b.column(1), k), strict=True):
                    if len(s) >= smallest(t):
                        out.append((i, len(s), _keys(s, boundary, t, order, frequent).view(np.int64), np.minimum(np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 127).astype(np.int8)))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(cols, kinds, strict=True)], names=["doc_id", "n", "keys", "cells"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, keys array<long>, cells array<byte>")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and set of the rows whose ids are in `ids`, from their texts. A bitmap of hashed ids keeps other texts out before any shuffle."""
    spark = docs.sparkSession
    bits = min(max((16 * ids.count()).bit_length(), LEAST_BITS), MOST_BITS)
    bit = F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)
    got = ids.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    held = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(2).to_numpy()
            b = b.filter(pa.array((held.value[h >> 6] >> (h & 63)) & 1 == 1))
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([s.view(np.int64) for s in shingle_sets(part.column(1), k)], pa.list_(pa.int64()))], names=["id", "set"])

    rows = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null").select("id", "text", bit.alias("h"))
    return rows.mapInArrow(run, "id long, set array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, t: int, name: str) -> DataFrame:
    """Of the pairs (a, b) those that link. Sizes and histograms refute most of the others before sets are read."""
    cells = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}"))
    p = pairs.join(cells("a"), "a").join(cells("b"), "b")
    apart = F.expr("aggregate(zip_with(ca, cb, (x, y) -> abs(cast(x as int) - y)), 0, (s, x) -> s + x)")
    # common <= (na + nb - apart) / 2, and a link needs (100 + t) * common >= t * (na + nb)
    p = staged(p.where((100 + t) * (F.col("na") + F.col("nb") - apart) >= 2 * t * (F.col("na") + F.col("nb"))).select("a", "b"), f"{name}-left")
    ids = staged(p.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
    sets = staged(_sets(docs, ids, k).join(ids, "id", "left_semi"), f"{name}-sets")
    both = p.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where((100 + t) * common >= t * (F.size("sa") + F.size("sb"))).select("a", "b").distinct()


def _across(members: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b), a > b, of members of one list in different components that sizes and histograms don't refute.

    members: key, c (the list's length), doc_id, n, label, cells. Blocks are dealt by hash, so a group has about 2 * BLOCK rows.
    """
    n_blocks = F.ceil(F.col("c") / BLOCK)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("doc_id"), n_blocks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "n", "label", "cells")

    def run(group: pa.Table) -> pa.Table:
        ids, n, label, block = (group.column(c).to_numpy() for c in ("doc_id", "n", "label", "block"))
        cells = group.column("cells").combine_chunks().flatten().to_numpy().reshape(len(ids), CELLS).astype(np.int16)
        one_block = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        out: list[np.ndarray] = []
        for x in range(len(ids)):
            ok = (ids < ids[x]) & (label != label[x]) & (100 * np.minimum(n, n[x]) >= t * np.maximum(n, n[x]))
            at = np.flatnonzero(ok if one_block else ok & (block != block[x]))
            if len(at):
                apart = np.abs(cells[at] - cells[x]).sum(axis=1, dtype=np.int64)
                at = at[(100 + t) * (n[at] + n[x] - apart) >= 2 * t * (n[at] + n[x])]
                out.append(np.column_stack([np.full(len(at), ids[x]), ids[at]]))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _within(sets: DataFrame, members: DataFrame, t: int) -> DataFrame:
    """All links within components: rows (a, b, null), a > b, of those with at most ROW_LINKS members; of the others (id, null, links to a block).

    sets: id, set. members: id, label, c (the component's members), w (their shingles). Every pair is compared by its whole sets, exactly.
    """
    n_blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("w") / BLOCK_SHINGLES))
    dealt = sets.join(members, "id").withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("id"), "n_blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    dealt = dealt.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "c", "set")
    rows = ROW_LINKS

    def run(group: pa.Table) -> pa.Table:
        ids, block = group.column("id").to_numpy(), group.column("block").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        held = group.column("set").combine_chunks()
        n = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        of, code = np.repeat(np.arange(len(ids)), n), np.unique(held.flatten().to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        of, code = of[order], code[order]
        often = np.bincount(code)[code] > 1  # others have nothing in common
        of, code = of[often], np.cumsum(np.diff(code[often], prepend=-1) != 0) - 1
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        common = np.zeros((len(left), len(right)), np.int64)
        for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 1024):
            at = slice(*np.searchsorted(code, [lo, lo + 1024]))
            has = np.zeros((1024, len(ids)), np.float32)
            has[code[at] - lo, of[at]] = 1
            common += (has[:, left].T @ has[:, right]).astype(np.int64)
        linked = ((100 + t) * common >= t * (n[left][:, None] + n[right][None, :])) & (ids[left][:, None] != ids[right][None, :])
        if group.column("c")[0].as_py() <= rows:
            x, y = np.nonzero(linked if i != j else np.triu(linked))
            a, b = ids[left[x]], ids[right[y]]
            return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64()), "links": pa.nulls(len(a), pa.int64())})
        degree = np.zeros(len(ids), np.int64)
        degree[left] += linked.sum(axis=1)
        if i != j:
            degree[right] += linked.sum(axis=0)
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.nulls(len(ids), pa.int64()), "links": pa.array(degree, pa.int64())})

    return dealt.groupBy("label", "i", "j").applyInArrow(run, "a long, b long, links long")


def _degrees(docs: DataFrame, links: DataFrame, labels: DataFrame, reps: DataFrame, k: int, t: int) -> DataFrame:
    """rep, n_links of every class that links. links: of all classes with their lists' smallest ids."""
    ids = reps.select(F.col("doc_id").alias("id"), "n").join(labels.withColumnRenamed("v", "id"), "id")
    sizes = ids.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    members = staged(ids.join(sizes, "label").select("id", "label", "c", "w"), "jaccard-members")
    within = staged(_within(_sets(docs, members.select("id").distinct(), k), members, t), "jaccard-within")
    rest = staged(within.where("b is not null").select("a", "b").distinct().join(links, ["a", "b"], "left_anti"), "jaccard-rest")
    small = members.where(F.col("c") <= ROW_LINKS).select(F.col("id").alias("a")).distinct()
    row = links.join(small, "a", "left_semi").select("a", "b").unionByName(rest)
    one = F.lit(1).cast("long").alias("links")
    ends = row.select(F.col("a").alias("rep"), one).unionByName(row.select(F.col("b").alias("rep"), one))
    return ends.unionByName(within.where("b is null").select(F.col("a").alias("rep"), "links")).groupBy("rep").agg(F.sum("links").alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """v, label: the smallest vertex reachable by edges (a, b), for every vertex that has one.

    Each round takes the smallest label among the neighbours and then that label's own label, so chains halve.
    """
    both = staged(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct(), "cc-edges")
    labels = staged(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("label").alias("other")), "u").groupBy("v").agg(F.min("other").alias("other"))
        step = labels.join(near, "v").select("v", F.least("label", "other").alias("next"), F.col("label").alias("was"))
        over = labels.select(F.col("v").alias("next"), F.col("label").alias("jump"))
        step = staged(step.join(over, "next", "left").select("v", F.least("next", F.coalesce("jump", "next")).alias("label"), "was"), "cc-step")
        labels = step.select("v", "label")
        if step.where("label <> was").isEmpty():
            return labels


def join(docs: DataFrame, k: int = 4, t: int = 85, all_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (xxhash64 of the text) and n_links of every row.

    component_id: the smallest doc_id reachable by links. n_links: all links of the row's class to other classes (rows of
    equal sets are a class); every pair of a component is verified for it. Without all_links there is no such column, and
    pairs of one component that can't change it aren't verified. Null and empty texts
    have no shingles and link with nothing. Rows are the vertices: rows of one id with different texts are documents of
    their own and don't link their groups. Rows with a null id are alone, with a null component, unless an equal set has an
    id. Other columns are not read. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    inventory = staged(_inventory(docs, k), "jaccard-inventory")
    rows, tokens = inventory.where("n is not null"), inventory.where("n is null")
    frequent = tokens.groupBy("tok").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "tok").limit(MAX_FREQUENT).toArrow()
    toks = frequent.column("tok").to_numpy().view(np.uint64)
    place = np.argsort(toks, kind="stable")
    rank = len(toks) - np.arange(len(toks))  # the most frequent is the last in the order
    held = spark.sparkContext.broadcast((toks[place], rank[place]))
    small = {r["n"]: r["c"] for r in rows.where(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").agg(F.count("*").alias("c")).collect()}
    total = rows.agg(F.sum("n")).first()[0] or 0
    list_length = 1 + (float(np.sum(frequent.column("cnt").to_numpy())) / total if total else 0.0)
    boundary = choose_boundary(small, list_length, t)
    classes = staged(rows.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    ids = classes.where("rep is not null").select(F.col("rep").alias("doc_id"))
    reps = staged(_lists(docs, k, t, boundary, held).join(ids, "doc_id", "left_semi"), "jaccard-lists")
    entries = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    # list members with their list's smallest id; lists of one are gone
    hubs = entries.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.max("doc_id").alias("last")).where("hub.doc_id < last").select("key", "hub")
    lists = staged(entries.join(hubs, "key").select("key", "doc_id", "n", "hub"), "jaccard-shared")
    alike = lambda a, b: (100 * F.least(a, b) >= t * F.greatest(a, b))
    stars = lists.where((F.col("doc_id") != F.col("hub.doc_id")) & alike(F.col("n"), F.col("hub.n"))).select(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b")).distinct()
    stars = staged(stars, "jaccard-stars")
    links = staged(_verified(docs, stars, reps, k, t, "jaccard-star"), "jaccard-links")
    labels = components(links)
    # members of one list in different components
    own = lists.join(labels.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
    mixed = own.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")).where("x < y and c > 2").select("key", "c")
    more = _across(own.join(mixed, "key").join(reps.select("doc_id", "cells"), "doc_id"), t).distinct().join(stars, ["a", "b"], "left_anti")
    found = staged(_verified(docs, staged(more, "jaccard-more"), reps, k, t, "jaccard-across"), "jaccard-across")
    if not found.isEmpty():
        labels = components(links.unionByName(found))
    component = F.coalesce("label", "rep", "doc_id").alias("component_id")
    known = classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    if not all_links:
        return rows.join(known, ["hi", "lo"], "left").select("doc_id", F.col("n").alias("n_shingles"), component, "text_hash")
    degree = _degrees(docs, links, labels, reps, k, t)
    out = rows.join(known.join(degree, "rep", "left"), ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component, "text_hash", F.coalesce("n_links", F.lit(0)).alias("n_links"))

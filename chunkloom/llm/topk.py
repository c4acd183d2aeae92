"""Exact top-k inner products with Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt to hashed blocks of bounded size, once; only the queries, which are few, are sent to every block. A
task streams a block's candidates, sorts every dimension once, and then takes the block's queries as they come: all lists
are read downwards together (from the top where the query's component is positive, from the bottom where it is negative),
new candidates are scored in full, and reading stops once the bound on anything unread is below the k-th score. A window over
the blocks' winners gives the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CANDIDATE_BLOCK, FIRST_DEPTH = 8192, 32
_OUT = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def threshold_topk(q: np.ndarray, own: int, ids: np.ndarray, c: np.ndarray, order: np.ndarray, ranked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one query; ties to the smaller id. order, ranked: each dimension's candidates and values, largest first."""
    n, used = len(ids), np.flatnonzero(q)
    seen, best_ids, best = np.zeros(n, bool), np.empty(0, np.int64), np.empty(0, c.dtype)
    if not len(used):
        take = np.argsort(ids, kind="stable")
        take = take[ids[take] != own][:k]
        return ids[take], np.zeros(len(take), c.dtype)
    up, down = used[q[used] > 0], used[q[used] < 0]
    done, depth = 0, min(FIRST_DEPTH, n)
    while True:
        got = np.concatenate([order[done:depth, up].ravel(), order[n - depth : n - done, down].ravel()])
        new = np.unique(got[~seen[got]])
        seen[new] = True
        new = new[ids[new] != own]
        best_ids, best = np.concatenate([best_ids, ids[new]]), np.concatenate([best, c[new] @ q])
        keep = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[keep], best[keep]
        bound = ranked[depth - 1, up] @ q[up] + ranked[n - depth, down] @ q[down]
        if depth == n or (len(best) == k and best[-1] > bound):
            return best_ids, best
        done, depth = depth, min(2 * depth, n)


def _matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x), short vectors filled with 0. Float64 holds the sums exactly up to 2^53; larger values go to Python integers."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return out


class Block:
    """The candidates of one block with their sorted lists."""

    def __init__(self, ids: list[np.ndarray], vectors: list[np.ndarray]):
        width = max((v.shape[1] for v in vectors), default=0)
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        self.c = np.concatenate([_wide(v, width) for v in vectors]) if vectors else np.zeros((0, 0))
        self.order = np.argsort(-self.c, axis=0, kind="stable")
        self.ranked = np.take_along_axis(self.c, self.order, axis=0)
        self.most = np.abs(self.c).max(initial=0)

    def best(self, owners: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, ids and scores of each query's k best."""
        c, ranked, width = self.c, self.ranked, max(self.c.shape[1], queries.shape[1])
        queries = _wide(queries, width)
        if self.most * np.abs(queries).max(initial=0) * max(width, 1) >= 2**53:
            c, ranked, queries = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (c, ranked, queries))
        queries = queries[:, : c.shape[1]]  # beyond it every candidate has 0
        for i, own in enumerate(owners.tolist()):
            yield i, *threshold_topk(queries[i], own, self.ids, c, self.order, ranked, k)


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products among all other vec_ids.

    Inputs hold (vec_id, embedding). Vectors that are null or hold null or non-finite components take no part, nor do null
    vec_ids; missing components of shorter vectors count as 0. Candidates with the query's own vec_id are left out, other
    repeated rows count one by one; a query row that is repeated is asked once, two vectors under one vec_id are two queries.
    Scores beyond a long are clipped to its range. Ties go to the smaller vec_id. Other columns are not read. Without
    candidates or queries there are no rows.
    """
    valid = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    c, q = vectors.select("vec_id", "embedding").where(valid), queries.select("vec_id", "embedding").where(valid).distinct()
    n = max(1, -(-c.count() // CANDIDATE_BLOCK))
    dealt = c.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", F.lit(0).cast("long").alias("query"), "embedding")
    asked = q.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", F.xxhash64("embedding").alias("query"), "embedding")
    rows = dealt.unionByName(asked).repartition(n, "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, block = None, [], [], None
        for b in batches:
            at, asks, vec = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            out: list[tuple] = []
            edges = np.flatnonzero(np.diff(at * 2 + asks)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                if lo == hi:
                    continue
                if at[lo] != number:
                    number, ids, parts, block = at[lo], [], [], None
                m = _matrix(b.column(4).slice(lo, hi - lo), scale)
                if not asks[lo]:
                    ids.append(vec[lo:hi])
                    parts.append(m)
                    continue
                if block is None:
                    block, ids, parts = Block(ids, parts), [], []
                if len(block.ids):
                    hashes = b.column(3).slice(lo, hi - lo).to_pylist()
                    for i, found, scores in block.best(vec[lo:hi], m, k):
                        out += ((int(vec[lo + i]), hashes[i], x, max(min(int(y), 2**63 - 1), -(2**63))) for x, y in zip(found.tolist(), scores.tolist(), strict=True))
            cols = list(zip(*out, strict=True)) or [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    found = rows.mapInArrow(run, "query_id long, query long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

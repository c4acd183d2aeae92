"""Word-shingle sets of whole texts as sorted 64-bit hashes, computed on the bytes of many texts at once.

A word is a run of bytes other than white space (\\x20, \\x09-\\x0D), A-Z in lower case. Every byte gets a mixed 64-bit
value of itself and its place in the word; a word's hash is their sum, taken from one running sum a chunk, mixed with the
word's length. A shingle chains its words' hashes through a mixing step each. No arithmetic relation between words of
regular shape carries over to such sums, as it does to polynomials, so unequal shingles agree like random 64-bit numbers.
The hash has no secret: texts made to collide on purpose are outside of that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Each byte's value (upper case as lower case), and whether it belongs to a word."""
    b = np.arange(256)
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    return mix64((low.astype(np.uint64) + np.uint64(1)) * _STEP), ~((b == 32) | ((b >= 9) & (b <= 13)))


def _chunk(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    n = len(offsets) - 1
    value, inside = _bytes()
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]]))) if len(data) else np.empty(0, np.int64)
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1 if len(data) else starts
    lengths = ends - starts
    letters = data[word]  # words' bytes behind each other
    upto = np.concatenate([[0], np.cumsum(lengths)])
    place = (np.arange(len(letters)) - np.repeat(upto[:-1], lengths)).astype(np.uint64)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(value[letters] + place * _M2))])
    h = mix64(run[upto[1:]] - run[upto[:-1]] + lengths.astype(np.uint64) * _STEP)
    first = np.searchsorted(starts, offsets)  # of each text's words
    m = max(0, len(h) - k + 1)
    whole = np.full(m, k, np.uint64)
    for i in range(k):
        whole = mix64(whole * _STEP + h[i : i + m])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for x in range(a, b):
                one = mix64(one * _STEP + h[x])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; with fewer words the whole sequence is one shingle; null and empty texts have none."""
    t = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(t.buffers()[1], np.int64, len(t) + 1, t.offset * 8) if len(t) else np.zeros(1, np.int64)
    data = np.frombuffer(t.buffers()[2], np.uint8) if len(t) and t.buffers()[2] is not None and t.buffers()[2].size else np.empty(0, np.uint8)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(t):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
            hi = min(hi, len(t))
            yield from _chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
            lo = hi

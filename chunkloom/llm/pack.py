"""Packing documents into fixed-length token sequences by order-preserving dynamic programming.

The documents of a partition, in order, are one stream of tokens. A window may end at a document's end (free), at any
sentence's end (at a penalty), and, where a sentence is longer than STRIDE tokens, inside it at every STRIDE-th token: that
truncates the sentence, at a higher penalty. The program chooses the windows of at most `window` tokens with the least
padding plus penalties. Padding is linear in the window's length, so f(j) = window - P(j) + penalty(j) + min over
reachable i of (f(i) + P(i)); the minimum over a sliding range comes from a monotone queue, and the whole is linear in the
number of cuts. Windows whose length is a power of two need no padding.

Every partition is packed on its own as its rows stream through, in blocks of BLOCK tokens, so nothing is shuffled and
memory is bounded by a block and one document; the last window's tokens are carried on to the next block. A partition's
last window is truncated into powers of two if that costs less than its padding.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from chunkloom.llm.worker import held

WINDOW, BLOCK, STRIDE = 4096, 1 << 20, 256
END_ID = 2
SENTENCE_PENALTY, INNER_PENALTY = 4, 64
SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def sentence_ends(path: str) -> np.ndarray:
    """Whether an id's text ends a sentence."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    for piece, i in vocab.items():
        out[i] = piece.removesuffix("</w>")[-1:] in {".", "!", "?"}
    return out


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    plain, out, more = [*range(33, 127), *range(161, 173), *range(174, 256)], [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


class Encoder(dict):
    """ids of whole texts, equal to the tokenizer's own; the dict keeps those of white-space-delimited words as bytes.

    White space separates what the tokenizer looks at, so words are independent. Characters below U+0250 need no normalisation
    but lower case: texts of them are cut here into what the tokenizer merges as one (letters, a digit, signs), so the dict
    has no word twice, and only the merges are the tokenizer's. Other texts are cut into words, of which those with other
    characters go to the tokenizer, as do whole texts with control characters that Python alone takes for white space.
    Two generations of at most CACHE entries each, and none of over LONG characters, bound the memory and keep frequent ones.
    """

    CACHE, LONG = 350_000, 64
    ODD = re.compile("[\x1c-\x1f]")
    PLAIN = re.compile("[\x21-\u012f\u0131-\u024f]+")
    PLAIN_TEXT = re.compile("[\t-\r \x21-\u012f\u0131-\u024f]*")
    #: Below U+0250 the numbers that aren't decimal digits are these six.
    cut = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+").findall

    def __init__(self, path: str):
        super().__init__()
        self.t = tokenizer(path)
        self.merge, self.older = self.t.model.tokenize, {}
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.letters = byte_alphabet()

    def whole(self, x: str) -> bytes:
        """Of what the tokenizer merges as one; of the printable ASCII characters each stands for itself."""
        text = x if x.isascii() and x.isprintable() else "".join([self.letters[b] for b in x.encode()])
        return array("I", [t.id for t in self.merge(text)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if (got := self.older.get(word)) is None:
            if "<|" in word or not self.PLAIN.fullmatch(word):
                got = array("I", self.t.encode(word, add_special_tokens=False).ids).tobytes()
            elif (low := word.lower()).isalpha():
                got = self.whole(low) if low == word else self[low]
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                got = self[low[:-1]] + self[low[-1]]
            else:
                parts = self.split(low)
                got = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else self.whole(low)
        if len(word) <= self.LONG:
            if len(self) >= self.CACHE:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        if self.ODD.search(text):
            return np.array(self.t.encode(text, add_special_tokens=False).ids, np.uint32)
        parts = self.cut(text.lower()) if "<|" not in text and self.PLAIN_TEXT.fullmatch(text) else text.split()
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), np.uint32)


def encoder(path: str) -> Encoder:
    """One a worker process, so that its words serve the next tasks too."""
    return held(("encoder", path), lambda: Encoder(path))


def cut_points(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (1..len) where a document, end id included, may be cut, and their penalties."""
    at = np.flatnonzero(ends[ids]) + 1
    at = at[at < len(ids)]
    whole = np.concatenate([[0], at, [len(ids)]])
    gaps = np.diff(whole)
    inner = [np.arange(whole[i] + STRIDE, whole[i + 1], STRIDE) for i in np.flatnonzero(gaps > STRIDE)]
    points = np.concatenate([at, *inner, [len(ids)]]).astype(np.int64)
    cost = np.full(len(points), INNER_PENALTY, np.int64)
    cost[: len(at)], cost[-1] = SENTENCE_PENALTY, 0
    order = np.argsort(points, kind="stable")
    return points[order], cost[order]


def best_windows(points: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the windows that cover 0..points[-1] at least padding plus penalty. No gap between points exceeds the window."""
    at = np.concatenate([[0], points])
    short: dict[int, list[int]] = {}  # cuts from which a window of a power of two ends here
    for b in range(6, window.bit_length()):
        if 1 << b < window:
            k = np.searchsorted(at, at - (1 << b))
            for j in np.flatnonzero(at[k] == at - (1 << b)).tolist():
                short.setdefault(j, []).append(int(k[j]))
    p, pen = at.tolist(), [0, *cost.tolist()]
    n = len(p)
    best, back, key = [0] * n, [0] * n, [0] * n  # key: f + P
    queue: deque[int] = deque([0])  # of cuts in reach, by key from the least
    for j in range(1, n):
        x = p[j]
        while x - p[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        least = key[i] + window - x
        if j in short:
            for k in short[j]:
                if best[k] + SENTENCE_PENALTY < least:  # a short sequence costs something, too
                    least, i = best[k] + SENTENCE_PENALTY, k
        best[j] = least = least + pen[j]
        back[j], key[j] = i, least + x
        least += x
        while queue and key[queue[-1]] >= least:
            queue.pop()
        queue.append(j)
    ends, j = [], n - 1
    while j:
        ends.append(p[j])
        j = back[j]
    return ends[::-1]


def tail_windows(length: int, window: int = WINDOW) -> list[int]:
    """A partition's last window: powers of two, largest first and so without padding, if their cuts cost less than its padding."""
    if (length.bit_count() - 1) * INNER_PENALTY >= window - length:
        return [length]
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    def __init__(self, ends: np.ndarray, first_sequence: int, window: int = WINDOW, block: int = BLOCK):
        self.ends, self.window, self.block = ends, window, block
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, ids that aren't out yet, ids before them
        self.waiting, self.sequence = 0, first_sequence

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.waiting += len(ids)
        if self.waiting >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pieces of all windows but the last, which goes on to the next block unless this is the last one."""
        if not self.waiting:
            return
        points, cost, base = [], [], 0
        for _, ids, _ in self.docs:
            a, b = cut_points(ids, self.ends)
            points.append(a + base)
            cost.append(b)
            base += len(ids)
        ends = best_windows(np.concatenate(points), np.concatenate(cost), self.window)
        start = ends[-2] if len(ends) > 1 else 0
        tail = ends[-1] - start
        if not last:
            ends.pop()
        else:
            ends[-1:] = (start + np.cumsum(tail_windows(tail, self.window))).tolist()
        d, done, at, kept = 0, 0, 0, self.docs
        for end in ends:
            offset = 0
            while at < end:
                doc_id, ids, before = kept[d]
                n = min(len(ids) - done, end - at)
                yield doc_id, before + done, n, zlib.crc32(ids[done : done + n].astype("<u4").tobytes()), before + len(ids), self.sequence, offset
                done, at, offset = done + n, at + n, offset + n
                if done == len(ids):
                    d, done = d + 1, 0
            self.sequence += 1
        self.docs = [(i, x[done:] if k == 0 else x, b + done if k == 0 else b) for k, (i, x, b) in enumerate(kept[d:])]
        self.waiting -= at


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; null ids stay null. Long documents are cut and go on in the next sequence.
    Repeated rows are packed each on its own; other columns are not read. sequence_id holds the partition in its upper bits, so a partition that is read again after a
    loss gives the same rows. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_path).encode, TaskContext.get().partitionId()
        packer = Packer(sentence_ends(tokenizer_path), part << 40, window)
        end = np.array([END_ID], np.uint32)
        out: list[tuple] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for lo in range(0, len(ids), 256):
                    for i, t in zip(ids[lo : lo + 256], texts.slice(lo, 256).to_pylist(), strict=True):
                        yield from packer.add(i, np.concatenate([encode(t or ""), end]))
            yield from packer.flush(True)

        for row in rows():
            out.append(row)
            if len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

"""Token counts of a unigram tokenizer without building the tokens: count-only Viterbi.

An Aho-Corasick automaton lists every vocabulary piece in the text; the dynamic program carries the best score and the
number of pieces to each position. The rules are the public unigram tokenizers' own: white space becomes U+2581, one is
put before the text, a piece's score is the vocabulary's, a character without a piece of its own costs the least score
less 10 and counts as its UTF-8 bytes (byte fallback), and of equal scores the segmentation whose last piece starts
first wins. Scores are summed exactly (64-bit floats over integral scores).

No piece holds U+2581 behind another character, so a text is the concatenation of independent units (white space and
what follows it); units repeat, and their results are kept, at most CACHE of them a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.llm.worker import held

SPACE, UNKNOWN_PENALTY = "▁", 10.0


class Vocabulary:
    CACHE = 400_000

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True):
        """pieces: the ordinary pieces and their scores."""
        self.single = {p: s for p, s in pieces.items() if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        whole = any(SPACE in p.lstrip(SPACE) for p in pieces)  # then only the whole text is a unit
        self.units = (lambda t: [t]) if whole else re.compile(f"{SPACE}+[^{SPACE}]*").findall
        self.known: dict[str, tuple[float, int]] = {}

    def viterbi(self, unit: str) -> tuple[float, int]:
        """(best score, number of tokens) of one unit."""
        n = len(unit)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(unit):
            matches[end + 1].append(piece)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            found = sorted(matches[e], reverse=True)  # the longest, which starts first, is first
            if unit[e - 1] not in self.single:
                found.append((1, self.unknown))
            top = None
            for size, score in found:
                x = best[e - size] + score
                if top is None or x > top:
                    top, used = x, size
            best[e] = top
            alone = used == 1 and unit[e - 1] not in self.single
            count[e] = count[e - used] + (len(unit[e - 1].encode("utf-8", "surrogatepass")) if alone and self.byte_fallback else 1)
        return best[n], count[n]

    def count(self, text: str | None) -> tuple[float, int]:
        """(best score, number of tokens) of a whole text."""
        score, tokens, known = 0.0, 0, self.known
        if not text:
            return score, tokens
        for unit in self.units(SPACE + text.replace(" ", SPACE)):
            if (got := known.get(unit)) is None:
                got = self.viterbi(unit)
                if len(unit) < 64:
                    if len(known) >= self.CACHE:
                        known.clear()
                    known[unit] = got
            score += got[0]
            tokens += got[1]
        return score, tokens


def vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a SentencePiece model file (a parameter, never copied)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    return Vocabulary({p.piece: p.score for p in m.pieces if p.type == 1}, m.trainer_spec.byte_fallback)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])


def token_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, score of every row. Null and empty texts have no tokens and score 0; repeated rows stay; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held(("vocabulary", model_path), lambda: vocabulary(model_path))
        for batch in batches:
            got = [v.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.float64())], schema=_OUT)

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_tokens long, score double")

"""Toxicity by class-conditional Kneser-Ney models.

Word-pair counts of toxic and of ordinary labelled documents give two interpolated Kneser-Ney models over the words of all
documents. Both back off from word pairs to words (by the number of different two words before them), and from these to
counts that the classes share: those of all documents of the corpus. Nothing is pruned, so either model's probabilities
add up to 1. Compared are length-normalised log-likelihoods: their difference over the whole text, and over its WORST
different words, as a text can be toxic in few of them. These and the log of the length give a score by a logistic curve.
The curve is fitted on a quarter of the sample as the models of the other three quarters see it (the models that score all
documents, so both see new text alike), and allows for wrong labels, whose rates expectation-maximisation estimates.

The worst words count by P(w) alone, once each and up to BOUND, so neither a repeated word nor a passage that the sample
has in copies makes a text toxic. DISCOUNT, WORST and BOUND were chosen by fitting on one part of the labelled
documents outside the held-out third and judging on another; figures of held-out rows were seen on the way. A discount of 3 leaves what was seen three times or less in a class to the shared counts.

Bounds: the labelled sample is at most PER_CLASS documents a class (those with the least hash of doc_id); all its words
and pairs go to every task, as arrays. The sample's words are counted in every document, exactly; other words need no
shared count, as it cancels out of their ratio.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.worker import clear, held, trim
from chunkloom.storage import staged

PER_CLASS = 4096
DISCOUNT, WORST, BOUND = 3.0, 3, 3.5
THRESHOLD = 0.7
CHUNK_BYTES = 1 << 19
FLUSH_WORDS, SENT_ROWS = 1 << 18, 1 << 15
EVIDENCE = ("whole", "worst", "length")
words_of = re.compile(r"[^\W\d_]+").findall


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text mod 3; rows with 1 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def pair_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The key of a pair by its words' hashes, as `_model` makes it."""
    return x ^ (y << 1)


class Model:
    """Both classes' models as log ratios, toxic to ordinary.

    words; h, ratio, behind: their hashes, the ratio of P(w), and what a word adds to the next one's ratio if the pair is
    unknown; keys and values: known pairs and the ratio of P(w | before). unknown: the ratio of words of neither class, which
    comes from the classes' sizes alone and is taken off all others, so such a word speaks for neither.
    """

    def __init__(self, words: pa.Table, pairs: pa.Table, unknown: float):
        self.name = uuid.uuid4().hex
        column = lambda c, last: np.append(words.column(c).to_numpy(), last)
        self.words = words.column("word").combine_chunks()
        self.unknown = unknown
        self.h, self.ratio, self.behind = column("h", 0), column("ratio", unknown) - unknown, column("behind", 0.0)
        keys = pairs.column("key").to_numpy()
        order = np.argsort(keys)
        self.keys, self.values = keys[order], pairs.column("value").to_numpy()[order] - unknown


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.place = {w.as_py(): i for i, w in enumerate(model.words)}.get

    def ratios(self, words: list[str], starts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place in the model (-1: none), and the log ratio of its probability behind the word before it. The words of
        several texts stand behind each other; those at `starts` have none before them."""
        m = self.model
        rows = np.fromiter(map(self.place, words, repeat(-1)), np.int64, len(words))
        out = m.ratio[rows]
        follows = np.ones(len(rows), bool)
        follows[starts or [0][: len(rows)]] = False
        at = np.flatnonzero(follows)
        out[at] += m.behind[rows[at - 1]]
        at = at[(rows[at] >= 0) & (rows[at - 1] >= 0)]
        if len(at) and len(m.keys):
            keys = pair_key(m.h[rows[at - 1]], m.h[rows[at]])
            order = np.argsort(keys)  # looked up in order, neighbours lie together
            keys, at = keys[order], at[order]
            place = np.searchsorted(m.keys, keys)
            place[place == len(m.keys)] = 0
            hit = m.keys[place] == keys
            out[at[hit]] = m.values[place[hit]]
        return rows, out

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Of every text: the difference of the length-normalised log-likelihoods of the whole text, and of its WORST different words
        by themselves; and the log of the length, as the worst of many words are worse. Zeros without words."""
        found = [words_of((t or "").lower()) for t in texts]
        ends = np.cumsum([len(x) for x in found])
        filled = [i for i, x in enumerate(found) if x]
        rows, ratio = self.ratios([w for x in found for w in x], [int(ends[i]) - len(found[i]) for i in filled])
        out = np.zeros((len(texts), len(EVIDENCE)))
        for i in filled:
            lo, hi = ends[i] - len(found[i]), ends[i]
            alone = self.model.ratio[np.unique(rows[lo:hi])]
            worst = np.partition(alone, max(0, len(alone) - WORST))[-WORST:]
            out[i] = ratio[lo:hi].mean(), np.minimum(worst, BOUND).sum() / WORST, math.log1p(hi - lo)
        return out


def scorer(model: Model) -> Scorer:
    return held(("scorer", model.name), lambda: Scorer(model))


def trainable(labels: DataFrame) -> DataFrame:
    """doc_id, toxic, fits (whether for the curve) outside the held-out third. Rows without a label of 0 or 1 take no part; of several labels for an id the largest holds."""
    rows = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id")) != 1).withColumn("fits", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0)


def labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of `trainable` that are in the training sample."""
    rows = trainable(labels)
    best = lambda y: rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return best(0).unionByName(best(1))


def shared_counts(docs: DataFrame, words: pa.Array) -> DataFrame:
    """word, n: how often each of `words` is in all documents; the row with a null word has the number of all their tokens. A task sends what isn't zero."""
    name, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = held(("shared", name), lambda: {w.as_py(): i for i, w in enumerate(sent.value)}).get
        n = len(sent.value)
        counts = np.zeros(n + 1, np.int64)  # the last: words that aren't among them
        for b in batches:
            for t in b.column(0):
                found = words_of((t.as_py() or "").lower())
                at = np.fromiter(map(place, found, repeat(n)), np.int64, len(found))
                if len(found) > n // 16:
                    counts += np.bincount(at, minlength=n + 1)
                else:
                    np.add.at(counts, at, 1)
        counts[n] = counts.sum()
        at = np.flatnonzero(counts)
        every = pa.concat_arrays([sent.value.cast(pa.string()), pa.nulls(1, pa.string())])
        yield pa.RecordBatch.from_arrays([every.take(pa.array(at)), pa.array(counts[at])], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _triples(sample: DataFrame) -> DataFrame:
    """earlier, before, word, and whether toxic (a) and ordinary (b) documents have these three in a row. "" stands before a text.

    A task holds the words of FLUSH_WORDS, or of one text, as numbers; what a flush repeats of another is one row after the sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear()  # of what the stages before kept
        place: dict[str, int] = {"": 0}
        texts: list[tuple[int, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            words = pa.array(list(place), pa.string())
            earlier = np.concatenate([c[:-2] for _, c in texts])
            before = np.concatenate([c[1:-1] for _, c in texts])
            word = np.concatenate([c[2:] for _, c in texts])
            toxic = np.repeat([y for y, _ in texts], [len(c) - 2 for _, c in texts])
            last, first = word << 1 | toxic, earlier << 32 | before
            order = np.lexsort((last, first))
            last, first = last[order], first[order]
            new = np.ones(len(order), bool)
            new[1:] = (last[1:] != last[:-1]) | (first[1:] != first[:-1])
            order = order[new]
            for lo in range(0, len(order), SENT_ROWS):
                at = order[lo : lo + SENT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(toxic[at], pa.int64()), *(words.take(pa.array(c[at])) for c in (earlier, before, word))], names=["toxic", "earlier", "before", "word"])
            texts.clear()
            place.clear()
            place[""] = 0

        waiting = 0
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = words_of((t.as_py() or "").lower())
                texts.append((y, np.array([0, 0, *(place.setdefault(w, len(place)) for w in words)], np.int64)))
                waiting += len(words)
                if waiting >= FLUSH_WORDS:
                    yield from flush()
                    waiting = 0
        if texts:
            yield from flush()

    got = sample.select("text", F.col("toxic").cast("long")).mapInArrow(run, "toxic long, earlier string, before string, word string")
    return got.groupBy("earlier", "before", "word").agg(F.max(F.col("toxic")).alias("a"), F.max(1 - F.col("toxic")).alias("b"))


def _model(triples: DataFrame, shared: DataFrame) -> Model:
    """The models of these triples. a, b: the toxic and the ordinary class. c(v w): the different words before the pair, so that
    copies and repeated lines count once.

    P(w) = (max(N(w) - D, 0) + M share(w)) / S over N(w), the different two words before w, their sum S and the discounted
    mass M, the sum of min(N, D); P(w | v) = (max(c(v w) - D, 0) + m(v) P(w)) / c(v) over the pairs' counts behind v and their
    discounted mass m(v).
    """
    p = staged(triples.groupBy("before", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "toxic-model")
    taken = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(float(DISCOUNT))))
    left = lambda c: F.greatest(F.col(c) - float(DISCOUNT), F.lit(0.0))
    tokens = shared.where("word is null").agg(F.max("n")).first()[0] or 1
    words = p.groupBy("word").agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).join(shared.withColumnRenamed("n", "shared"), "word")
    words = staged(words.select("word", F.xxhash64("word").alias("h"), "na", "nb", (F.col("shared") / float(tokens)).alias("share")), "toxic-words")
    total = words.agg(*(F.sum(f"n{c}").alias(f"s{c}") for c in "ab"), *(taken(f"n{c}").alias(f"m{c}") for c in "ab")).first()
    s = {c: float(total[f"s{c}"] or 1) for c in "ab"}
    m = {c: float(total[f"m{c}"] or 1) for c in "ab"}  # a class without words backs off whole
    inner = p.where("before <> ''")
    behind = inner.groupBy(F.col("before").alias("word")).agg(*(F.sum(c).alias(f"c{c}") for c in "ab"), *(taken(c).alias(f"m{c}") for c in "ab"))
    alone = lambda c: (left(f"n{c}") + m[c] * F.col("share")) / s[c]
    rest = lambda c: F.when(F.col(f"c{c}") > 0, F.col(f"m{c}") / F.col(f"c{c}")).otherwise(1.0)
    words = words.select("word", "h", *(alone(c).alias(f"p{c}") for c in "ab")).join(behind, "word", "left")
    words = staged(words.select("word", "h", "pa", "pb", *(rest(c).alias(f"r{c}") for c in "ab"), *(F.greatest(F.coalesce(f"c{c}", F.lit(0)), F.lit(1)).alias(f"c{c}") for c in "ab")), "toxic-words")
    before = words.select(F.col("word").alias("before"), F.col("h").alias("x"), "ra", "rb", "ca", "cb")
    known = inner.join(before, "before").join(words.select("word", F.col("h").alias("y"), "pa", "pb"), "word")
    of = lambda c: left(c) / F.col(f"c{c}") + F.col(f"r{c}") * F.col(f"p{c}")
    known = known.select(F.col("x").bitwiseXOR(F.shiftleft("y", 1)).alias("key"), F.log(of("a") / of("b")).alias("value"))
    words = words.select("word", "h", F.log(F.col("pa") / F.col("pb")).alias("ratio"), F.log(F.col("ra") / F.col("rb")).alias("behind"))
    return Model(words.toArrow(), known.toArrow(), math.log((m["a"] / s["a"]) / (m["b"] / s["b"])))


def stands_for(labels: DataFrame, per_class: int = PER_CLASS) -> dict[int, float]:
    """Of how many labelled rows a row of the sample is one, by class."""
    return {r["toxic"]: max(1.0, r["count"] / per_class) for r in trainable(labels).groupBy("toxic").count().collect()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method. y: probabilities; weight: of each row."""
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def curve(x: np.ndarray, y: np.ndarray, stands: dict[int, float] | None = None, rounds: int = 40) -> np.ndarray:
    """Weights of the score: the probability that a document is toxic, not that it is labelled so.

    Some labels are wrong, which would flatten the curve. Rates of either error and the curve are estimated in turn: a
    row's probability to be toxic given its label and evidence, then the curve over these probabilities.
    stands: how many labelled rows a row of either class is one of. Rows weigh as much (1 on average), so the share of
    toxic rows is that of all labelled ones, whatever part of a class was sampled.
    """
    weight = np.array([(stands or {}).get(int(c), 1.0) for c in y])
    weight = weight / weight.mean()
    w = logistic(x, y, weight=weight)
    wrong = {1: 0.02, 0: 0.02}  # of toxic rows labelled ordinary, of ordinary rows labelled toxic
    for _ in range(rounds):
        p = _sigmoid(np.column_stack([x, np.ones(len(x))]) @ w)
        says = np.where(y == 1, 1 - wrong[1], wrong[1]), np.where(y == 1, wrong[0], 1 - wrong[0])
        q = p * says[0] / (p * says[0] + (1 - p) * says[1])
        bounded = lambda miss, of: float(np.clip((weight * miss).sum() / max(1e-9, (weight * of).sum()), 1e-4, 0.3))
        wrong = {1: bounded(q * (y == 0), q), 0: bounded((1 - q) * (y == 1), 1 - q)}
        new = logistic(x, q, 0.1, weight=weight)
        done, w = np.abs(new - w).max() < 1e-6, new
        if done:
            break
    return w


def evidence(docs: DataFrame, sent, *keep: str) -> DataFrame:
    """The columns `keep` (none named as in EVIDENCE), then EVIDENCE, of every row. sent: a broadcast Model."""
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    place = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(sent.value)
        for whole in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(whole.column(place)), 0).to_numpy())
            lo = 0
            while lo < whole.num_rows:  # CHUNK_BYTES of text at once, or one text
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
                b = whole.slice(lo, hi - lo)
                got = s.evidence(b.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(got[:, i]) for i in range(len(EVIDENCE)))], names=[*keep, *EVIDENCE])
                lo = hi

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{k} double" for k in EVIDENCE]))


def probability(w: np.ndarray) -> Column:
    """The score of a row with EVIDENCE."""
    x = F.lit(float(w[-1]))
    for k, v in zip(EVIDENCE, w, strict=False):
        x = x + F.col(k) * float(v)
    return 1 / (1 + F.exp(-x))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Model, np.ndarray]:
    """The models of three quarters of the training sample, and the curve's weights, fitted on the last quarter as the models see it."""
    sample = labelled(docs, labels, per_class)  # at most 2 * per_class short rows, so it may be broadcast
    text = staged(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", "fits"), "toxic-sample")
    triples = staged(_triples(text.where("not fits")), "toxic-triples")
    shared = staged(shared_counts(docs, triples.select("word").distinct().toArrow().column("word").combine_chunks()), "toxic-shared")
    trim()
    model = _model(triples, shared)
    trim()  # of the tables that it was made from
    seen = evidence(text.where("fits"), docs.sparkSession.sparkContext.broadcast(model), "toxic").toArrow()  # bounded by the sample
    x = np.column_stack([seen.column(k).to_numpy() for k in EVIDENCE])
    return model, curve(x, seen.column("toxic").to_numpy().astype(float), stands_for(labels, per_class)) if seen.num_rows else np.zeros(len(EVIDENCE) + 1)


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row.

    Texts that are null, empty or without words have evidence 0; without labels every score is 0.5. Only the text is an
    input of a score. Repeated rows get equal scores.
    """
    model, w = train(docs, labels, per_class)
    got = evidence(docs, docs.sparkSession.sparkContext.broadcast(model), "doc_id")
    out = got.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), probability(w).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

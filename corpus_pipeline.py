"""A training corpus from raw documents: toxic ones go, one of each group of near copies stays, personal data is masked, sources are mixed to target weights, and the result is packed into sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import jaccard, mix, pack, pii, toxic
from chunkloom.llm.queries import tokenizer_file
from chunkloom.storage import made, release, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The pipeline's near copies: five words, a similarity of 0.8.
SHINGLE_WORDS, SIMILARITY = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score accepts. The text is scored in place, so ids may repeat or be null."""
    model, w = toxic.train(docs, table(spark, sf_dir, "labels"))
    return toxic.evidence(docs, spark.sparkContext.broadcast(model), *COLUMNS).where(toxic.probability(w) < toxic.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents.

    Rows are documents of their own, so of two texts under one id one can go and the other stay. What is left under one
    id is one document, of which the first by its columns stays. Rows with a null id stay unless a row with an id has
    the same shingles.
    """
    docs = docs.select(*COLUMNS)
    groups = jaccard.join(docs, SHINGLE_WORDS, SIMILARITY, all_links=False)
    gone = groups.where("component_id is not null and not doc_id <=> component_id").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rest = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left_anti")
    again = staged(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return rest
    first = rest.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return rest.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(first)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in angle brackets; n_chars follows. All documents stay."""
    out = pii.redacted(docs, *COLUMNS)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of the documents that the mix takes, sorted by training position."""
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    one = docs.where("doc_id is not null").unionByName(docs.where("doc_id is null").dropDuplicates(["text_hash"]))  # then a place has one row
    places = mix.copies(docs).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    out = one.join(places, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    return out.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens, which follow the training position.

    docs: the mixed table as read from its files. A scan takes files by size, so the order is restored from what the
    sorted table was written as: the files' numbers, and the rows' places in them.
    """
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    rows = docs.select("doc_id", "text", number.alias("file_no"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    order = ("file_no", "file", "row")
    return pack.pack(rows.repartitionByRange(*order).sortWithinPartitions(*order), tokenizer_file("word_bpe_49k.json"))


_left: list[str] = []


def _releasing(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage; when it begins, the tables that the stage before staged go, as its result has been written."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        before = set(made())
        out = stage(spark, docs, sf_dir)
        _left[:] = [p for p in made() if p not in before]
        return out

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _releasing(drop_toxic)),
    ("n-gram jaccard join", _releasing(drop_near_copies)),
    ("personal data", _releasing(mask_personal_data)),
    ("mixing sources", _releasing(mix_sources)),
    ("packing", _releasing(pack_sequences)),
]

#: SQL can't express the first stage (a trained model); tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each one keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, "pipeline-" + name.replace(" ", "-"))
    return docs

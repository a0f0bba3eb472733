"""A training corpus from the documents: quality, near copies, repeated passages, packing.

Each stage is one operator of trailmill.llm with its decisions carried out on the
documents that its predecessor kept. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm import jaccard, packing, passages, quality
from trailmill.llm.common import release, shared, table
from trailmill.llm.queries import BYTE_BPE, tokenizer_path

LEAST_SCORE = 0.3
NEAR = jaccard.Likeness(words=5, part=80, whole=100)
PASSAGE_WORDS = 13
SEQUENCE_TOKENS = 1024


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labels, does not reject; each row by its own text, empty and null ones too."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, column="__score").where(F.col("__score") >= LEAST_SCORE).select(docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id (of one id, of smallest text hash).

    Rows are told apart by id and text, so one of two texts of an id can go and
    the other stay. Rows that repeat an id and its text stay once; rows without an
    id, and texts without words, all stay.
    """
    found = shared(jaccard.near_copies(docs.select("doc_id", "text"), NEAR, details=True).where("doc_id IS NOT NULL AND component IS NOT NULL").select("doc_id", "text_hash", "component"))
    winners = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("w")).select("w.*")
    dropped = shared(found.join(winners, ["doc_id", "text_hash"], "left_anti").select("doc_id", "text_hash").distinct())
    repeated = shared(found.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"))
    small = lambda keys: F.broadcast(keys) if keys.count() <= jaccard.BROADCAST_ROWS else keys
    key = ["doc_id", "__text_hash"]
    keys = lambda df: small(df).withColumnRenamed("text_hash", "__text_hash")
    kept = docs.withColumn("__text_hash", F.xxhash64("text")).join(keys(dropped), key, "left_anti")
    if repeated.limit(1).count():
        kept = kept.join(keys(repeated), key, "left_anti").unionAll(kept.join(keys(repeated), key, "left_semi").dropDuplicates(["doc_id", "text"]))
    release(found)
    return kept.select(docs.columns)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that stand in an earlier one; texts that lose nothing stay as they are. Rows of one id lose nothing to each other."""
    found = passages.remove_repeated_passages(docs, PASSAGE_WORDS)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": size}).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces of the documents in sequences; a null or empty text is one piece of the end id, repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_path(BYTE_BPE), SEQUENCE_TOKENS)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_copy_stage),
    ("substring dedup", passage_stage),
    ("best-fit packing", packing_stage),
]

#: A fitted ensemble and a least-squares plan are not SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result kept in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else shared(docs), sf_dir)
    return docs

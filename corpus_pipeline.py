"""A corpus from raw documents to packed sequences: five stages, each over all rows that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard_join, line_crf, mixing, packing, suffix_dedup
from quillon.llm._shared import WORD_CLASS, learnable, materialise
from quillon.llm.queries import vocabulary

#: Documents that score below this are rejected by the classifier.
GOOD = 0.7
CAPACITY = 4096


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches GOOD; the classifier learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = line_crf.learn(docs, labels.where(learnable(F.col("doc_id"))))
    return docs.where(line_crf.score(F.col("text"), model) >= GOOD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return jaccard_join.keep_first(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 that also start elsewhere; n_chars follows a text that was cut.

    A document that was cut goes if no word is left of it.
    """
    found = suffix_dedup.remove_repeats(docs)
    cut = F.size("spans") > 0
    left = suffix_dedup.as_text(F.col("kept"), F.col("text"))
    found = found.where(~cut | left.rlike(WORD_CLASS))
    changed = {"text": F.when(cut, left).otherwise(F.col("text")), "n_chars": F.when(cut, F.length(left).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of sources draws: whole documents, or runs of their words; n_chars follows a text that was cut."""
    return mixing.mixed_documents(docs, n_chars="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most CAPACITY tokens with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = packing.token_pieces(docs, vocabulary(), CAPACITY).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, CAPACITY, ["doc_id", "piece", "ids_crc32"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the classifier, the mix and the packing; tests/llm holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs

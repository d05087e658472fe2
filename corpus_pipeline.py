"""The corpus pipeline: five stages over ``documents``, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import classifier, decontaminate, neardup, secrets, sentencepieces
from loomstone.session import Scratch, load


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on labelled documents of ``docs``."""
    model = classifier.train(docs, load(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, model)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.remove_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mask."""
    return secrets.redact(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, their number and digest, and whether decoding gives the text back."""
    return sentencepieces.encode(docs)


STAGES = [
    ("quality classifier", classifier_stage),
    ("MinHash near-dedup", neardup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scans", secrets_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: The learned classifier, the signatures and the tokenizer are beyond SQL; a
#: brute-force version of the stages is what the tests compare with.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs

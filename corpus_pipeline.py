"""From raw documents to encoded training text: five stages, each one operator over all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontamination, line_dedup, near_copies, sentence_pieces, toxicity
from spanloom.llm.runtime import shared_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.3 or more; learns from a bounded sample of the labelled ones.

    Null and empty texts score the model's bias; repeated rows and keys are judged each by its text; a key's highest label counts; without
    labels all documents stay; an empty table stays empty. So few labels that L1 leaves no weight (two, say) give every
    text 0.5, so all documents go; texts without a learned feature have the bias, which needs labels that are mostly clean to fall under 0.3.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier line resembles by 0.8 or more; n_chars follows. Documents stay, if need be empty.

    A null or empty text is one empty line; null keys come last; rows of one key go by their texts, equal rows get equal results; lines
    without words stay. Texts are taken whole, whatever their length.
    """
    kept = line_dedup.without_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more: SimHash candidates from a grid join, an exact way for the rest, all verified.

    The smallest key stays, null keys come last, of equal keys one row. Texts without words are one group; texts of under five words
    are their word sequence.
    """
    return near_copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within a fifth of its words in edits.

    Null and empty texts hold none; items without words are in no document; each row is judged by its text, whatever its key.
    """
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids (little-endian 32-bit integers with begin and end) and n_tokens; the text is what the ids give back.

    A null text counts as empty and becomes empty; columns that have these names already are replaced; each row is coded by itself.
    """
    return sentence_pieces.with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentence_pieces", encoding_stage),
]

#: SQL expresses neither the classifier nor the encoding; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet to the shared folder and read again."""
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs

"""Chapters from a folder as they arrive: the batch functions on a stream, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.sources.readers import chapter_key


def paragraphs_stream(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, chapter_idx, par_idx, text, n_sentences of each text file <book>/<idx>.txt; a map, so no watermark is needed."""
    raw = spark.readStream.text(folder, wholetext=True).select("value", "_metadata.file_path")
    parts = raw.select(*chapter_key(F.col("file_path")), F.posexplode(tx.paragraph_texts(F.col("value"))).alias("par_idx", "text"))
    return parts.withColumn("n_sentences", F.size(tx.sentence_texts(F.col("text"))))

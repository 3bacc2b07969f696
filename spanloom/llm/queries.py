"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import byte_repeats, languages, merkle, middles, pitman_yor, toxicity
from spanloom.llm.decontamination import leaks
from spanloom.llm.hash_forest import nearest_neighbours
from spanloom.llm.line_dedup import line_removals
from spanloom.llm.runtime import documents
from spanloom.llm.sentence_pieces import encode_and_decode
from spanloom.llm.simhash import near_duplicates
from spanloom.llm.substrings import without_repeats
from spanloom.llm.token_counts import count_tokens


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 7
    found = pitman_yor.scores(documents(spark, sf_dir), trains=remainder != 2)
    return found.select("doc_id", (remainder == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = byte_repeats.without_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_removals(documents(spark, sf_dir))
    return found.withColumn("removed_lines", F.array_join(F.col("removed_lines").cast("array<string>"), ","))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the texts is tampered with; the path shows which ones differ by it."""
    tampers = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.when(tampers, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    found = merkle.manifest(documents(spark, sf_dir), changed={"text": lowered})
    proven = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("path"), F.col("changed_leaf")).alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = documents(spark, sf_dir)
    found = languages.predict(docs, languages.fit(docs, usable=~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middles.fill_in_middle(documents(spark, sf_dir))
    back = middles.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pitman_yor, op2_substring_dedup, op3_toxicity, op4_simhash_near_dedup, op5_hash_prefix_forest, op6_sentence_pieces, op7_token_counts, op8_benchmark_decontamination, op9_suffix_array_dedup, op10_line_dedup, op11_merkle_manifest, op12_language_id, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": merkle.manifest_sql(), "op13_fill_in_middle": middles.middles_sql()}

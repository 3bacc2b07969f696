"""Grouping of a chapter's paragraphs into chunks by sentence counts: folds over arrays, one row per chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "array<struct<first_par:bigint,last_par:bigint,first_seg:bigint,n:bigint>>"


def counted_paragraphs(paragraphs: DataFrame, segments: DataFrame) -> DataFrame:
    """Per chapter an array of (par_idx, first_seg, n) in order; paragraphs without a sentence are left out."""
    per = segments.groupBy("book_id", "chapter_idx", "par_idx").agg(F.min("seg_idx").alias("first_seg"), F.count("*").alias("n"))
    return per.groupBy("book_id", "chapter_idx").agg(F.array_sort(F.collect_list(F.struct("par_idx", "first_seg", "n"))).alias("pars"))


def chunk(first_par: Column, last_par: Column, first_seg: Column, n: Column) -> Column:
    return F.struct(first_par.cast("bigint").alias("first_par"), last_par.cast("bigint").alias("last_par"), first_seg.cast("bigint").alias("first_seg"), n.cast("bigint").alias("n"))


def grown(chunks: Column, p: Column) -> Column:
    """The last chunk takes in a paragraph."""
    last = F.element_at(chunks, -1)
    return F.concat(F.slice(chunks, 1, F.size(chunks) - 1), F.array(chunk(last["first_par"], p["par_idx"], last["first_seg"], last["n"] + p["n"])))


def max_chunks(pars: Column, most: int) -> Column:
    """Paragraphs over `most` sentences are cut; others join the chunk before them while it stays within `most`."""

    def step(acc: Column, p: Column) -> Column:
        fits = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["n"] + p["n"] <= most)
        cut = F.transform(F.sequence(F.lit(0).cast("bigint"), ((p["n"] - 1) / most).cast("bigint")), lambda i: chunk(p["par_idx"], p["par_idx"], p["first_seg"] + i * most, F.least(F.lit(most), p["n"] - i * most)))
        return F.when((p["n"] <= most) & fits, grown(acc, p)).otherwise(F.concat(acc, cut))

    return F.aggregate(pars, F.array().cast(KIND), step)


def min_chunks(pars: Column, least: int) -> Column:
    """Paragraphs join the chunk before them while it has under `least` sentences; a short last one joins too, and a short last chunk folds back."""
    last_par = F.element_at(pars, -1)["par_idx"]

    def step(acc: Column, p: Column) -> Column:
        small = F.get(acc, F.size(acc) - 1)["n"] < least
        joins = (F.size(acc) > 0) & (small | ((p["par_idx"] == last_par) & (p["n"] < least)))
        return F.when(joins, grown(acc, p)).otherwise(F.concat(acc, F.array(chunk(p["par_idx"], p["par_idx"], p["first_seg"], p["n"]))))

    def finish(acc: Column) -> Column:
        last, before = F.element_at(acc, -1), F.get(acc, F.size(acc) - 2)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 2), F.array(chunk(before["first_par"], last["last_par"], before["first_seg"], before["n"] + last["n"])))
        return F.when((F.size(acc) > 1) & (last["n"] < least), joined).otherwise(acc)

    return F.aggregate(pars, F.array().cast(KIND), step, finish)


def chunks(paragraphs: DataFrame, segments: DataFrame, max_sentences: int | None = None, merge_sentences: int | None = None) -> DataFrame:
    """book_id, chapter_idx, idx, first_par, last_par, n_sentences, start_char, end_char. max_sentences wins if both are given."""
    if max_sentences is None and merge_sentences is None:
        raise ValueError("max_sentences or merge_sentences is needed")
    per = counted_paragraphs(paragraphs, segments)
    made = max_chunks(F.col("pars"), max_sentences) if max_sentences is not None else min_chunks(F.col("pars"), merge_sentences)
    flat = per.select("book_id", "chapter_idx", F.posexplode(made).alias("idx", "c")).select("book_id", "chapter_idx", F.col("idx").cast("bigint").alias("idx"), "c.*")
    ends = segments.select(F.col("chapter_idx").alias("ch"), "seg_idx", "start_char", "end_char")
    inside = flat.join(ends, (F.col("chapter_idx") == F.col("ch")) & (F.col("seg_idx") >= F.col("first_seg")) & (F.col("seg_idx") < F.col("first_seg") + F.col("n")))
    return inside.groupBy("book_id", "chapter_idx", "idx", "first_par", "last_par", F.col("n").alias("n_sentences")).agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))

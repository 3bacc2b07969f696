"""Writers: packed chapters, review sheets, metadata, flat pairs, scores, chapter texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sheet_cell(nums: Column, segments: Column, separator: str = "\t") -> Column:
    """[n] text for each segment; with a line break as separator the cell reads back whole."""
    return F.array_join(F.transform(segments, lambda s, i: F.concat(F.lit("["), F.get(nums, i).cast("string"), F.lit("] "), s)), separator)


def packed_version(segments: DataFrame) -> DataFrame:
    """chapter_idx and v: text, spans of paragraphs and segments, paragraph numbers of the segments."""
    listed = segments.groupBy("chapter_idx").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "par_idx", "start_char", "end_char", "text"))).alias("s"))
    pars = F.transform(F.array_distinct(F.transform("s", lambda x: x["par_idx"])), lambda p: F.filter("s", lambda x: x["par_idx"] == p))
    spans = F.transform(pars, lambda g: F.array(F.get(g, 0)["start_char"], F.element_at(g, -1)["end_char"]))
    return listed.select("chapter_idx", F.struct(
        F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"), spans.alias("paragraph_chars"),
        F.transform("s", lambda x: F.array(x["start_char"], x["end_char"])).alias("segment_chars"), F.transform("s", lambda x: x["par_idx"] + 1).alias("paragraph_nums"),
    ).alias("v"))


def write_json(df: DataFrame, path: str, by: str | None = "book_id") -> None:
    (df.write.partitionBy(by) if by else df.write).mode("errorifexists").json(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """Cells as they are, blanks at their ends included."""
    whole = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**whole).csv(path)


def write_sheets(df: DataFrame, path: str) -> None:
    """Review sheets in a folder for each book and validator."""
    df.write.partitionBy("book_id", "validator").options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_score_json(df: DataFrame, path: str) -> None:
    """{book: {score: value, ...}} to a line for each book_id."""
    scores = F.struct(*[c for c in df.columns if c != "book_id"])
    df.select(F.to_json(F.map_from_arrays(F.array("book_id"), F.array(scores))).alias("value")).write.text(path)


def write_packed(df: DataFrame, path: str) -> None:
    """book_id, chapter_idx and a struct per version: one chapter to a line, in a folder per book."""
    df.write.partitionBy("book_id").json(path)


def write_items(df: DataFrame, path: str) -> None:
    """A JSON list to a line, as `readers.items` reads them with one_per_file=False."""
    df.select(F.to_json(F.array(F.struct(*df.columns))).alias("value")).write.text(path)


def write_texts(df: DataFrame, path: str) -> None:
    """One text per row, in a folder per book."""
    df.select("book_id", F.col("text").alias("value")).write.partitionBy("book_id").text(path)


def write_scores(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted through all files: their names follow the order."""
    df.orderBy(*order).write.option("header", True).csv(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.partitionBy("window_size").parquet(path)

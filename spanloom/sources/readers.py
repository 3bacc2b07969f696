"""Readers: packed chapters, metadata, segments and alignments in old and new layouts, sheets, predictions, raw texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = "struct<text:string,paragraph_chars:array<array<bigint>>,segment_chars:array<array<bigint>>,overlap_chars:array<array<bigint>>,row_chars:array<array<bigint>>>"
PACKED = f"original {VERSION}, abridged {VERSION}"
META = "map<string,struct<book_title:string,author:string,chapter_titles:array<string>,listed_titles:array<string>,chapter_idxs:array<bigint>,train_chapter_idxs:array<bigint>,dev_chapter_idxs:array<bigint>,test_chapter_idxs:array<bigint>>>"
PATH = "([^/]+)/([0-9]+)\\.[a-z]+$"


def chapter_key(path: Column) -> list[Column]:
    """book_id and chapter_idx from .../<book>/<idx>.<ending>"""
    return [F.regexp_extract(path, PATH, 1).alias("book_id"), F.regexp_extract(path, PATH, 2).cast("bigint").alias("chapter_idx")]


def spans(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(p[0].alias("start"), p[1].alias("end")))


def packed_chapters(spark: SparkSession, glob: str) -> DataFrame:
    """book_id, chapter_idx and per version text, paragraphs, segments, rows, overlaps (arrays of (start, end))."""
    raw = spark.read.schema(PACKED).option("multiLine", True).json(glob).select("*", "_metadata.file_path")
    return unpacked(raw, *chapter_key(F.col("file_path")))


def packed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from one chapter a line, which names its chapter; the folder names the book."""
    return unpacked(spark.read.schema(f"book_id string, chapter_idx bigint, {PACKED}").json(path), F.col("book_id"), F.col("chapter_idx"))


def unpacked(raw: DataFrame, *key: Column) -> DataFrame:
    def version(name: str) -> Column:
        kinds = (("paragraph_chars", "paragraphs"), ("segment_chars", "segments"), ("row_chars", "rows"), ("overlap_chars", "overlaps"))
        return F.struct(F.col(f"{name}.text").alias("text"), *[spans(F.col(f"{name}.{a}")).alias(b) for a, b in kinds]).alias(name)

    return raw.select(*key, version("original"), version("abridged"))


def metadata_rows(values: DataFrame, split: str | None = None) -> DataFrame:
    """Rows of (book_id, book_title, author, chapter_idx, chapter_title) from JSON texts in column value.

    A title is looked up at the place that the chapter's number names; listed_titles stand in chapter order instead.
    """
    book = values.select(F.explode(F.from_json("value", META)).alias("book_id", "m"))
    chosen = F.col("m.chapter_idxs") if split is None else F.col(f"m.{split}_chapter_idxs")
    one = book.select("book_id", "m.book_title", "m.author", "m.chapter_titles", "m.listed_titles", F.posexplode(chosen).alias("p", "chapter_idx"))
    title = F.coalesce(F.get("chapter_titles", F.col("chapter_idx").cast("int")), F.get("listed_titles", F.col("p")))
    return one.select("book_id", "book_title", "author", "chapter_idx", title.alias("chapter_title"))


def metadata(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    return metadata_rows(spark.read.text(path, wholetext=True), split)


def paragraph_nums() -> Column:
    """Paragraph numbers from 1, or from the older indices from 0."""
    return F.coalesce("paragraph_nums", F.transform("paragraph_idxs", lambda i: i + 1))


def segments(spark: SparkSession, glob: str) -> DataFrame:
    """book_id, chapter_idx, seg_num, paragraph_num, text from segment files in the old or new layout."""
    layout = "paragraph_nums array<bigint>, paragraph_idxs array<bigint>, segments array<string>, sentences array<string>"
    raw = spark.read.schema(layout).option("multiLine", True).json(glob).select("*", "_metadata.file_path")
    both = F.arrays_zip(paragraph_nums().alias("n"), F.coalesce("segments", "sentences").alias("t"))
    return raw.select(*chapter_key(F.col("file_path")), F.posexplode(both).alias("p", "s")).select("book_id", "chapter_idx", (F.col("p") + 1).cast("bigint").alias("seg_num"), F.col("s.n").alias("paragraph_num"), F.col("s.t").alias("text"))


def nums_from_segments(rows: DataFrame) -> DataFrame:
    """Segment numbers of rows that only hold texts: they count on through the chapter, each side on its own."""
    upto = Window.partitionBy("chapter_idx").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for side in ("original", "abridged"):
        end = F.sum(F.size(f"{side}_segments")).over(upto)
        n = F.size(f"{side}_segments")
        out = out.withColumn(f"{side}_nums", F.when(n > 0, F.sequence(end - n + 1, end)).otherwise(F.array().cast("array<bigint>")))
    return out


def alignments(spark: SparkSession, glob: str) -> DataFrame:
    """Alignment rows from either layout: an array of objects, or an object of parallel arrays."""
    side = "{0}_paragraph_nums array<array<bigint>>, {0}_segments array<array<string>>"
    columnar = f"struct<{side.format('original').replace(' array', ':array')},{side.format('abridged').replace(' array', ':array')}>".replace(", ", ",")
    rowwise = "array<struct<original_paragraph_nums:array<bigint>,original_segments:array<string>,abridged_paragraph_nums:array<bigint>,abridged_segments:array<string>>>"
    raw = spark.read.text(glob, wholetext=True).select("*", "_metadata.file_path")
    fields = ("original_paragraph_nums", "original_segments", "abridged_paragraph_nums", "abridged_segments")
    wide = F.from_json("value", columnar)
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", rowwise)).otherwise(F.arrays_zip(*[wide[f].alias(f) for f in fields]))
    return nums_from_segments(raw.select(*chapter_key(F.col("file_path")), F.posexplode(rows).alias("row", "r")).select("book_id", "chapter_idx", F.col("row").cast("bigint").alias("row"), "r.*"))


def sheet_validator(name: Column) -> Column:
    """The validator that a file name of six parts names; null otherwise."""
    parts = F.split(name, "\\.")
    return F.when(F.size(parts) == 6, F.get(parts, 4))


def sheets(spark: SparkSession, glob: str) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(glob)
    return raw.select("*", sheet_validator(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("validator"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tokens array<string>, predicted_labels array<int>").json(path)


def vectors(spark: SparkSession, path: str, max_window: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("window_size") <= max_window)


def items(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """JSON lists of objects with text and whatever else: one list a file, or one a line."""
    return spark.read.option("multiLine", one_per_file).json(path)


def plain_chapters(spark: SparkSession, glob: str) -> DataFrame:
    raw = spark.read.text(glob, wholetext=True).select("value", "_metadata.file_path")
    return raw.select(*chapter_key(F.col("file_path")), F.posexplode(F.split("value", "\n", -1)).alias("par_idx", "line"))

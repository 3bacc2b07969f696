"""A Spark data source for the corpus layouts: packed chapters, segments, alignments, predictions, review sheets, plain texts.

    spark.dataSource.register(LayoutSource)
    spark.read.format("spanloom_layout").option("layout", "segments").load(folder).where("book_id = 'b'")

Files lie in a folder for each book (`<book>/` or `book_id=<book>/`), one chapter to a file that its number names, or many chapters to a file, one
to a line, each with its chapter_idx. Partitions are planned by file: those of a few MB share one. Conditions on book_id and chapter_idx drop
the files of other books and chapters before any is opened (with the option pushdown, which `read` sets where spark.sql.python.filterPushdown.enabled
is, or by the option `books`, a JSON list); Spark applies them to the rows again. Schemas follow the layout, in its older forms too. Files are opened where the tasks run, by
URI, so the folder must be one that all machines reach.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "spanloom_layout"
VERSION = "struct<text:string,paragraph_chars:array<array<bigint>>,segment_chars:array<array<bigint>>,overlap_chars:array<array<bigint>>,row_chars:array<array<bigint>>>"
SIDE = "{0}_paragraph_nums array<array<bigint>>, {0}_segments array<array<string>>"
LAYOUTS = {
    "packed": f"original {VERSION}, abridged {VERSION}",
    "segments": "paragraph_nums array<bigint>, segments array<string>",
    "alignments": f"{SIDE.format('original')}, {SIDE.format('abridged')}",
    "predictions": "tokens array<string>, predicted_labels array<int>",
    "sheets": "validator string, row bigint, Original_Segments string, Abridged_Segments string",
    "texts": "text string",
}
#: Bytes of the files that one partition reads, unless a single one has more; rows of a batch.
PART_BYTES, BATCH = 16 << 20, 256


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI or a plain path."""
    plain = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(path)


def keys_of(path: str) -> tuple[str, int | None, str | None]:
    """book_id, and the chapter and validator where folders or the file's name say them."""
    *folders, name = path.split("/")
    named = dict(f.split("=", 1) for f in folders if "=" in f)
    parts = name.split(".")
    sheet = len(parts) == 6  # <book>.<chapter>.alignment.sheet.<validator>.csv
    book = unquote(named["book_id"]) if "book_id" in named else parts[0] if sheet else folders[-1]
    chapter = parts[1] if sheet else parts[0]
    return book, int(chapter) if re.fullmatch("[0-9]+", chapter) else None, unquote(named["validator"]) if "validator" in named else parts[4] if sheet else None


@dataclass
class Files(InputPartition):
    paths: list[str]


def modern(layout: str, found: object) -> dict:
    """An object of a layout, with the names and forms of older ones brought up to date."""
    if layout == "alignments" and isinstance(found, list):
        return {c: [r.get(c) for r in found] for c in ("original_paragraph_nums", "original_segments", "abridged_paragraph_nums", "abridged_segments")}
    if layout == "segments":
        newer = dict(found)
        if newer.get("paragraph_nums") is None and found.get("paragraph_idxs") is not None:
            newer["paragraph_nums"] = [i + 1 for i in found["paragraph_idxs"]]
        if newer.get("segments") is None:
            newer["segments"] = found.get("sentences")
        return newer
    return found


class LayoutReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = options, schema
        self.layout = options["layout"]
        self.books = set(json.loads(options["books"])) if "books" in options else None
        self.chapters: set[int] | None = None

    def wanted(self, path: str) -> bool:
        book, chapter, _ = keys_of(path)
        return (self.books is None or book in self.books) and (self.chapters is None or chapter is None or chapter in self.chapters)

    def partitions(self) -> list[Files]:
        system, root = place(self.options["path"])
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not re.search(r"(^|/)[_.][^/]*$", f.path[len(root) :])]
        parts, size = [], PART_BYTES
        for f in sorted(found, key=lambda f: f.path):
            if not self.wanted(f.path):
                continue
            if size + f.size > PART_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(f.path)
            size += f.size
        return parts or [Files([])]

    def rows(self, system: fs.FileSystem, path: str) -> Iterator[dict]:
        book, chapter, validator = keys_of(path)
        key = {"book_id": book, "chapter_idx": chapter}
        with system.open_input_stream(path) as raw, io.TextIOWrapper(raw, "utf-8", newline="") as lines:
            if self.layout == "sheets":
                for k, row in enumerate(csv.DictReader(lines)):
                    numbers = {c: int(row[c]) for c in ("chapter_idx", "row") if row.get(c)}
                    yield key | row | {"validator": validator, "row": k} | numbers
            elif self.layout == "texts" and chapter is not None:
                yield key | {"text": lines.read()}
            elif chapter is not None:
                yield modern(self.layout, json.load(lines)) | key
            else:
                for line in lines:
                    if line.strip():
                        one = json.loads(line)
                        yield modern(self.layout, one) | {"book_id": book, "chapter_idx": one.get("chapter_idx")}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema, (system, _) = to_arrow_schema(self.schema), place(self.options["path"])
        held: list[dict] = []
        for path in partition.paths:
            for row in self.rows(system, path):
                held.append({c: row.get(c) for c in schema.names})
                if len(held) >= BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class PushdownReader(LayoutReader):
    """Spark refuses readers that take conditions where its setting for them is off, so this is a class of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """What is asked of books and chapters prunes files; all conditions are left to Spark as well."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("book_id",):
                self.books = values if self.books is None else self.books & values
            elif values is not None and f.attribute == ("chapter_idx",):
                self.chapters = values if self.chapters is None else self.chapters & values
            yield f


class LayoutSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"book_id string, chapter_idx bigint, {LAYOUTS[self.options['layout']]}"

    def reader(self, schema: T.StructType) -> LayoutReader:
        options = dict(self.options)
        return (PushdownReader if options.get("pushdown") == "true" else LayoutReader)(options, schema)


def read(spark: SparkSession, path: str, layout: str, books: list[str] | None = None) -> DataFrame:
    """book_id, chapter_idx and the layout's columns. books: only these books' files are opened."""
    spark.dataSource.register(LayoutSource)
    options = {"layout": layout, "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | ({} if books is None else {"books": json.dumps(books)})
    return spark.read.format(NAME).options(**options).load(path)

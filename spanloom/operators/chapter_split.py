"""Splitting a book's lines into chapters at headings."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How lines begin that open sections and chapters, stand alone, or end a book.
SECTIONS = ("Book", "BOOK", "Volume", "VOLUME")
CHAPTERS = ("Chapter", "CHAPTER")
ALONE = ("Prologue", "PROLOGUE", "Epilogue", "EPILOGUE", "Preface", "PREFACE")
ENDS = ("*** END", "***END", "The End", "THE END")


def numbered_parts(lines: DataFrame, heading: Column) -> DataFrame:
    """Lines (chapter_idx, k, line) with part: how many headings there are up to the line."""
    upto = Window.partitionBy("chapter_idx").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("part", F.sum(heading.cast("int")).over(upto).cast("bigint"))


@dataclass
class Chapter:
    book: int | None
    book_title: str | None
    number: int | None
    title: str | None = None
    lines: list[str] = field(default_factory=list)
    awaits_title: bool = False


_ROMAN = re.compile(r"[IVXLCDM]+$", re.I)


def number_of(words: str) -> int | None:
    """Digits, a numeral or number words."""
    from spanloom.functions.text import ROMAN, SCALES, TENS, UNITS

    if words.isdigit():
        return int(words)
    if _ROMAN.match(words):
        v = [ROMAN[c] for c in words.upper()]
        return sum(-x if k + 1 < len(v) and v[k + 1] > x else x for k, x in enumerate(v))
    small = {w: k for k, w in enumerate(UNITS)} | {w: 10 * (k + 2) for k, w in enumerate(TENS)}
    now = done = 0
    parts = [w for w in words.lower().replace("-", " ").split() if w != "and"]
    for w in parts:
        if w in SCALES:
            now = max(now, 1) * SCALES[w]
            if SCALES[w] > 100:
                now, done = 0, done + now
        elif w in small:
            now += small[w]
        else:
            return None
    return now + done if parts else None


def heading(line: str, openings: Iterable[str]) -> tuple[int | None, str | None] | None:
    """(number, title) of a line that begins with one of the openings and names a number, else None."""
    first, _, rest = line.strip().partition(" ")
    if first not in openings:
        return None
    name, _, title = rest.strip().partition(".")
    number = number_of(name.strip().rstrip(":"))
    if number is None:
        name, _, title = rest.strip().partition(" ")
        number = number_of(name.rstrip(".:"))
    return None if number is None else (number, title.strip(" .:-") or None)


def split_book(lines: Iterable[str]) -> list[Chapter]:
    """Chapters with text, in order; headings without text are a table of contents. Without an end line: ValueError."""
    found: list[Chapter] = []
    now: Chapter | None = None
    book: tuple[int | None, str | None] = (None, None)
    for line in lines:
        plain = line.strip()
        if plain.startswith(ENDS):
            return [c for c in found if any(x.strip() for x in c.lines)]
        if section := heading(plain, SECTIONS):
            book, now = section, None
        elif chapter := heading(plain, CHAPTERS):
            now = Chapter(*book, chapter[0], chapter[1], awaits_title=chapter[1] is None)
            found.append(now)
        elif plain in ALONE:
            now = Chapter(*book, 0, plain)
            found.append(now)
        elif now is not None:
            if now.awaits_title and plain:
                now.awaits_title = False
                if plain == "-":
                    continue
                if any(c.isalnum() for c in plain) and plain[-1].isalnum():
                    now.title = plain
                    continue
            now.lines.append(line)
    raise ValueError("the book has no end line")


def split_books(books: DataFrame, key: str = "book_id", text: str = "text") -> DataFrame:
    """key, pos (from 0), book_num, book_title, number, title and lines of each chapter of each book's text; one book is one row, so nothing moves."""
    kind = books.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            found = [(k, i, c.book, c.book_title, c.number, c.title, c.lines) for k, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True) for i, c in enumerate(split_book(t.split("\n")))]
            out = pd.DataFrame(found, columns=["key", "pos", "book_num", "book_title", "number", "title", "lines"])
            yield out.astype({"book_num": "Int64", "number": "Int64", "pos": "int64"})

    made = books.where(books[text].isNotNull()).select(key, text).mapInPandas(run, f"key {kind}, pos bigint, book_num bigint, book_title string, number bigint, title string, lines array<string>")
    return made.withColumnRenamed("key", key)

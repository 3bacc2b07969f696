"""Token labels of passages from the overlaps that lie in them, and extracts of labelled tokens.

A passage is cut at its overlaps, in order: what an overlap covers is preserved (0), what lies between is modified (1). Each piece is
tokenised by itself; one that follows a space gets that space back, so that tokens which carry the blank before them keep it.
Both streams, overlaps and text, are gone through once. Where the overlaps are segments of the passages' own, they come in the passage's row (`label_tiled`, `kept_runs_of_tiled`);
other spans meet their passages in a sweep (`with_overlaps`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators.containment import contained

#: Tokens that end a run.
END_MARKS = [".", "?", "!", ":", ";"]
TOKENIZE = Callable[[str], list[str]]


def pieces(length: int, overlaps: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(from, to, label) for a text of this length and its overlaps in order."""
    at = 0
    for start, end in overlaps:
        yield at, start, 1
        yield start, end, 0
        at = end
    yield at, length, 1


def labelled_tokens(tokenize: TOKENIZE, text: str, overlaps: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """Tokens of a passage and their labels. overlaps: spans relative to the passage, in any order."""
    tokens: list[str] = []
    labels: list[int] = []
    for start, end, label in pieces(len(text), sorted(overlaps)):
        if start < end:
            piece = (" " if start and text[start - 1] == " " else "") + text[start:end]
            found = tokenize(piece.rstrip() if piece[-1] == " " else piece)
            tokens += found
            labels += [label] * len(found)
    return tokens, labels


def with_overlaps(passages: DataFrame, segments: DataFrame, overlaps: DataFrame) -> DataFrame:
    """chapter_idx, idx, text and overlaps (array of (start, end) relative to the passage, in order) of passages that segments tile.

    passages: chapter_idx, idx, start_char, end_char; segments: chapter_idx, start_char, end_char, text; overlaps: chapter_idx, o_start, o_end.
    Segments and overlaps meet their passages in one sweep; a passage's text is that of its segments, so no chapter's text is copied to its passages.
    """
    parts = segments.select("chapter_idx", "start_char", "end_char", "text").unionByName(overlaps.select("chapter_idx", F.col("o_start").alias("start_char"), F.col("o_end").alias("end_char")), allowMissingColumns=True)
    found = contained(parts, passages.select("chapter_idx", "idx", "start_char", "end_char"))
    own, base = F.col("inner"), F.col("outer.start_char")
    span = F.struct((own["start_char"] - base).alias("start"), (own["end_char"] - base).alias("end"))
    texts = F.collect_list(F.when(own["text"].isNotNull(), F.struct(own["start_char"].alias("start"), own["text"].alias("text"))))
    grouped = found.groupBy("chapter_idx", F.col("outer.idx").alias("idx")).agg(F.array_sort(texts).alias("t"), F.array_sort(F.collect_list(F.when(own["text"].isNull(), span))).alias("overlaps"))
    return grouped.select("chapter_idx", "idx", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"), "overlaps")


def kept_texts(tokens: list[str], labels: list[int], threshold: float = 0.5) -> list[str]:
    """Texts of the token runs, up to an end mark each, of which at least this share is labelled 0."""
    out, at, marks = [], 0, frozenset(END_MARKS)
    ends = [i for i, t in enumerate(tokens, 1) if t in marks]
    for end in ends if not tokens or tokens[-1] in marks else [*ends, len(tokens)]:
        if labels[at:end].count(0) / (end - at) >= threshold:
            out.append("".join(tokens[at:end]))
        at = end
    return out


def label_passages(rows: DataFrame, tokenize: Callable[[], TOKENIZE]) -> DataFrame:
    """chapter_idx, idx, tokens, labels from the rows of `with_overlaps`: one narrow pass. tokenize makes a worker's tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = tokenize()
        for b in batches:
            made = [labelled_tokens(cut, t, [(o["start"], o["end"]) for o in own]) for t, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield labelled_batch(b, made)

    return rows.select("chapter_idx", "idx", "text", "overlaps").mapInArrow(run, LABELLED)


LABELLED = "chapter_idx bigint, idx bigint, tokens array<string>, labels array<int>"


def labelled_batch(b: pa.RecordBatch, made: list[tuple[list[str], list[int]]]) -> pa.RecordBatch:
    sides = [pa.array([m[i] for m in made], kind) for i, kind in ((0, pa.list_(pa.string())), (1, pa.list_(pa.int32())))]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *sides], ["chapter_idx", "idx", "tokens", "labels"])


def tiled(cut: TOKENIZE, b: pa.RecordBatch) -> Iterator[tuple[list[str], list[int]]]:
    """Tokens and labels of a batch of chapter_idx, idx, text, sizes, kept."""
    for text, sizes, kept in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
        yield labelled_tokens(cut, text, [(end - n, end) for n, end, k in zip(sizes, accumulate(sizes), kept, strict=True) if k])


def label_tiled(rows: DataFrame, tokenize: Callable[[], TOKENIZE]) -> DataFrame:
    """As `label_passages`, from rows(chapter_idx, idx, text, sizes, kept): the sizes of the segments that tile a passage, and which of them are overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = tokenize()
        for b in batches:
            yield labelled_batch(b, list(tiled(cut, b)))

    return rows.select("chapter_idx", "idx", "text", "sizes", "kept").mapInArrow(run, LABELLED)


def kept_runs_of_tiled(rows: DataFrame, tokenize: Callable[[], TOKENIZE], threshold: float = 0.5) -> DataFrame:
    """chapter_idx, idx and the texts of the `kept` runs, from the same rows: tokens stay where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = tokenize()
        for b in batches:
            texts = [kept_texts(*made, threshold) for made in tiled(cut, b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.list_(pa.string()))], ["chapter_idx", "idx", "kept"])

    return rows.select("chapter_idx", "idx", "text", "sizes", "kept").mapInArrow(run, "chapter_idx bigint, idx bigint, kept array<string>")


def plain_tokenizer() -> TOKENIZE:
    """Words and marks with the blank before them: stands in for a subword tokenizer that is injected."""
    import re

    return re.compile(tx.TOKEN).findall


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: an expression that a function of elements names is computed again for each of them."""
    return F.get(F.transform(F.array(value), body), 0)


def runs(tokens: Column) -> Column:
    """(first, size) of the token runs that end with an end mark; the last one ends with the tokens."""
    every = F.sequence(F.lit(0), F.size(tokens) - 1)
    found = F.filter(every, lambda i: F.get(tokens, i).isin(*END_MARKS) | (i == F.size(tokens) - 1))
    cut = bound(found, lambda ends: F.transform(ends, lambda e, k: F.struct(F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1).alias("first"), e.alias("last"))))
    return F.when(F.size(tokens) > 0, F.transform(cut, lambda r: F.struct(r["first"].alias("first"), (r["last"] - r["first"] + 1).alias("size")))).otherwise(F.array().cast("array<struct<first:int,size:int>>"))


def spaced(parts: Column) -> Column:
    """Parts after each other, with a space where neither side has a blank: all that a part needs of what stands before it is the last part's last character."""
    blank = lambda c: c.isin(" ", "\n")
    last = lambda t: F.substring(t, -1, 1)
    gap = lambda all_, p, i: (i > 0) & ~blank(last(F.get(all_, i - 1))) & ~blank(F.substring(p, 1, 1))
    return F.array_join(bound(parts, lambda all_: F.transform(all_, lambda p, i: F.when(gap(all_, p, i), F.concat(F.lit(" "), p)).otherwise(p))), "")


def kept_runs(tokens: Column, labels: Column, threshold: float = 0.5) -> Column:
    """Texts of the runs of which at least this share is labelled 0. Labels may be fewer than tokens: those missing are 0."""
    zeros = lambda full, r: F.size(F.filter(F.slice(full, r["first"] + 1, r["size"]), lambda y: y == 0))
    kept = bound(tx.padded_labels(tokens, labels), lambda full: F.filter(runs(tokens), lambda r: zeros(full, r) / r["size"] >= threshold))
    return F.transform(kept, lambda r: F.array_join(F.slice(tokens, r["first"] + 1, r["size"]), ""))


def chapter_extract(texts: Column) -> Column:
    """A chapter's extract from those of its passages, (idx, text), blanks at the ends taken off."""
    return F.regexp_replace(F.array_join(F.transform(F.array_sort(texts), lambda x: x["text"]), " "), r"^\s+|\s+$", "")

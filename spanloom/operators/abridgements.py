"""Which stretch of the short text belongs to each passage of the long one.

Passages are taken in order. Each claims the characters of its overlaps; where claims compete, the longest
stretch that only earlier passages claim decides who keeps what. The claims become spans, the spans are
stretched to sentence ends so that they cover the short text without gaps.

Claims are kept as disjoint intervals in order, so the work follows the number of claimed stretches, not the characters.
The state runs through a chapter's passages, so both sides are listed by chapter; chapters pass a worker many to a batch.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]


def set_order(found: list[int]) -> int | None:
    """Of some sentence ends, in ascending order, the first in the order of a set that they entered one by one."""
    return next(iter(set(found)), None)


def least(found: list[int]) -> int | None:
    return found[0] if found else None


def united(spans: Iterable[Span]) -> list[Span]:
    """The same characters as disjoint spans in order."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return [x for x in out if x[0] < x[1]]


class Claims:
    """Disjoint intervals of a text with the passage that holds each: parallel lists in order of their starts."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.owners: list[int] = []

    def put(self, a: int, b: int, owner: int) -> None:
        """owner takes [a, b); what others held of it is cut off."""
        i, j = bisect_right(self.ends, a), bisect_left(self.starts, b)
        left = [(self.starts[i], a, self.owners[i])] if i < j and self.starts[i] < a else []
        right = [(b, self.ends[j - 1], self.owners[j - 1])] if i < j and self.ends[j - 1] > b else []
        self.replace(i, j, [*left, (a, b, owner), *right])

    def replace(self, i: int, j: int, new: list[tuple[int, int, int]]) -> None:
        """Intervals i to j become the new ones; neighbours of one owner become one."""
        i, j = max(i - 1, 0), min(j + 1, len(self.starts))
        before = list(zip(self.starts[i:j], self.ends[i:j], self.owners[i:j], strict=True))
        whole = sorted([x for x in before if not new or x[1] <= new[0][0] or x[0] >= new[-1][1]] + new)
        joined: list[list[int]] = []
        for x in whole:
            if joined and joined[-1][1] == x[0] and joined[-1][2] == x[2]:
                joined[-1][1] = x[1]
            else:
                joined.append(list(x))
        for side, k in ((self.starts, 0), (self.ends, 1), (self.owners, 2)):
            side[i:j] = [x[k] for x in joined]

    def pieces(self, wanted: list[Span], start: int) -> list[tuple[int, int, int, bool]]:
        """From start to the last character held: (from, to, owner or -1, wanted), without what is neither."""
        i, stop = bisect_right(self.ends, start), self.ends[-1]
        held = [(max(a, start), b, o) for a, b, o in zip(self.starts[i:], self.ends[i:], self.owners[i:], strict=True)]
        asked = [(max(a, start), min(b, stop)) for a, b in wanted if b > start and a < stop]
        edges = sorted({x for a, b, *_ in [*held, *asked] for x in (a, b)})
        out, h, w = [], 0, 0
        for a, b in zip(edges, edges[1:], strict=False):
            while h < len(held) and held[h][1] <= a:
                h += 1
            while w < len(asked) and asked[w][1] <= a:
                w += 1
            owner = held[h][2] if h < len(held) and held[h][0] <= a else -1
            is_asked = w < len(asked) and asked[w][0] <= a
            if owner >= 0 or is_asked:
                out.append((a, b, owner, is_asked))
        return out

    def claim(self, number: int, spans: list[Span]) -> None:
        """Enter one passage's claim. spans in the order of its list: what comes before the first one's start is taken without contest.

        In the contested zone, up to the last character that is held, the longest stretch that is only held, not asked for (characters
        in neither state left out, of equally long ones the later), keeps its holder, with what stands before it, if it is longer
        than all of the zone before it; the claim takes the rest. If nothing is behind such a stretch, the zone stays as it is.
        """
        wanted = united(spans)
        start = spans[0][0]
        stop = self.ends[-1] if self.ends else 0
        if start < stop:
            zone = self.pieces(wanted, start)
            at, runs, first = 0, [], None  # (size, end, number of the piece behind it)
            for k, (a, b, _, asked) in enumerate(zone):
                if not asked and first is None:
                    first = at
                at += b - a
                if first is not None and (k + 1 == len(zone) or zone[k + 1][3]):
                    runs.append((at - first, at, k + 1))
                    first = None
            size, end, behind = max(runs, default=(0, at, len(zone)))
            keep = 0 if size <= end - size else behind
            if keep < len(zone):
                new = [(a, b, number if k >= keep else o) for k, (a, b, o, asked) in enumerate(zone) if (asked if k >= keep else o >= 0)]
                i = bisect_right(self.ends, start)
                cut = [(self.starts[i], start, self.owners[i])] if self.starts[i] < start else []
                for side in (self.starts, self.ends, self.owners):
                    del side[i:]
                self.replace(i, i, [*cut, *new])
        for a, b in wanted:
            if a < min(start, b):
                self.put(a, min(start, b), number)
            if b > max(stop, start, a):
                self.put(max(stop, start, a), b, number)

    def spans(self, n: int) -> list[Span]:
        """Each of n passages' claim from its first to its last character; without one, an empty span at the previous end."""
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        for a, b, o in zip(self.starts, self.ends, self.owners, strict=True):
            first.setdefault(o, a)
            last[o] = b
        out: list[Span] = []
        for i in range(n):
            at = out[-1][1] if out else 0
            out.append((first[i], last[i]) if i in first else (at, at))
        return out

    def sizes(self) -> dict[int, int]:
        """Characters by passage."""
        out: dict[int, int] = {}
        for a, b, o in zip(self.starts, self.ends, self.owners, strict=True):
            out[o] = out.get(o, 0) + b - a
        return out


def abridged_spans(claims: Iterable[list[Span] | None], ends: Iterable[int], length: int, pick: Callable[[list[int]], int | None] = set_order) -> list[Span]:
    """Spans that tile the short text, one for each passage's claims (overlap spans on the short side, or none)."""
    claims, ends, held = list(claims), sorted(set(ends)), Claims()
    for i, spans in enumerate(claims):
        if spans:
            held.claim(i, spans)
    out: list[Span] = []
    full = None  # the last span that is not empty
    for i, (start, end) in enumerate(held.spans(len(claims))):
        if out and full is not None:
            before = out[-1][1]
            boundary = pick(ends[bisect_left(ends, before) : bisect_right(ends, start)])
            if boundary is not None and boundary > before:
                out[full:] = [(out[full][0], boundary)] + [(boundary, boundary)] * (len(out) - full - 1)
        out.append((out[-1][1] if out else 0, length if i == len(claims) - 1 else end))
        full = i if out[-1][0] != out[-1][1] else full
    return out


def within(starts: np.ndarray, ends: np.ndarray, passages: Iterable[Span]) -> list[list[int]]:
    """For each passage the numbers of the spans that lie in it, in their order: found by binary search among the starts."""
    order = np.argsort(starts, kind="stable")
    by_start, in_order, lasts = starts[order], order.tolist(), ends.tolist()
    cuts = np.array(list(passages), np.int64).reshape(-1, 2)
    sides = (np.searchsorted(by_start, cuts[:, 0]), np.searchsorted(by_start, cuts[:, 1], "right"), cuts[:, 1])
    return [sorted(k for k in in_order[i:j] if lasts[k] <= b) for i, j, b in zip(*(x.tolist() for x in sides), strict=True)]


def numbers(listed: pa.Array, *names: str) -> Iterator[list[np.ndarray]]:
    """A list's fields as arrays, row by row; none of a null list."""
    flat = listed.flatten()
    columns, at = [flat.field(n).to_numpy() for n in names], 0
    for n in listed.value_lengths().to_pylist():
        yield [c[at : at + (n or 0)] for c in columns]
        at += n or 0


def rows_made(chapters: pa.Array, made: list[list[Iterable[int]]], names: list[str]) -> pa.RecordBatch:
    """made: columns of numbers for each chapter, whose rows they are."""
    sides = [np.fromiter((x for m in made for x in m[k]), np.int64) for k in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(chapters.to_numpy(), [len(m[0]) for m in made]), pa.int64()), *map(pa.array, sides)], ["chapter_idx", *names])


def claimed(overlaps: DataFrame) -> DataFrame:
    """overlaps(chapter_idx, idx, pos, a_start, a_end), in which idx names the passage that claims: chapter_idx, place (of the passage among those that claim), n_chars that it holds in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for idx, starts, ends in numbers(b.column(1), "idx", "a_start", "a_end"):
                held, cuts = Claims(), np.flatnonzero(np.diff(idx, prepend=idx[0] - 1)).tolist()
                spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
                for k, (i, j) in enumerate(zip(cuts, [*cuts[1:], len(spans)], strict=True)):
                    held.claim(k, spans[i:j])
                sizes = held.sizes()
                made.append([list(sizes), list(sizes.values())])
            yield rows_made(b.column(0), made, ["place", "n_chars"])

    listed = overlaps.groupBy("chapter_idx").agg(F.array_sort(F.collect_list(F.struct("idx", "pos", "a_start", "a_end"))).alias("found"))
    return listed.mapInArrow(run, "chapter_idx bigint, place bigint, n_chars bigint")


def infer(passages: DataFrame, overlaps: DataFrame, chapters: DataFrame, pick: Callable = set_order) -> DataFrame:
    """passages(chapter_idx, idx, start_char, end_char), overlaps(chapter_idx, pos, o_start, o_end, a_start, a_end),
    chapters(chapter_idx, a_length, a_ends array): chapter_idx, idx, abridged_start, abridged_end.

    A chapter's passages, overlaps and sentence ends each come once, in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            sides = (numbers(b.column(1), "idx", "start_char", "end_char"), numbers(b.column(2), "o_start", "o_end", "a_start", "a_end"), b.column(3).to_pylist(), b.column(4).to_pylist())
            for (idx, starts, ends), (o0, o1, a0, a1), length, a_ends in zip(*sides, strict=True):
                spans = list(zip(a0.tolist(), a1.tolist(), strict=True))
                claims = [[spans[k] for k in mine] for mine in within(o0, o1, zip(starts.tolist(), ends.tolist(), strict=True))]
                got = abridged_spans(claims, a_ends or (), length, pick)
                made.append([idx.tolist(), [a for a, _ in got], [e for _, e in got]])
            yield rows_made(b.column(0), made, ["idx", "abridged_start", "abridged_end"])

    left = passages.groupBy("chapter_idx").agg(F.array_sort(F.collect_list(F.struct("idx", "start_char", "end_char"))).alias("own"))
    right = overlaps.select(F.col("chapter_idx").alias("chapter"), "pos", "o_start", "o_end", "a_start", "a_end")  # own names, as both sides may stem from one table
    found = right.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("pos", "o_start", "o_end", "a_start", "a_end"))).alias("found"))
    both = left.join(chapters.select("chapter_idx", "a_length", "a_ends"), "chapter_idx").join(found, F.col("chapter_idx") == F.col("chapter"), "left")
    return both.select("chapter_idx", "own", "found", "a_length", "a_ends").mapInArrow(run, "chapter_idx bigint, idx bigint, abridged_start bigint, abridged_end bigint")

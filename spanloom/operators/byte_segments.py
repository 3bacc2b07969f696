"""Segments of many texts at once, as places in their bytes: for functions of segments that need no text of their own for each of them.

The segments are those of `functions.text`: paragraphs end behind a line break, sentences behind a run of end marks and the blanks that
follow it. They tile a text, and what ends them is ASCII, so a segment never cuts a character. Blanks are those of RE2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANKS, MARKS, LINE = b"\t\n\f\r ", b".!?", 10
#: Bytes of texts that are cut at a time (a longer text goes by itself).
GROUP = 1 << 19


def among(values: bytes) -> np.ndarray:
    """A table of 256: whether a byte is one of these."""
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


BLANK, MARK = among(BLANKS), among(MARKS)


class Segments:
    """The segments of texts that follow each other in data; edges: where texts start, and the end of the last."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        self.data, self.edges = data, edges
        n = len(data)
        self.blank = blank = BLANK[data]
        self.opens = opens = np.zeros(n + 1, bool)  # where a text starts
        opens[edges] = True
        mark, lines = MARK[data], np.flatnonzero(data == LINE)
        first = opens.copy()
        first[lines + 1] = True
        first[1:n] |= mark[:-1] & ~mark[1:] & ~blank[1:]
        # blanks behind a mark belong to it, unless a line break is among them: then what follows starts a paragraph
        after = np.concatenate([[False], blank])
        runs = np.flatnonzero(blank & (~after[:-1] | opens[:-1]))
        ends = np.flatnonzero(after & np.concatenate([~blank | opens[:-1], [True]]))
        marked = (runs > 0) & ~opens[runs] & mark[runs - 1]
        first[ends[marked & (np.searchsorted(lines, runs) == np.searchsorted(lines, ends))]] = True
        #: Whether a segment starts at a byte; the end counts as a start.
        self.first = first
        self.starts = np.flatnonzero(first[:-1])
        self.ends = np.append(self.starts[1:], n)[: len(self.starts)]
        self.text = np.searchsorted(edges, self.starts, "right") - 1
        #: Of each text the number of segments before it, and of all.
        self.before = np.searchsorted(self.starts, edges)
        self.number = np.arange(len(self.starts)) - self.before[self.text]
        self.paragraph = np.searchsorted(lines, self.starts) - np.searchsorted(lines, edges)[self.text]


def grouped(texts: pa.Array) -> Iterator[tuple[int, int, Segments]]:
    """(from, to, segments) for texts without nulls, some neighbours at a time."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + GROUP, "right")) - 1)
        yield a, b, Segments(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b

"""Labelled tokens of passages whose pieces are segments, counted and digested without a list of tokens for each passage.

Words and single marks (`labels.plain_tokenizer`, with the blanks of RE2) never reach over a segment's end, so a text is tokenised once for all kinds
of passages: a passage's tokens are a stretch of the text's. Only the blank before a segment's first token depends on where the segment stands: none
at a passage's start, a space behind a space, and other blanks if no piece ends there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.operators.byte_segments import Segments, among, grouped

WORD = among(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Bytes that go on with a character.
WITHIN = among(bytes(range(0x80, 0xC0)))


class Tokens:
    """The tokens of texts in order. kept: whether a segment is an overlap, a piece of its own; other neighbours are one piece."""

    def __init__(self, s: Segments, kept: np.ndarray):
        self.s, data, n = s, s.data, len(s.data)
        word, blank = WORD[data], s.blank
        first = ~word & ~blank & ~WITHIN[data]  # where tokens start, without the blanks before them
        first |= word & (s.opens[:-1] | ~np.concatenate([[False], word[:-1]]))
        self.at = np.flatnonzero(first)
        shown = ~blank
        shown[:-1] |= blank[:-1] & first[1:] & ~s.opens[1:n]
        cut = s.starts[1:][(kept[1:] | kept[:-1]) & ~s.opens[s.starts[1:]]] - 1
        shown[cut[blank[cut] & (data[cut] != 32)]] = False
        last = ~blank & np.concatenate([(first | blank | s.opens[:-1])[1:], [True]])
        # each token is followed by a mark
        size = shown.view(np.int8) + last
        self.upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        out = np.full(self.upto[-1], ord("|"), np.uint8)
        out[self.upto[:-1][shown]] = data[shown]
        self.joined, self.end = out.tobytes(), self.upto[1:][last] - 1
        modified = ~kept[np.searchsorted(s.starts, self.at, "right") - 1]
        self.modified = np.concatenate([[0], np.cumsum(modified)])
        self.labels = (modified + np.uint8(ord("0"))).astype(np.uint8).tobytes()

    def counted(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Of the passages from segment first up to last: tokens, modified ones, and a digest of tokens and labels."""
        starts = np.append(self.s.starts, len(self.s.data))
        a, b = np.searchsorted(self.at, starts[first]), np.searchsorted(self.at, starts[last])
        x = self.upto[starts[first]]
        y = np.where(a < b, np.append(self.end, 0)[b - 1], x)
        said = [hashlib.md5(self.joined[p:q] + b"#" + self.labels[i:j]).hexdigest() for p, q, i, j in zip(x.tolist(), y.tolist(), a.tolist(), b.tolist(), strict=True)]
        return b - a, self.modified[b] - self.modified[a], said


def chunk_starts(s: Segments, first: np.ndarray, most: int) -> np.ndarray:
    """Segments that start a chunk (`chunks.max_chunks`); first: those that start a paragraph."""
    out, size = [], 0
    sizes, opens = np.diff(np.append(first, len(s.starts))), s.number[first] == 0
    for at, n, anew in zip(first.tolist(), sizes.tolist(), opens.tolist(), strict=True):
        if not anew and size + n <= most:
            size += n
        else:
            out += range(at, at + n, most)
            size = n - (n - 1) // most * most
    return np.array(out, np.int64)


def passages(s: Segments, most: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Kind, first segments and numbers of the passages that tile the texts: each reaches to the next of its kind."""
    every, number = np.arange(len(s.starts)), s.number
    opens = number == 0
    paragraphs = np.flatnonzero(opens | (np.diff(s.paragraph, prepend=-1) != 0))
    chunks = chunk_starts(s, paragraphs, most)
    yield "segment", every, number
    yield "oracle_span", every[number % 2 == 0], number[number % 2 == 0] // 2
    yield "paragraph", paragraphs, s.paragraph[paragraphs]
    yield "chunk", chunks, np.arange(len(chunks)) - np.searchsorted(chunks, s.before[s.text[chunks]])
    yield "chapter", every[opens], number[opens]


def label_counts(chapters: DataFrame, text: str, keeps: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> DataFrame:
    """chapter_idx, idx, n_tokens, n_modified, digest, kind of all kinds of passages, chunks of at most `most` segments among them: one narrow pass.

    chapters: chapter_idx and a text. keeps: whether segments are kept, by chapter and number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for low, high, s in grouped(b.column(1)):
                if not len(s.starts):
                    continue
                key = keys[low:high][s.text]
                tokens = Tokens(s, keeps(key, s.number))
                for kind, first, idx in passages(s, most):
                    made = tokens.counted(first, np.append(first[1:], len(s.starts)))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (key[first], idx, *made)), pa.array([kind] * len(first))], ["chapter_idx", "idx", "n_tokens", "n_modified", "digest", "kind"])

    known = chapters.where(chapters["chapter_idx"].isNotNull() & chapters[text].isNotNull())
    return known.select("chapter_idx", text).mapInArrow(run, "chapter_idx bigint, idx bigint, n_tokens bigint, n_modified bigint, digest string, kind string")

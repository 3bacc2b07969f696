"""Batch inference with an injected model: vectors of texts, generated texts. Models stay outside of the library."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanloom.operators import byte_segments


@lru_cache(maxsize=1 << 18)
def bucket(word: bytes, size: int) -> int:
    return int.from_bytes(hashlib.md5(word).digest()[:4], "big") % size


def hashed_words(size: int) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for an encoder: word counts in hash buckets."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, bucket(w.encode(), size)] += 1
        return out

    return encode


def _batched(df: DataFrame, text: str, name: str, kind: T.DataType, work: Callable[[list[str]], list], size: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t or "" for t in f[text]]
            f[name] = [x for i in range(0, len(texts), size) for x in work(texts[i : i + size])]
            yield f

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def vectors(df: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], batch: int = 128) -> DataFrame:
    """df with vec; null texts count as empty."""
    return _batched(df, text, "vec", T.ArrayType(T.FloatType()), lambda texts: [v.tolist() for v in encode(texts)], batch)


def buckets(held: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Buckets of the words of these lengths that follow each other in held; each distinct word is hashed once."""
    upto = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(upto), pa.py_buffer(held)]).dictionary_encode()
    return np.array([bucket(w, size) for w in words.dictionary.to_numpy(zero_copy_only=False)], np.int64)[words.indices.to_numpy()]


def between(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of data, one after the other."""
    upto = np.cumsum(lengths)
    return data[np.arange(upto[-1]) + np.repeat(starts - upto + lengths, lengths)]


def window_counts(s: byte_segments.Segments, size: int, most: int) -> list[np.ndarray]:
    """For windows of 1 to `most` segments from each one on, cut at the end of their text: segments x size, the words of the window in hash buckets.

    A longer window has the counts of the shorter one and of its last segment. Where no blank stands between them, one word
    takes the place of the two that meet.
    """
    n, data, blank = len(s.starts), s.data, s.blank
    word = np.concatenate([[False], ~blank, [False]])  # of the bytes before, at and behind
    starts, ends = np.flatnonzero(word[1:-1] & (~word[:-2] | s.first[:-1])), np.flatnonzero(word[1:-1] & (~word[2:] | s.first[1:])) + 1
    own = np.bincount((np.searchsorted(s.starts, starts, "right") - 1) * size + buckets(data[~blank], ends - starts, size), minlength=n * size).reshape(n, size)
    met = np.flatnonzero(~s.opens[s.starts] & ~blank[s.starts] & ~blank[s.starts - 1]) if n else np.zeros(0, np.int64)
    at = s.starts[met]
    whole = np.flatnonzero(word[1:-1] & (~word[:-2] | s.opens[:-1]))  # words that no segment cuts
    begin, stop = whole[np.searchsorted(whole, at, "right") - 1], ends[np.searchsorted(starts, at)]
    out = [own]
    for w in range(1, most):
        longer, here = out[-1].copy(), s.number >= w
        longer[np.flatnonzero(here) - w] += own[here]
        far = here[met]
        if far.any():
            k, x, z = met[far], at[far], stop[far]
            a = np.maximum(begin[far], s.starts[k - w])
            for sign, p, q in ((1, a, z), (-1, a, x), (-1, x, z)):
                np.add.at(longer, (k - w, buckets(between(data, p, q - p), q - p, size)), sign)
        out.append(longer)
    return out


def joined_counts(counts: np.ndarray) -> pa.Array:
    """Each row's counts, written as doubles, between spaces."""
    top = int(counts.max(initial=0))
    values, at = (np.arange(top + 1), counts) if top < 1 << 16 else np.unique(counts, return_inverse=True)
    names, at = pa.array([f"{x}.0" for x in values.tolist()], pa.string()), at.reshape(counts.shape)
    return pc.binary_join_element_wise(*[names.take(pa.array(at[:, i])) for i in range(counts.shape[1])], " ")


def hashed_windows(chapters: DataFrame, text: str, size: int, most: int) -> DataFrame:
    """chapter_idx, seg_idx, window_size, vector: `hashed_words` of all windows of up to `most` segments, as text. Words are lower-cased letter by letter.

    chapters: chapter_idx and a text. The stand-in encoder counts words, so each segment is read once, not once for each window in which it lies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, s in byte_segments.grouped(pc.utf8_lower(b.column(1))):
                for w, counts in enumerate(window_counts(s, size, most), 1):
                    if len(counts):
                        yield pa.RecordBatch.from_arrays([b.column(0)[first:last].take(pa.array(s.text)), pa.array(s.number), pa.array(np.full(len(counts), w, np.int32)), joined_counts(counts)], ["chapter_idx", "seg_idx", "window_size", "vector"])

    return chapters.where(chapters[text].isNotNull()).select("chapter_idx", text).mapInArrow(run, "chapter_idx bigint, seg_idx bigint, window_size int, vector string")


def library_tokenizer(path: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Makes a worker's function from texts to their numbers of tokens, by the tokenizer in a file."""

    def make() -> Callable[[list[str]], list[int]]:
        from tokenizers import Tokenizer

        one = Tokenizer.from_file(path)
        one.encode_special_tokens = True
        return lambda texts: [len(one.encode(t, add_special_tokens=False).ids) for t in texts]

    return make


def token_counts(df: DataFrame, names: dict[str, str], make: Callable[[], Callable[[list[str]], list[int]]]) -> DataFrame:
    """df with the number of tokens of some text columns (by their new names); null texts count as empty. make runs once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = make()
        for f in frames:
            for text, name in names.items():
                f[name] = count([t or "" for t in f[text]])
            yield f

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *(T.StructField(name, T.LongType()) for name in names.values())]))


def generated(df: DataFrame, text: str, generate: Callable[[list[str]], list[str]], batch: int = 16, prefix: str = "") -> DataFrame:
    """df with generated; null texts count as empty."""
    return _batched(df, text, "generated", T.StringType(), lambda texts: generate([prefix + t for t in texts]), batch)

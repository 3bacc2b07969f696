"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs between blanks and ASCII punctuation, with A-Z lower-cased. Features are one-word, two-word
and one-word-skipped pairs, hashed to 2**bits coordinates, each counted once a text. Each coordinate has its
own learning rate, and L1 leaves most weights at exactly zero, so the model is a short list of weights
(at most 2**bits) that goes to the workers by broadcast.

Training takes a sample of at most `max_rows` labelled rows, those whose id hashes lowest, at most `epochs`
times; all else covers every row. Defined cases: null and empty texts get the bias alone; a document labelled
more than once takes the highest label, null labels count as none; of rows that share a key one is learned from (that
with the least features); without any label every score is 0;
repeated rows each give a row; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrays import LOWER, PUNCTUATION, U64, buffers, mix, rows_of, slices, span_hashes, words
from spanloom.llm.runtime import annotated, fresh, small_batches


def text_features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinates of all features of a slice of texts, repeats included."""
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets, PUNCTUATION)
    h, row = span_hashes(raw, starts, ends), rows_of(first)
    out_row, out_at = [row], [mix(h ^ U64(1))]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            out_row.append(row[gap:][same])
            out_at.append(mix(h[:-gap][same] * U64(salt) + h[gap:][same]))
    return np.concatenate(out_row), (np.concatenate(out_at) >> U64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class ToxicityModel:
    """Non-zero weights by coordinate; `trained` is false if there was no labelled row."""

    bits: int
    at: np.ndarray
    weight: np.ndarray
    bias: float
    trained: bool

    def scores(self, column: pa.Array) -> np.ndarray:
        raw, offsets = buffers(column)
        n = len(offsets) - 1
        if not self.trained:
            return np.zeros(n)
        dense = np.zeros(1 << self.bits)
        dense[self.at] = self.weight
        total = np.full(n, self.bias)
        for i, j, part, part_offsets in slices(raw, offsets):
            row, at = text_features(part, part_offsets, self.bits)
            used = dense[at] != 0
            once = np.unique((row[used] << self.bits) | at[used])
            total[i:j] += np.bincount(once >> self.bits, dense[once & ((1 << self.bits) - 1)], j - i)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def ftrl(examples: list[tuple[np.ndarray, int]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> ToxicityModel:
    """Follow the regularised leader over the examples (coordinates, label), in the order given."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for at, label in examples:
            at = np.append(at, size - 1)
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= l1, 0.0, (np.sign(za) * l1 - za) / ((beta + np.sqrt(na)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w[:-1])
    return ToxicityModel(bits, at, w[at], float(w[-1]), bool(examples))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic",
        max_rows: int = 6000, bits: int = 20, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0, epochs: int = 8) -> ToxicityModel:
    """Learn from at most max_rows labelled rows, of those that `usable` (over the key column) allows."""
    marked = labels.select(labels[key].alias("k"), labels[label].alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    if usable is not None:
        marked = marked.withColumnRenamed("k", key).where(usable).withColumnRenamed(key, "k")
    sample = marked.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = buffers(b.column(2))
            for i, j, part, part_offsets in slices(raw, offsets):
                row, at = text_features(part, part_offsets, bits)
                once = np.unique((row << bits) | at)
                ends = np.searchsorted(once, np.arange(1, j - i + 1) << bits)
                cut = np.split((once & ((1 << bits) - 1)).astype("<i4"), ends[:-1])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in (0, 1)), pa.array([c.tobytes() for c in cut], pa.binary())], ["order", "y", "at"])

    texts = docs.select(docs[key].alias("k"), docs[text].alias("t")).join(F.broadcast(sample), "k")  # at most max_rows rows are broadcast
    # of the rows that share a key one is learned from, so that max_rows is the only bound
    rows = texts.select(F.xxhash64("k").alias("order"), F.col("y").cast("int"), "t").mapInArrow(run, "order bigint, y int, at binary").groupBy("order", "y").agg(F.min("at").alias("at")).toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("order", "y", "at")])
    # views of the one table: the driver holds the features once, at 4 bytes each
    return ftrl([(np.frombuffer(at.as_buffer(), "<i4"), int(y > 0)) for at, y in zip(rows["at"], rows["y"].to_pylist(), strict=True)], bits, alpha, beta, l1, l2, epochs)


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (double, 0 to 1) per row: one narrow pass."""
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)))], ["id", "score"])

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", key)


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The documents, all columns kept, whose score is under the threshold: one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score_ = fresh(docs, "score")
    scored = annotated(docs, text, [(score_, "double")], lambda: lambda column: [pa.array(shared.value.scores(column))])
    return scored.where(F.col(score_) < threshold).drop(score_)

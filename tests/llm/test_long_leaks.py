"""Decontamination finds items at the largest distance, whatever their length and the kind of edits."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanloom.llm import decontamination
from spanloom.llm.arrays import buffers


def planted(n, kind, rng):
    item = [f"w{rng.randrange(5000)}" for _ in range(n)]
    text = list(item)
    for k in range(n // 5):
        p, way = rng.randrange(len(text)), kind if kind != "mixed" else ("delete", "insert", "replace")[k % 3]
        text[p : p + 1] = {"delete": [], "insert": [text[p], f"x{k}"], "replace": [f"x{k}"]}[way]
    noise = lambda m: [f"z{rng.randrange(5000)}" for _ in range(m)]
    return " ".join(item), " ".join(noise(450) + text + noise(60))


@pytest.mark.parametrize("kind", ["delete", "insert", "replace", "mixed"])
@pytest.mark.parametrize("n", [5, 20, 50, 59, 100, 150])
def test_every_planted_item_is_found(n, kind):
    rng = random.Random(f"{n}{kind}")
    items, texts = zip(*(planted(n, kind, rng) for _ in range(25)), strict=True)
    held = decontamination.Items(list(range(25)), list(items))
    row, item, edits, _, _ = held.matches(*decontamination.word_hashes(*buffers(pa.array(texts))))
    own = row == item
    assert row[own].tolist() == list(range(25))
    assert (edits[own] <= n // 5).all()


def test_repeats_follow_from_length_and_recall():
    at = {c: decontamination.repeats_of(c, 0.999) for c in range(8)}
    assert at[0] == at[1] == at[2] == 1  # no edits are allowed: windows are equal or no match
    assert at[3] < at[5] < at[7] and decontamination.repeats_of(6, 0.9) < at[6]
    assert decontamination.repeats_of(7, 1 - 1e-12) == 0  # out of reach: all that pass the count filter are verified


@pytest.mark.parametrize("n", [30, 59, 100])
def test_windows_at_the_right_start_reach_the_target(n):
    """The sampled steps alone, on pairs that the repeats were not derived from."""
    rng = np.random.default_rng(1000 + n)
    texts = [decontamination.edited(n, kind, rng) for kind in range(4) for _ in range(250)]
    c = int(decontamination.classes(np.array([n]))[0])
    h = lambda k, row: decontamination.mix(np.array(row, np.uint64) + np.uint64(k << 32)) | np.uint64(1)
    words = np.concatenate([h(k, range(1, n + 1)) for k in range(1000)] + [h(k, t) for k, t in enumerate(texts)])
    starts, sizes, met = np.arange(2000) * n, np.full(2000, n), np.zeros(1000, bool)
    for r in range(decontamination.repeats_of(c, 0.999)):
        read = decontamination.walk(words, starts, sizes, *decontamination.sampled(c, r, min(1 << c, decontamination.MOST_STEPS)))
        met |= (read[:1000] == read[1000:]) & (read[:1000] != decontamination.END)
    assert met.mean() >= 0.995


def test_sampling_loses_no_rows_of_the_table():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/benchmark.parquet")["text"].to_pylist() if t is not None]
    words = decontamination.word_hashes(*buffers(docs))
    ids = list(range(len(texts)))
    sampled, all_ = decontamination.Items(ids, texts), decontamination.Items(ids, texts, repeats=dict.fromkeys(range(30), 0))
    assert all((a == b).all() for a, b in zip(sampled.matches(*words), all_.matches(*words), strict=True))


def test_pairs_that_no_walk_meets_are_found():
    """One repeat meets few pairs of 100 words at 20 deletions; the exact check finds the others."""
    rng = random.Random(21)
    items, texts = zip(*(planted(100, "delete", rng) for _ in range(40)), strict=True)
    words = decontamination.word_hashes(*buffers(pa.array(texts)))
    few, all_ = (decontamination.Items(list(range(40)), list(items), repeats=dict.fromkeys(range(10), r)) for r in (1, 0))
    assert not few.candidates(*words, *few.stretches(*words)).all()
    assert [x.tolist() for x in few.matches(*words)] == [x.tolist() for x in all_.matches(*words)]
    assert set(range(40)) == set(few.matches(*words)[0].tolist()) == set(few.matches(*words, once=True)[0].tolist())

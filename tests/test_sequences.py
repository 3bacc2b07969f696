"""Chunks, monotone alignment, common spans and chapter splitting against traced cases and loops."""

import random

import numpy as np
import pytest

from spanloom.operators import chunks, common_spans, monotone
from spanloom.operators.chapter_split import number_of, split_book


def loop_max(sizes, most):
    out = []
    for i, n in enumerate(sizes):
        if n > most:
            out += [[i, i, min(most, n - k)] for k in range(0, n, most)]
        elif out and out[-1][2] + n <= most:
            out[-1] = [out[-1][0], i, out[-1][2] + n]
        else:
            out.append([i, i, n])
    return out


def loop_min(sizes, least):
    out = []
    for i, n in enumerate(sizes):
        if out and (out[-1][2] < least or (i == len(sizes) - 1 and n < least)):
            out[-1] = [out[-1][0], i, out[-1][2] + n]
        else:
            out.append([i, i, n])
    while len(out) > 1 and out[-1][2] < least:
        last = out.pop()
        out[-1] = [out[-1][0], last[1], out[-1][2] + last[2]]
    return out


def test_traced_chunks():
    assert [c[2] for c in loop_max([7, 1, 1, 4], 3)] == [3, 3, 3, 3, 1]
    assert [c[2] for c in loop_min([1, 1, 4, 2], 3)] == [8]
    assert [c[2] for c in loop_min([3, 2, 1], 3)] == [3, 3]
    assert [c[2] for c in loop_min([3, 1, 1], 3)] == [5]


def test_folds_equal_loops(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    cases = [[rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))] for _ in range(60)] + [[7, 1, 1, 4], [1, 1, 4, 2], [3, 2], [3, 2, 1], [3, 1, 1]]
    rows = [(i, [(k, sum(c[:k]), n) for k, n in enumerate(c)]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, pars array<struct<par_idx:bigint,first_seg:bigint,n:bigint>>")
    got = df.select("i", chunks.max_chunks(F.col("pars"), 3).alias("a"), chunks.min_chunks(F.col("pars"), 3).alias("b")).collect()
    for r in got:
        assert [[c.first_par, c.last_par, c.n] for c in r.a] == loop_max(cases[r.i], 3)
        assert [[c.first_par, c.last_par, c.n] for c in r.b] == loop_min(cases[r.i], 3)


def test_chunks_need_a_size(spark):
    with pytest.raises(ValueError):
        chunks.chunks(None, None)


def test_traced_alignment():
    sims = {(("a",), ("t",)): 0.5, (("b",), ("t",)): 0.2, (("a", "b"), ("t",)): 0.8}
    rows = monotone.align(["a", "b"], ["t"], lambda s, t: sims[tuple(s), tuple(t)], size_penalty=0.1)
    assert [(s, t) for s, t, _, _ in rows] == [([0, 1], [0])] and rows[0][2] == pytest.approx(0.7)


def test_alignment_covers_both_sides():
    rng = random.Random(3)
    for _ in range(60):
        source = [[[rng.choice("abcde") for _ in range(3)]] for _ in range(rng.randrange(1, 8))]
        target = [[[rng.choice("abcde") for _ in range(3)]] for _ in range(rng.randrange(1, 30))]
        score = lambda a, b: monotone.union_recall([s for x in a for s in x], [s for x in b for s in x])
        rows = monotone.align(source, target, score)
        assert [i for s, _, _, _ in rows for i in s] == list(range(len(source)))
        assert sorted(i for _, t, _, _ in rows for i in t) == list(range(len(target)))


def test_union_recall_pays_each_source_token_once():
    assert monotone.union_recall([["a", "b"]], [["a", "b"], ["a"]]) == pytest.approx(2 / 3)
    assert monotone.common_marks(list("abcb"), list("bb")) == [3, 1]


def test_common_spans():
    found = common_spans.common_spans(["The cat sat. ", "The dog ran."], ["The dog sat. "])
    assert [("The cat sat. The dog ran."[a:b], "The dog sat. "[c:d]) for (a, b), (c, d) in found] == [("The dog", "The dog"), ("sat.", "sat.")]
    assert common_spans.within_one(["ab", "cd"], 0, 2) and not common_spans.within_one(["ab", "cd"], 1, 3)
    assert common_spans.common_spans([""], [""]) == []


def test_chapters():
    lines = ["Book I", "CHAPTER I", "CHAPTER II", "Book I", "Chapter XIV. A Title", "one", "Chapter twenty-one", "The Long Way", "two", "", "PREFACE", "three", "*** END", "never"]
    got = [(c.book, c.number, c.title, [x for x in c.lines if x]) for c in split_book(lines)]
    assert got == [(1, 14, "A Title", ["one"]), (1, 21, "The Long Way", ["two"]), (1, 0, "PREFACE", ["three"])]
    assert (number_of("one hundred and five"), number_of("12"), number_of("what")) == (105, 12, None)
    with pytest.raises(ValueError):
        split_book(["Chapter I", "text"])


def test_inferred_spans_do_not_depend_on_the_order_of_ends():
    from spanloom.operators import abridgements

    ends = [5, 8, 13, 16, 21, 32, 40, 64, 72, 96, 104, 128]
    claims = [[(0, 6)], None, [(9, 15)], [(30, 66)], [(66, 120)]]
    first = abridgements.abridged_spans(claims, set(sorted(ends)), 130)
    rng = random.Random(1)
    for _ in range(20):
        rng.shuffle(ends)
        assert abridgements.abridged_spans(claims, set(sorted(ends)), 130) == first


def test_cosine_windows_are_sums_of_words(monkeypatch):
    """Each distinct word of a chapter is encoded once; windows have the vectors of their joined words."""
    from spanloom.operators import models
    from spanloom.plans import sequential

    asked, plain = [], models.hashed_words(64)
    monkeypatch.setattr(sequential.models, "hashed_words", lambda size: lambda texts: asked.extend(texts) or plain(texts))
    monkeypatch.setattr(sequential, "aligned", lambda fx, scores: scores)
    source, target = [["a", "b"], ["c"], [], ["a", "d", "a"], ["e"]], [["a"], ["d", "c"]]
    rows = sequential.dp5(None)(source, target)
    assert sorted(w for t in asked for w in t.split()) == list("abcde")
    joined = lambda side, w, k: plain([" ".join(x for s in side[max(0, k - w + 1) : k + 1] for x in s)])[0].astype(float)
    for t in range(2):
        got = rows(t, 0, 5)
        for v in range(1, t + 2):
            for s in range(5):
                for w in range(1, s + 2 if s < 4 else 5):
                    a, b = joined(source, w, s), joined(target, v, t)
                    assert got[v - 1, w - 1, s] == pytest.approx(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-30))

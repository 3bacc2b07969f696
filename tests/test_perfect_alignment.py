"""Alignments that are known without scoring all windows, against cell by cell and against all windows."""

import random

import pytest

from spanloom.operators import monotone, perfect_alignment
from spanloom.plans import measures
from spanloom.plans.fixtures import Fixtures

rng = random.Random(15)


def shortened(n, words, share, empty, cut=0.0):
    """A text, and what is left of it: some segments without tokens, some that lost tokens."""
    source = [[] if rng.random() < empty else [rng.choice(words) for _ in range(rng.randrange(1, 6))] for _ in range(n)]
    return source, [[w for w in x if rng.random() >= cut] for x in source if rng.random() < share]


@pytest.mark.parametrize("words", ["ab", "abcdefgh", [f"w{i}" for i in range(300)]])
@pytest.mark.parametrize("empty", [0.0, 0.2, 0.6])
def test_known_rows_equal_cell_by_cell(words, empty):
    known = 0
    for k in range(60):
        source, target = shortened(rng.randrange(1, 26), words, 0.6, empty, 0.2 * (k % 2))
        if k % 5 == 0:
            rng.shuffle(target)
        got = perfect_alignment.perfect_rows(source, target)
        if got is not None:
            known += 1
            assert got == monotone.align_rows(len(source), len(target), monotone.UnionRows(source, target))
            wanted = monotone.align(source, target, monotone.union_recall)
            assert [r[:2] for r in got] == [r[:2] for r in wanted] and [x for r in got for x in r[2:]] == pytest.approx([x for r in wanted for x in r[2:]])
    assert known or empty == 0.6


@pytest.mark.parametrize("how", [{"size_penalty": 0.2}, {"size_penalty": 0.0}, {"size_penalty": 2.0}, {"lead": 1}, {"trail": 0.5}])
def test_known_rows_with_other_penalties_and_bands(how):
    for k in range(40):
        source, target = shortened(rng.randrange(40, 70), "abcdefghij", 0.5, 0.2, 0.02 * (k % 2))
        got = perfect_alignment.perfect_rows(source, target, **how)
        assert got is None or got == monotone.align_rows(len(source), len(target), monotone.UnionRows(source, target), **how)


def test_what_is_not_known_is_scored():
    """A lost pair of tokens in the wrong order, and targets without tokens that may end anywhere."""
    assert perfect_alignment.perfect_rows([["a", "b"]], [["b", "a"]]) is None
    assert perfect_alignment.perfect_rows([["a"], ["b"]], [[], []]) is None
    assert perfect_alignment.perfect_rows([["a", "b"], ["c"]], [["b"], []]) == monotone.align_rows(2, 2, monotone.UnionRows([["a", "b"], ["c"]], [["b"], []]))


def test_a_shortened_text_is_not_scored_cell_by_cell(spark, monkeypatch):
    """Long and full of common words, it is known at once; the query asks for it, and gives the rows of all windows."""
    source, target = shortened(1200, [f"w{int(rng.paretovariate(0.6))}" for _ in range(2000)], 0.6, 0.1)
    assert perfect_alignment.perfect_rows(source, target) is not None
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(measures.sim2(fx)) == rows(measures.aligned(fx, monotone.UnionRows))
    asked = []
    monkeypatch.setattr(measures, "aligned", lambda fx, scores, **how: asked.append(how["known"]))
    measures.sim2(fx)
    assert asked == [perfect_alignment.perfect_rows]


def test_texts_are_cut_once(spark):
    """Chapters without segments are left out before they are dealt out, without cutting them for it."""
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    plan = fx.nested._jdf.queryExecution().executedPlan().toString()
    assert "split" not in plan[plan.index("Exchange") :]
    fx.chapters = spark.createDataFrame([("s", i, t) for i, t in enumerate(["", None, "\n", ".", " ", "a. b"])], "book_id string, chapter_idx bigint, original string")
    del fx.nested, fx.dealt
    assert sorted((r.chapter_idx, r.segments) for r in fx.nested.collect()) == [(2, ["\n"]), (3, ["."]), (4, [" "]), (5, ["a. ", "b"])]

"""Hand-traced cases of span inference, and the tiling that every result must have."""

from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators.abridgements import Claims, abridged_spans, claimed, infer, least, set_order


def test_no_conflict():
    assert abridged_spans([[(0, 4)], [(12, 18)]], {10, 20}, 20) == [(0, 10), (10, 20)]


def test_a_long_older_run_keeps_its_place():
    assert abridged_spans([[(0, 3), (8, 12)], [(4, 6)]], {13, 20}, 20) == [(0, 12), (12, 20)]


def test_a_newer_claim_wins_and_releases():
    assert abridged_spans([[(0, 3), (6, 7)], [(4, 6), (8, 10)]], {3, 10}, 10) == [(0, 3), (3, 10)]


def test_a_passage_without_overlap():
    assert abridged_spans([[(0, 5)], None, [(7, 9)]], {5, 9}, 9) == [(0, 5), (5, 5), (5, 9)]


def test_boundary_choice():
    assert set_order([103, 144]) == list({103, 144}.intersection(range(100, 151)))[0]
    assert least([103, 144]) == 103
    assert least([]) is set_order([]) is None


spans = st.lists(st.tuples(st.integers(0, 58), st.integers(1, 12)).map(lambda s: (s[0], min(s[0] + s[1], 60))), max_size=3)


@settings(max_examples=200, deadline=None)
@given(st.lists(spans, min_size=1, max_size=6), st.sets(st.integers(1, 60)))
def test_spans_tile_the_text(claims, ends):
    got = abridged_spans([sorted(c) or None for c in claims], ends, 60, least)
    assert got[0][0] == 0 and got[-1][1] == 60 and len(got) == len(claims)
    assert all(a[1] == b[0] for a, b in zip(got[:-1], got[1:], strict=True))


def inferred_rows(spark, n):
    """Three chapters of n passages; overlaps out of order, none in the second chapter, sentence ends null in the third."""
    passages = spark.createDataFrame([(c, i, 10 * i, 10 * i + 10) for c in range(3) for i in reversed(range(n))], "chapter_idx long, idx long, start_char long, end_char long")
    own = {c: [(i + 1 if i % 4 == 0 and i + 1 < n else i - 1 if i % 4 == 1 else i, 10 * i + 1, 10 * i + 9, 5 * i, 5 * i + 5) for i in range(n)] for c in (0, 2)}
    overlaps = spark.createDataFrame([(c, *x) for c, spans in own.items() for x in spans], "chapter_idx long, pos long, o_start long, o_end long, a_start long, a_end long")
    chapters = spark.createDataFrame([(c, 5 * n, None if c == 2 else list(range(5, 5 * n + 1, 5))) for c in range(3)], "chapter_idx long, a_length long, a_ends array<long>")
    return passages, overlaps, chapters


def test_a_chapter_is_listed_once_and_no_group_is_a_call(spark):
    passages, overlaps, chapters = inferred_rows(spark, 9)
    found = infer(passages, overlaps, chapters, least)
    rows = {(r.chapter_idx, r.idx): (r.abridged_start, r.abridged_end) for r in found.collect()}
    assert len(rows) == 27
    for c in range(3):
        claims = [[] if c == 1 else [(5 * i, 5 * i + 5)] for i in range(9)]
        assert [rows[c, i] for i in range(9)] == abridged_spans(claims, () if c == 2 else range(5, 46, 5), 45, least)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    assert infer(passages.limit(0), overlaps, chapters, least).count() == 0


def test_claimed_characters(spark):
    rows = [(1, 7, 0, 0, 4), (1, 7, 1, 6, 8), (1, 9, 2, 4, 6), (2, 3, 0, 0, 5)]
    found = claimed(spark.createDataFrame(rows[::-1], "chapter_idx long, idx long, pos long, a_start long, a_end long"))
    held = Claims()
    held.claim(0, [(0, 4), (6, 8)])
    held.claim(1, [(4, 6)])
    assert {(r.chapter_idx, r.place): r.n_chars for r in found.collect()} == {(1, k): v for k, v in held.sizes().items()} | {(2, 0): 5}
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()

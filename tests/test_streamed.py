"""Row-streamed alignment, the suffix automaton, the interval map, ROUGE and the containment sweep against plain versions."""

import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import abridgements, common_spans, containment, monotone, rouge

rng = random.Random(11)


def texts(n, words="abcde", most=6):
    return [[rng.choice(words) for _ in range(rng.randrange(0, most))] for _ in range(n)]


def same_rows(got, wanted):
    assert [(s, t) for s, t, _, _ in got] == [(s, t) for s, t, _, _ in wanted]
    assert [x for r in got for x in r[2:]] == pytest.approx([x for r in wanted for x in r[2:]])


@pytest.mark.parametrize("n, m", [(1, 1), (7, 3), (3, 9), (60, 9), (64, 40), (30, 45)])
@pytest.mark.parametrize("block", [2, 3, 64])
def test_rows_equal_cell_by_cell(n, m, block):
    """With the band in action, ties and empty segments, and the way back cut in parts."""
    source, target = texts(n), texts(m)
    for score, rows in ((monotone.gram_recall(1), monotone.GramRows), (monotone.union_recall, monotone.UnionRows)):
        same_rows(monotone.align_rows(n, m, rows(source, target), block=block), monotone.align(source, target, score))


@pytest.mark.parametrize("size", [2, 3, 4])
def test_ngrams_that_cross_segments(size):
    for _ in range(12):
        source, target = texts(rng.randrange(1, 20), "abc", 4), texts(rng.randrange(1, 14), "abc", 4)
        rows = monotone.GramRows(source, target, size)
        for t in range(len(target)):
            found = rows(t, 0, len(source))
            for v in range(1, min(4, t + 1) + 1):
                for s in range(len(source)):
                    for w in range(1, min(4, s + 1) + 1):
                        wanted = monotone.gram_recall(size)(source[s - w + 1 : s + 1], target[t - v + 1 : t + 1])
                        assert found[v - 1, w - 1, s] == pytest.approx(wanted)
        same_rows(monotone.align_rows(len(source), len(target), monotone.GramRows(source, target, size), block=4), monotone.align(source, target, monotone.gram_recall(size)))


@pytest.mark.parametrize("how", [{"skip_penalty": 0.1}, {"least": 0.4}, {"size_penalty": 0.2, "skip_penalty": 0.05}, {"lead": 2}, {"trail": 0.5}])
def test_penalties_and_bands(how):
    for n, m in ((9, 6), (55, 30), (20, 31)):
        source, target = texts(n), texts(m)
        same_rows(monotone.align_rows(n, m, monotone.GramRows(source, target), block=5, **how), monotone.align(source, target, monotone.gram_recall(1), **how))


def test_windows_within_paragraphs():
    """One-to-one paragraphs: on both sides, on one, and with a penalty for what is left out."""
    for k in range(20):
        n, m = rng.randrange(1, 30), rng.randrange(1, 25)
        source, target = texts(n, "abc", 5), texts(m, "abc", 5)
        pars = [sorted(rng.randrange(6) for _ in range(x)) for x in (n, m)]
        how = {"source_paragraphs": pars[0], "target_paragraphs": pars[1] if k % 3 else None, "skip_penalty": 0.1 * (k % 2)}
        got = monotone.align_rows(n, m, monotone.GramRows(source, target), block=3, **how)
        same_rows(got, monotone.align(source, target, monotone.gram_recall(1), **how))
        assert all(len({pars[0][i] for i in s}) <= 1 for s, _, _, _ in got)


def test_cosines():
    r = np.random.default_rng(2)
    sides = [[r.normal(size=(n, 8)) for _ in range(4)] for n in (12, 9)]
    score = lambda a, b: float(np.dot(x := sides[0][len(a) - 1][a[-1]], y := sides[1][len(b) - 1][b[-1]]) / np.linalg.norm(x) / np.linalg.norm(y))
    same_rows(monotone.align_rows(12, 9, monotone.CosineRows(*sides)), monotone.align(list(range(12)), list(range(9)), score))


def test_a_long_chapter_in_linear_memory():
    """14,000 and 6,000 segments: tables of both would be some 10 GB."""
    words = [f"w{i}" for i in range(4000)]
    source = [[rng.choice(words)] for _ in range(14_000)]
    target = [s for i, s in enumerate(source) if i % 7 < 3]
    tracemalloc.start()
    rows = monotone.align_rows(len(source), len(target), monotone.GramRows(source, target), trail=0.4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for s, _, _, _ in rows for i in s] == list(range(14_000)) and sorted(i for _, t, _, _ in rows for i in t) == list(range(6_000))
    assert sum(len(s) == 1 and len(t) == 1 and own == 1.0 for s, t, _, own in rows) > 5_800
    assert peak < 300 << 20


def test_mark_bits():
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        places = {x: sum(1 << i for i, y in enumerate(b) if y == x) for x in set(b)}
        bits = monotone.mark_bits(a, places, len(b))
        assert [i for i in range(len(a)) if bits >> i & 1] == sorted(monotone.common_marks(a, b))


def test_each_target_is_gone_through_once():
    """Chapters whose choices fit are not gone through again on the way back, and a block of targets is scored at a time."""
    source = texts(400, "abcdefghij", 9)
    target = [x for i, x in enumerate(source) if i % 5 < 3]
    for kind in (monotone.GramRows, monotone.UnionRows):
        rows, asked, made = kind(source, target), [], []
        block = rows.block
        rows.block = lambda *x, block=block, made=made: made.append(x) or block(*x)
        monotone.align_rows(len(source), len(target), lambda *x, rows=rows, asked=asked: asked.append(x[0]) or rows(*x))
        assert asked == list(range(len(target)))
        assert len(made) == -(-len(target) // rows.size)


def test_marks_of_many_pairs():
    """Sides of up to 64 tokens at once, those beyond one by one; of both the union recall is that of the plain version."""
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(1, n))], [rng.choice("abcd") for _ in range(rng.randrange(1, n))]) for n in (4, 9, 30, 65) for _ in range(60)]
    pairs.sort(key=lambda p: -len(p[0]))
    targets = np.full((len(pairs), 64), 4)
    for k, (a, _) in enumerate(pairs):
        targets[k, : len(a)] = ["abcd".index(x) for x in a]
    places = np.array([[sum(1 << i for i, y in enumerate(b) if y == x) for _, b in pairs] for x in "abcd"] + [[0] * len(pairs)], np.uint64)
    got = monotone.many_marks(targets, np.array([len(a) for a, _ in pairs]), places, np.array([len(b) for _, b in pairs]))
    for bits, (a, b) in zip(got.tolist(), pairs, strict=True):
        assert [i for i in range(len(a)) if bits >> i & 1] == sorted(monotone.common_marks(a, b))
    long = [[rng.choice("abcdefgh") for _ in range(rng.choice([2, 5, 70, 140]))] for _ in range(9)]
    short = [x[: len(x) // 2] + x[len(x) // 2 + 1 :] for x in long[::2]]
    same_rows(monotone.align_rows(9, 5, monotone.UnionRows(long, short)), monotone.align(long, short, monotone.union_recall))


def plain_spans(original, abridged):
    """All runs, longest first, by comparing tokens from every pair of places."""
    long, short = (common_spans.placed_tokens("".join(side)) for side in (original, abridged))
    used, out = (set(), set()), []
    for n in range(min(len(long), len(short)), 0, -1):
        for i in range(len(short) - n + 1):
            start, end = short[i][1], short[i + n - 1][2]
            if used[0] & set(range(i, i + n)) or not common_spans.within_one(abridged, start, end):
                continue
            for j in range(len(long) - n + 1):
                if not used[1] & set(range(j, j + n)) and [t[0] for t in long[j : j + n]] == [t[0] for t in short[i : i + n]]:
                    out.append(((long[j][1], long[j + n - 1][2]), (start, end)))
                    used[0].update(range(i, i + n))
                    used[1].update(range(j, j + n))
                    break
    return sorted(out, key=lambda x: x[1][0])


@pytest.mark.parametrize("many", [0, 48])
def test_spans_equal_the_plain_search(monkeypatch, many):
    monkeypatch.setattr(common_spans, "MANY", many)
    for _ in range(400):
        say = lambda n, words: ["".join(rng.choice(words) + rng.choice([" ", " ", "", ". "]) for _ in range(rng.randrange(0, 7))) for _ in range(n)]
        words = rng.choice([["a", "b"], ["a"], ["The", "the", "cat", "sat", "x,"]])
        original, abridged = say(rng.randrange(1, 4), words), say(rng.randrange(1, 4), words)
        assert common_spans.common_spans(original, abridged) == plain_spans(original, abridged)


def test_places_of_whole_sequences():
    for _ in range(200):
        tokens = [rng.choice("ab") for _ in range(rng.randrange(1, 25))]
        places, used = common_spans.Places(tokens), set()
        for _ in range(6):
            wanted = [rng.choice("abc") for _ in range(rng.randrange(1, 4))]
            plain = next((j for j in range(len(tokens) - len(wanted) + 1) if tokens[j : j + len(wanted)] == wanted and not used & set(range(j, j + len(wanted)))), None)
            assert places.find(wanted) == plain
            if plain is not None:
                places.use(plain, len(wanted))
                used.update(range(plain, plain + len(wanted)))


def test_a_long_row():
    """10,000 and 6,000 tokens without a table of both; equal tokens all over are the worst case."""
    words = [f"w{i}" for i in range(900)]
    long = [rng.choice(words) for _ in range(10_000)]
    short = [w for k in range(0, 10_000, 25) for w in long[k : k + 15]]
    tracemalloc.start()
    found = common_spans.common_spans([" ".join(long)], [" ".join(short)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    assert sum(b - a for _, (a, b) in found) > 0.95 * len(" ".join(short))
    same = common_spans.common_spans(["a " * 3000], ["a " * 1000, "a " * 900])
    assert [s for _, s in same] == [(0, 1999), (2000, 3799)]


def array_claim(owner, number, spans):
    """The claim on an array of all characters."""
    wanted = np.zeros(len(owner), bool)
    for a, b in spans:
        wanted[a:b] = True
    taken = owner >= 0
    last = np.flatnonzero(taken)[-1] if taken.any() else -1
    zone = np.arange(spans[0][0], last + 1)
    zone = zone[(wanted | taken)[zone]]
    old = ~wanted[zone]
    if len(zone):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], old, [False]]).astype(np.int8)))
        size, end = max([(b - a, b) for a, b in zip(edge[::2], edge[1::2], strict=True)], default=(0, len(zone)))
        keep = zone[0] if size <= end - size else zone[end] if end < len(zone) else None
        inside = zone >= keep if keep is not None else np.zeros(len(zone), bool)
        owner[zone[inside & ~old]] = number
        owner[zone[inside & old]] = -1
        wanted[zone] = False
    owner[wanted] = number


some_spans = st.lists(st.tuples(st.integers(0, 58), st.integers(0, 12)).map(lambda s: (s[0], min(s[0] + s[1], 60))), min_size=1, max_size=4)


@settings(max_examples=600, deadline=None)
@given(st.lists(some_spans, min_size=1, max_size=8))
def test_intervals_equal_the_array(claims):
    """In any order, overlapping, empty, behind and before what is held."""
    owner, held = np.full(60, -1), abridgements.Claims()
    for k, spans in enumerate(claims):
        array_claim(owner, k, spans)
        held.claim(k, spans)
        assert held.sizes() == {int(x): int((owner == x).sum()) for x in np.unique(owner) if x >= 0}
        mine = [np.flatnonzero(owner == i) for i in range(k + 1)]
        for span, chars in zip(held.spans(k + 1), mine, strict=True):
            assert not len(chars) or span == (chars[0], chars[-1] + 1)
        assert all(a < b for a, b in zip(held.starts, held.ends, strict=True)) and all(b <= c for b, c in zip(held.ends, held.starts[1:], strict=False))


def test_claims_cost_their_intervals():
    """100,000 passages over 5 million characters: an array for each would be 500 billion steps."""
    held = abridgements.Claims()
    for k in range(100_000):
        held.claim(k, [(50 * k, 50 * k + 40)])
    assert len(held.starts) == 100_000 and held.spans(100_000)[-1] == (4_999_950, 4_999_990)


def test_spans_within_passages():
    for _ in range(100):
        starts = np.array([rng.randrange(30) for _ in range(12)])
        ends = starts + np.array([rng.randrange(6) for _ in range(12)])
        passages = [(a, a + rng.randrange(12)) for a in range(0, 30, 4)]
        assert abridgements.within(starts, ends, passages) == [[k for k in range(12) if starts[k] >= a and ends[k] <= b] for a, b in passages]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=150), st.lists(st.sampled_from("abcd"), max_size=150))
def test_lcs_length(a, b):
    assert rouge.lcs_length(a, b) == lcs(a, b)


def test_lcs_of_whole_chapters():
    a = [rng.choice("abcdefgh") for _ in range(20_000)]
    assert rouge.lcs_length(a, [x for i, x in enumerate(a) if i % 3]) == sum(1 for i in range(20_000) if i % 3)


def test_rouge(spark):
    rows = [(1, "the cat sat on the mat", "the cat on the red mat"), (2, " Equal! ", "Equal!\n"), (3, "", "words"), (4, "one", "one two"), (5, "!", "?"), (6, None, "x")]
    pairs = spark.createDataFrame(rows, "id bigint, predicted string, reference string")
    ones = {(r.id, r.n): (r.precision, r.recall) for r in rouge.rouge_n(pairs, "id", (1, 2, 3)).collect()}
    assert ones[1, 1] == pytest.approx((5 / 6, 5 / 6)) and ones[1, 2] == pytest.approx((2 / 5, 2 / 5)) and ones[1, 3] == (0, 0)
    assert ones[2, 1] == ones[2, 2] == (1, 1) and ones[3, 1] == ones[5, 1] == ones[6, 2] == (0, 0) and ones[4, 1] == (1, 0.5) and ones[4, 2] == (0, 0)
    longest = {r.id: (r.lcs, r.precision, r.f1) for r in rouge.rouge_l(pairs, "id").collect()}
    assert longest[1] == (5, pytest.approx(5 / 6), pytest.approx(5 / 6)) and longest[2] == (1, 1, 1) and longest[3] == longest[5] == longest[6] == (0, 0, 0)


def test_contained_spans(spark):
    """Tiling and gapped outer spans, spans over their edges, bins smaller than them; equal keys elsewhere."""
    outer, inner = [], []
    for c in range(4):
        cuts = sorted(rng.sample(range(1, 200), 9))
        outer += [(c, k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if c % 2 == 0 or k % 3]
        inner += [(c, k, a, a + rng.randrange(1, 25)) for k, a in enumerate(rng.choices(range(210), k=80))]
    frames = [spark.createDataFrame(rows, "chapter_idx bigint, k bigint, start_char bigint, end_char bigint") for rows in (inner, outer)]
    wanted = sorted((c, i, o) for c, i, a, b in inner for d, o, s, e in outer if c == d and s <= a and b <= e)
    for size in (7, 64, containment.BIN):
        found = containment.contained(*frames, bin_size=size)
        assert sorted((r.chapter_idx, r.inner.k, r.outer.k) for r in found.collect()) == wanted
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_least_behind(spark):
    points = [(c, rng.randrange(100), rng.randrange(1000)) for c in range(3) for _ in range(20)]
    places = [(c, p) for c in range(4) for p in range(0, 110, 9)]
    frames = spark.createDataFrame(points, "chapter_idx bigint, at bigint, v bigint"), spark.createDataFrame(places, "chapter_idx bigint, at bigint")
    for size in (10, containment.BIN):
        got = {(r.chapter_idx, r["at"]): r.least for r in containment.least_behind(*frames, "v", bin_size=size).collect()}
        assert got == {(c, p): min((v for d, a, v in points if d == c and a >= p), default=None) for c, p in places}


def test_aligned_frames(spark):
    """Empty sides, and paragraphs passed on."""
    rows = [(1, ["A b.", "C d."], ["a b."], [0, 1], [0]), (2, ["x"], [], [0], []), (3, [], ["y"], [], [0]), (4, [], [], [], [])]
    chapters = spark.createDataFrame(rows, "chapter_idx bigint, source array<string>, target array<string>, source_par array<bigint>, target_par array<bigint>")
    got = sorted((r.chapter_idx, r.row, r.source, r.target) for r in monotone.alignments(chapters, monotone.GramRows, paragraphs=True).collect())
    assert got == [(1, 0, [0], [0]), (1, 1, [1], []), (2, 0, [0], []), (3, 0, [], [0])]
    assert monotone.alignments(chapters.where(F.lit(False)), monotone.GramRows).count() == 0


def test_rouge_counts_in_the_row(spark):
    """Repeats count, and no gram is shuffled."""
    pairs = spark.createDataFrame([(1, "a a a b", "a a c b b"), (2, "x", None)], "id bigint, predicted string, reference string")
    found = rouge.rouge_n(pairs, "id", (1, 2))
    got = {(r.id, r.n): (r.precision, r.recall) for r in found.collect()}
    assert got == {(1, 1): (0.75, 0.6), (1, 2): (pytest.approx(1 / 3), 0.25), (2, 1): (0, 0), (2, 2): (0, 0)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()

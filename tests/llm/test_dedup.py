"""Substring, byte, line and fingerprint dedup against brute force."""

import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import byte_repeats, line_dedup, simhash, substrings
from spanloom.llm.suffix_groups import suffix_array

LAST = (1 << 63) - 1


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute_words(rows, width=13):
    first = {}
    for k, t in rows:
        w = split(t)
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, LAST + 1), LAST if k is None else k)
    out = []
    for k, t in rows:
        w, gone = split(t), set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (LAST if k is None else k):
                gone |= set(range(i, i + width))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def brute_bytes(rows, length):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone |= set(range(i, i + length))
        out.append((k, len(b), len(gone), sum(1 for i in gone if i - 1 not in gone), bytes(x for i, x in enumerate(b) if i not in gone)))
    return out


def brute_lines(rows):
    """Lines in the order of key, hash of the text (as a signed number), line number; rows equal in both count once."""
    named = {(LAST if k is None else k, (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (h >> 63 << 64)): t or "" for k, t in rows}
    lines = sorted((*name, j, frozenset(split(l))) for name, t in named.items() for j, l in enumerate(t.split("\n")))
    gone = set()
    for i, (k, h, j, s) in enumerate(lines):
        if s and any(o and 9 * len(s & o) >= 4 * (len(s) + len(o)) for *_, o in lines[:i]):
            gone.add((named[k, h], k, j))
    return [(k, len((t or "").split("\n")), [j for j in range(len((t or "").split("\n"))) if (t or "", LAST if k is None else k, j) in gone]) for k, t in rows]


def brute_components(rows, width=4, distance=4):
    def print_of(t):
        w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = [print_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((k for (k, _), h in zip(rows, group, strict=True) if h == g and k is not None), default=None) for g in set(group)}
    return [(k, p, least[g]) for (k, _), p, g in zip(rows, prints, group, strict=True)]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def in_order(rows):
    return sorted(map(repr, rows))


@pytest.fixture(scope="module", params=["docs", "awkward", "nothing", "random"])
def table(request, spark):
    if request.param != "random":
        return request.getfixturevalue(request.param)
    rng = random.Random(11)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(3, 40))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else rng.choice(pool)[: rng.randrange(5, 60)] for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_substrings(table):
    got = [tuple(r) for r in substrings.without_repeats(table).collect()]
    assert in_order(got) == in_order(brute_words(rows_of(table)))


def test_longest_repeats(table):
    rows, longest, width = rows_of(table), {}, 5
    while True:
        holders = {}
        for k, t in rows:
            w = split(t)
            for i in range(len(w) - width + 1):
                holders.setdefault(tuple(w[i : i + width]), set()).add(LAST if k is None else k)
        found = {k for h in holders.values() if len(h) > 1 for k in h}
        longest |= dict.fromkeys(found, width)
        if not found:
            break
        width *= 2
    assert {r.k: r.words for r in substrings.longest_repeats(table, 5).collect()} == longest


@pytest.mark.parametrize("part", [2000, 2])
def test_bytes(table, part, monkeypatch):
    monkeypatch.setattr(byte_repeats, "PART", part)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in byte_repeats.without_repeats(table, 60, 31).collect()]
    assert in_order(got) == in_order(brute_bytes(rows_of(table), 60))


def test_lines(table):
    rows, wanted = rows_of(table), brute_lines(rows_of(table))
    assert in_order((r.doc_id, r.n_lines, r.removed_lines) for r in line_dedup.line_removals(table).collect()) == in_order(wanted)
    texts = [(k, t if t is None or not gone else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)) for (k, t), (_, _, gone) in zip(rows, wanted, strict=True)]
    kept = line_dedup.without_repeated_lines(table)
    assert kept.columns == table.columns and in_order(rows_of(kept)) == in_order(texts)


def test_rows_of_one_key_keep_their_own_lines(spark):
    a, b = "one unique line of its own here\nalpha beta gamma delta", "nothing in common with others\nsecond totally unrelated text"
    rows = [(None, a), (None, b), (1, "alpha beta gamma delta"), (-5, "below zero"), (None, b)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS lines", "2 AS gone", "3 AS row", "4 AS rk", "5 AS c0")
    got = in_order((r.doc_id, r.n_lines, r.removed_lines) for r in line_dedup.line_removals(table).collect())
    assert got == in_order([(None, 2, [1]), (None, 2, []), (None, 2, []), (1, 1, []), (-5, 1, [])])
    assert line_dedup.without_repeated_lines(table).columns == table.columns


@pytest.mark.parametrize("up, down", [(4, 5), (1, 2), (9, 10)])
def test_lines_at_other_thresholds_and_in_dense_groups(spark, up, down):
    rng = random.Random(up)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 14))] for _ in range(8)]
    lines = [" ".join(w if rng.random() < 0.9 else f"w{rng.randrange(60)}" for w in rng.choice(base)) for _ in range(260)]
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(65)]
    flat = [(i, j, frozenset(split(l))) for i, t in rows for j, l in enumerate(t.split("\n"))]
    wanted = {(i, j) for n, (i, j, s) in enumerate(flat) if any(down * len(s & o) >= up * len(s | o) for _, _, o in flat[:n])}
    got = line_dedup.line_removals(spark.createDataFrame(rows, "doc_id bigint, text string"), up, down).collect()
    assert {(r.doc_id, j) for r in got for j in r.removed_lines} == wanted


def test_components(table):
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(table).collect()]
    assert in_order(got) == in_order(brute_components(rows_of(table)))
    one = simhash.one_of_each(table, 4)
    wanted = brute_components(rows_of(table))
    assert one.columns == table.columns
    if len({k for k, _, _ in wanted}) == len(wanted):
        assert {r.doc_id for r in one.collect()} == {c for _, _, c in wanted}


def test_dense_groups_meet(spark):
    rng = random.Random(2)
    prints = {0}
    while len(prints) < 150:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    rows = [(i, simhash.signed(p)) for i, p in enumerate(sorted(prints))] + [(900, simhash.signed(0xFFFF0000FFFF0000))]
    roots = {r.fp: r.root for r in simhash.linked(spark.createDataFrame(rows, "i int, fp bigint").select("fp"), 4).collect()}
    assert len(set(roots.values())) == 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("width", [1, 2, 4, 5, 13, 20])
def test_levels(width):
    """Every asked window holds a sampled window of each shorter length, at the same place in each of its occurrences."""
    import numpy as np

    lengths = substrings.levels(width)
    assert lengths[-1] == width and all(a == (b + 1) // 2 for a, b in zip(lengths, lengths[1:], strict=False)) and len(lengths) >= 2
    assert substrings.levels(13) == [4, 7, 13]
    rng = np.random.default_rng(width)
    h = rng.integers(0, 6, 300).astype(np.uint64)
    h[200:240] = h[20:60]
    first = np.array([0, 90, 90, 190, 300])
    known = None
    for level in range(len(lengths)):
        starts, parts = substrings.sampled(h, first, lengths, level)
        if known is not None:
            assert set(parts.tolist()) <= known
            assert all(s <= p and p + lengths[level - 1] <= s + lengths[level] for s, p in zip(starts.tolist(), parts.tolist(), strict=True))
        if level:
            shift = dict(zip(starts.tolist(), (parts - starts).tolist(), strict=True))
            assert all(shift[i + 180] == shift[i] for i in range(20, 60 - lengths[level] + 1) if i in shift and i + 180 in shift)
        known = set(starts.tolist())
    assert known == {i for a, b in zip(first, first[1:], strict=False) for i in range(a, b - width + 1)}


def test_ranks_count_all_words_and_codes_sort_as_longs(spark):
    """Ranks follow the counts of all words; codes hold no null, so that Spark sorts them as longs; lines of blanks alone are no lines."""
    texts = [(1, "a b\na c\n \t\v\f\r \n"), (2, "a\td"), (3, None), (4, "")]
    docs = spark.createDataFrame(texts, "row bigint, t string")
    words = [w for _, t in texts for w in re.split(r"[\s]", t or "")]
    table = spark.range(1).select(line_dedup.rarity(docs).alias("r")).first().r
    low = 64 - line_dedup.RARITY_BITS
    at = {w: xxhash.xxh64_intdigest(w.encode(), 42) >> low for w in set(words)}
    rank = {w: (table[b] ^ (b >> line_dedup.RARITY_BITS - line_dedup.RANK_BITS)) & 255 ^ 128 for w, b in at.items()}
    assert words.count("a") == 3 and all(rank["a"] > rank[w] for w in "bcd")
    ranks = F.array(F.lit(0).cast("bigint"))
    codes = docs.select(line_dedup.by_rarity(F.col("t"), ranks).alias("codes"))
    assert not codes.schema["codes"].dataType.containsNull
    gone = line_dedup.line_removals(spark.createDataFrame([(1, " \t\v\f\r \n\r"), (2, "\r\n \t\v\f\r ")], "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in gone.collect()} == {1: (2, 0), 2: (2, 0)}

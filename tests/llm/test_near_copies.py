"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of shingle sets."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import line_dedup, near_copies

pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text, width=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and alike(sets[i], sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (k, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, k), k)
    return set(least.values())


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], [rng.choice("xyz") * 3], [out[i], "more"]])
    return out


def planted():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, passage = [], [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(3, 300))]
        rows.append(" ".join(base))
        rows += [" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 40))) for _ in range(3)]
        rows.append(" ".join(base + passage))
    dense = [word() for _ in range(200)]
    rows += [" ".join(edited(rng, dense, 2)) for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_every_pair_of_similarity_is_found(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = brute(rows)
    assert {r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, "").collect()} == wanted
    assert 25 <= len(wanted) < len(rows) // 2


def test_a_pair_beyond_four_bits(spark):
    """One word changed in the middle of 60: 51 of 61 shingles are common, far beyond four bits of a fingerprint."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base[:30], "other", *base[31:]])), (3, " ".join(base[:30]))], "doc_id bigint, text string")
    assert {r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, "").collect()} == {1, 3}


def test_candidates_of_fingerprints(spark, monkeypatch):
    """Fingerprints linked by four bits or fewer are candidates, whether by the grid or as equals; what is no near copy is verified away."""
    prints = [0, 1, 3, 1 << 63, 0xFF, 0xFF, 0xFF0F << 20, (0xFF0F << 20) ^ 0b11110]
    sets = spark.createDataFrame([(10 + i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "sid bigint, fp bigint")
    group = {10 + i: 10 + i for i in range(len(prints))}
    pairs = [(r.u, r.v) for r in near_copies.close_prints(sets, 4).collect()]
    for u, v in pairs:
        assert bin(prints[u - 10] ^ prints[v - 10]).count("1") <= 4
        a, b = sorted((group[u], group[v]))
        group = {k: a if g == b else g for k, g in group.items()}
    assert group == {10: 10, 11: 10, 12: 10, 13: 10, 14: 14, 15: 14, 16: 16, 17: 16}
    used, real = [], near_copies.close_prints
    monkeypatch.setattr(near_copies, "close_prints", lambda *a: used.append(a) or real(*a))
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "f g h i j")], "doc_id bigint, text string")
    assert {r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, "").collect()} == {1, 3} and used


def test_nothing_but_names_is_kept_for_the_last_step(spark, tmp_path):
    """While whole texts move, sets, prefixes and links are no longer read, so they need not stay on disk."""
    spark.createDataFrame(planted(), "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    one = near_copies.one_of_each(spark.read.parquet(str(tmp_path / "docs")))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_only_sets_that_sketches_allow_travel(spark, monkeypatch):
    """Texts that share rare shingles but are not alike are told apart by sketches; their whole sets are not read."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    fillers, phrases = ([[word() for _ in range(n)] for _ in range(10)] for n in (60, 20))
    rows = [(i, " ".join(phrases[i // 2] + fillers[i % 2 * 2 + i // 2 % 2])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left, real = [], near_copies.by_sketch

    def seen(pairs, *rest):
        left.append((pairs.distinct().count(), (out := real(pairs, *rest)).count()))
        return out

    monkeypatch.setattr(near_copies, "by_sketch", seen)
    assert {r.doc_id for r in near_copies.one_of_each(docs).collect()} == brute(rows) == set(range(20))
    assert sum(before for before, _ in left) > 0 and sum(after for _, after in left) == 0


def test_sketches_never_overrate_a_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(0, 400), dtype=np.uint64)) for _ in range(2)]
        common = np.unique(rng.integers(0, 1 << 62, rng.integers(0, 400), dtype=np.uint64))
        sets = [np.union1d(s, common) for s in sets] + [common]
        n = np.array([len(s) for s in sets])
        bits = near_copies.sketches_of(np.repeat(np.arange(3), n), np.concatenate(sets), n)
        assert all(near_copies.apart(bits[i], bits[j]) <= len(np.setxor1d(sets[i], sets[j])) for i in range(3) for j in range(3))


def test_whole_texts_move_once(spark, tmp_path):
    """The last step deals texts by set and doc_id once, unless a smallest doc_id stands on several sets of a component."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = planted()
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(near_copies.one_of_each(spark.read.parquet(str(tmp_path / "docs")))).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    base = max((t for _, t in rows), key=len)
    twice = spark.createDataFrame([(1, base), (1, base + " more"), (1, base), (2, base), (None, base)], "doc_id bigint, text string")
    assert [(r.doc_id, r.text) for r in near_copies.one_of_each(twice).collect()] == [(1, base)]


def test_line_dedup_moves_texts_alike_at_every_size(spark):
    rows = [(i, f"one line that many documents share in full\nand line {i} of its own, {i * 31} and {i * 77}") for i in range(30)]
    kept = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert "SortMergeJoin" in kept._jdf.queryExecution().executedPlan().toString()


def test_rarity_is_counted_on_a_share_of_rows(spark):
    """Some rows suffice to order words, and no order changes what is removed."""
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(12)) for _ in range(6)) for _ in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (80, texts[0] + " more")], "doc_id bigint, text string")
    rows = line_dedup.Rows(docs, "doc_id", "text")
    named = docs.select(rows.row(docs["doc_id"], docs["text"]).alias("row"), docs["text"].alias("t"))
    assert 0 < line_dedup.counted(named).count() < 81 // 3
    every = F.split(F.lit(",".join(str((b * 2654435761 >> 7) % 256 - 128) for b in range(1 << line_dedup.RARITY_BITS))), ",").cast("array<bigint>")
    found = [{r.rk: r.gone for r in line_dedup.repeated_lines(docs, rows, 4, 5, "doc_id", "text", ranks).collect()} for ranks in (None, every)]
    assert found[0] == found[1] and found[0][80][:5] == [0, 1, 2, 3, 4]


def test_rarity_counts_the_words_of_all_rows(spark):
    """Each word stands in one row alone, so a share of the rows would give most of them one rank."""
    words = [f"word{i}" for i in range(12)]
    rows = [(i, "\n".join([f"{w}\t{w}", *[f"{w} " * 5] * i, w])) for i, w in enumerate(words)]
    ranks = line_dedup.rarity(spark.createDataFrame(rows, "row bigint, t string"))
    codes = spark.range(1).select(*[line_dedup.by_rarity(F.lit(w), ranks)[0].alias(w) for w in words]).first()
    assert list(codes) == sorted(codes) and len({c >> 56 for c in codes}) == 12


def test_a_rare_word_is_told_from_a_common_one_beside_it(spark):
    """Two words that agree in 16 bits of their hashes have ranks of their own: else lines meet by words that many lines hold."""
    seen, found, i = {}, None, 0
    while found is None:
        h = xxhash.xxh64(f"w{i}".encode(), seed=42).intdigest()
        other = seen.setdefault(h >> 48, i)
        g = xxhash.xxh64(f"w{other}".encode(), seed=42).intdigest()
        if g >> 46 != h >> 46 and g >> 56 == h >> 56:
            found = sorted((f"w{i}", f"w{other}"), key=lambda w: xxhash.xxh64(w.encode(), seed=42).intdigest())
        i += 1
    common, rare = found  # hashes alone would put the common one first
    texts = spark.createDataFrame([(i, " ".join([common] * 50 + [f"filler{j}" for j in range(50)])) for i in range(80)], "row bigint, t string")
    ranks = line_dedup.rarity(texts)
    codes = spark.range(1).select(line_dedup.by_rarity(F.lit(f"{common} {rare}"), ranks).alias("c")).first()["c"]
    low = lambda x: x & (1 << 56) - 1
    assert [low(c) for c in codes] == [low(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in (rare, common)]


@pytest.mark.parametrize("up, down", [(4, 5), (1, 2), (9, 10)])
def test_reach_is_the_positional_and_the_length_filter(spark, up, down):
    side = lambda n, i: spark.range(1, 26).select(F.col("id").alias(n)).select(n, F.explode(F.expr(f"sequence(1, {n} - ({n} * {up} + {down - 1}) DIV {down} + 1)")).alias(i))
    both = side("n", "i").crossJoin(side("o", "j")).select("*", line_dedup.reach("n", "i", up, down).alias("r"), line_dedup.reach("o", "j", up, down).alias("s")).collect()
    assert min(min(x.r, x.s) for x in both) >= 0
    for x in both:
        wanted = min(x.n, x.o) * down >= max(x.n, x.o) * up and (1 + min(x.n - x.i, x.o - x.j)) * (up + down) >= (x.n + x.o) * up
        assert (x.o <= x.r and x.n <= x.s) == wanted


def test_line_dedup_leaves_one_table(spark, tmp_path):
    """Of its tables the stage leaves the one that its result reads."""
    tables = lambda: {p.name for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("table-*")}
    rows, before = [(i, f"one line that many documents share in full\nand line {i} of its own, {i * 31} and {i * 77}") for i in range(30)], tables()
    kept = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert len(tables() - before) == 1
    assert sorted(r.text.count("\n") for r in kept.collect())[-1] == 1


def test_awkward_rows(docs, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    one = near_copies.one_of_each(docs)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == brute(rows)
    assert near_copies.one_of_each(nothing).count() == 0
    assert {r.doc_id for r in near_copies.one_of_each(awkward).collect()} == {None, 1, 2}


def test_rarity_rewrites_only_texts_with_odd_blanks(spark, monkeypatch):
    """All words are counted as before, but a text is rewritten character by character only if it holds a blank that asks for it."""
    words, rewritten = [f"word{i}" for i in range(4)], []
    plain = line_dedup.spaced
    monkeypatch.setattr(line_dedup, "spaced", lambda text: rewritten.append(text) or plain(text))
    rows = [(i, f"{w}\n\n" * (10 * i + 1) + f"{w}\t{w}\r\n{w}\v{w}\f{w}  {w}") for i, w in enumerate(words)]
    ranks = line_dedup.rarity(spark.createDataFrame([*rows, (9, None), (10, "")], "row bigint, t string"))
    assert len(rewritten) == 1
    codes = spark.range(1).select(*[line_dedup.by_rarity(F.lit(w), ranks)[0].alias(w) for w in words]).first()
    assert list(codes) == sorted(codes) and len({c >> 56 for c in codes}) == 4

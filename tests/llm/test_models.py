"""Language model, toxicity, decontamination, nearest neighbours."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontamination, hash_forest, packing, pitman_yor, seating, toxicity
from spanloom.llm.queries import op1_pitman_yor, op3_toxicity, op5_hash_prefix_forest, op8_benchmark_decontamination
from spanloom.llm.runtime import written

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w] + ["</s>"]


def test_base_scores_and_perplexity(spark):
    rows = {r.doc_id: r for r in op1_pitman_yor(spark, SF).collect()}
    texts = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {k for k in texts if zlib.crc32(str(k).encode()) % 7 == 2}
    c = Counter(w for k, t in texts.items() if k not in held for w in t)
    n, v = sum(c.values()), len(c)
    for k, t in texts.items():
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k in held, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-7)
    mean = lambda name, keys: sum(rows[k][name] for k in keys) / sum(rows[k].n_tokens for k in keys)
    assert mean("score", held) > mean("base_score", held) + 0.2


def test_texts_have_total_probability_one(spark):
    """All texts of up to six words over the vocabulary and one unknown word: nearly all of the mass, and never more than one."""
    from itertools import product

    rng = random.Random(0)
    train = [(i, " ".join(rng.choice("aab") for _ in range(rng.choice([0, 1, 1, 2])))) for i in range(300)]
    every = [" ".join(w) for n in range(7) for w in product(["a", "b", "never"], repeat=n)]
    docs = spark.createDataFrame(train + [(1000 + i, t) for i, t in enumerate(every)], "doc_id bigint, text string")
    got = pitman_yor.scores(docs, trains=F.col("doc_id") < 1000).where("doc_id >= 1000").collect()
    total = sum(10**r.score for r in got)
    assert 0.98 < total < 1 + 1e-6


@pytest.mark.parametrize("n, d, w", [(2, 0.5, 1.0), (5, 0.8, 0.3), (30, 0.5, 2.0), (64, 0.8, 0.05), (66, 0.8, 0.3)])
def test_seatings_have_the_posterior_number_of_tables(n, d, w):
    """The weight of t tables is w^t times the generalised Stirling number of n and t."""
    exact = {1: w}
    for c in range(1, n):
        exact = {t: w * exact.get(t - 1, 0) + (c - d * t) * exact.get(t, 0) for t in range(1, c + 2)}
        total = sum(exact.values())
        exact = {t: x / total for t, x in exact.items()}
    rng, dishes = np.random.default_rng(3), 1500
    c, t = np.full(dishes, n), np.ones(dishes, np.int64)
    size, means = c.copy(), []
    for sweep in range(60):
        t, size = seating.swept(c, t, size, np.full(dishes, w), d, rng)
        assert (np.add.reduceat(size, np.cumsum(t) - t) == n).all()
        if sweep >= 20:
            means.append(t.mean())
    assert np.mean(means) == pytest.approx(sum(t * x for t, x in exact.items()), rel=0.02)


@pytest.mark.parametrize("n, d, w", [(1000, 0.8, 10.0), (2000, 0.9, 200.0), (100, 0.5, 50.0)])
def test_a_sweep_moves_all_customers_of_a_large_dish(n, d, w):
    """A few sweeps lead from one table to the posterior's number of tables: its mean and variance."""
    exact = np.zeros(n + 2)
    exact[1], k = 1.0, np.arange(n + 2)
    for c in range(1, n):
        exact = np.maximum(c - d * k, 0) * exact + w * np.append(0, exact[:-1])
        exact /= exact.sum()
    mean = (k * exact).sum()
    rng, dishes = np.random.default_rng(11), 2000
    c, t = np.full(dishes, n), np.ones(dishes, np.int64)
    size, counts = c.copy(), []
    for _ in range(24):
        t, size = seating.swept(c, t, size, np.full(dishes, w), d, rng)
        assert (np.add.reduceat(size, np.cumsum(t) - t) == n).all() and (size > 0).all()
        counts.append(t)
    assert counts[3].mean() == pytest.approx(mean, rel=0.05)
    assert np.mean(counts[12:]) == pytest.approx(mean, rel=0.02)
    assert np.mean([x.var() for x in counts[12:]]) == pytest.approx((((k - mean) ** 2) * exact).sum(), rel=0.1)


def test_customers_come_and_leave():
    rng = np.random.default_rng(5)
    before, t, size, after = np.array([1, 5, 100, 3, 1]), np.array([1, 2, 3, 1, 1]), np.array([1, 2, 3, 50, 49, 1, 3, 1]), np.array([1, 3, 120, 3, 2])
    t, size = seating.adjusted(before, t, size, after, rng)
    assert (np.add.reduceat(size, np.cumsum(t) - t) == after).all() and (size > 0).all()


class Restaurant:
    """One customer after the other, each knowing its table."""

    def __init__(self, parent, strength, discount, rng):
        self.tables, self.parent, self.strength, self.discount, self.rng = {}, parent, strength, discount, rng

    def probability(self, w):
        c, t = sum(map(sum, self.tables.values())), sum(map(len, self.tables.values()))
        mine = self.tables.get(w, [])
        return (sum(mine) - self.discount * len(mine) + (self.strength + self.discount * t) * self.above(w)) / (self.strength + c)

    def above(self, w):
        return self.parent.probability(w) if isinstance(self.parent, Restaurant) else self.parent

    def sit(self, w):
        mine = self.tables.setdefault(w, [])
        opening = (self.strength + self.discount * sum(map(len, self.tables.values()))) * self.above(w)
        k = self.rng.choices(range(len(mine) + 1), [x - self.discount for x in mine] + [opening])[0]
        if k == len(mine):
            mine.append(1)
            if isinstance(self.parent, Restaurant):
                self.parent.sit(w)
        else:
            mine[k] += 1

    def leave(self, w):
        mine = self.tables[w]
        k = self.rng.choices(range(len(mine)), mine)[0]
        mine[k] -= 1
        if not mine[k]:
            del mine[k]
            if isinstance(self.parent, Restaurant):
                self.parent.leave(w)


def test_scores_against_one_customer_at_a_time(spark):
    rng = random.Random(8)
    names = [f"w{i}" for i in range(60)]
    pick = lambda before: names[(int(rng.paretovariate(0.9)) + 7 * int(before[1:] or 0)) % 60]
    rows = []
    for i in range(60):
        words = ["w"]
        while len(words) < 12:
            words.append(pick(words[-1]))
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.score for r in pitman_yor.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") < 40, burn_in=8, samples=20).collect()}
    pairs = lambda text: list(zip(["<s>", *tokens(text)], tokens(text), strict=False))
    counts = Counter(x for i, t in rows if i < 40 for x in pairs(t))
    rate = lambda c: min(0.95, max(0.05, c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5))
    seen = Counter(w for _, w in counts)
    d, d0 = rate(Counter(counts.values())), rate(Counter(seen.values()))
    top = Restaurant(1 / (len(seen) + 1), 5.0, d0, rng)
    rooms = {u: Restaurant(top, 5.0, d, rng) for u in {u for u, _ in counts}}
    everyone = list(counts.elements())
    for u, w in everyone:
        rooms[u].sit(w)
    sums = Counter()
    for sweep in range(40):
        for u, w in everyone:
            rooms[u].leave(w)
            rooms[u].sit(w)
        if sweep >= 10:
            for u, w in {x for _, t in rows for x in pairs(t)}:
                sums[u, w] += rooms[u].probability(w) / 30
    for i, t in rows:
        assert got[i] == pytest.approx(sum(math.log10(sums[x]) for x in pairs(t)), rel=0.06)
    assert sum(got.values()) == pytest.approx(sum(math.log10(sums[x]) for _, t in rows for x in pairs(t)), rel=0.015)


def test_a_very_frequent_word_is_scored_in_parts(spark):
    """More than 2^20 tokens of one word: several tasks score its bucket, and equal texts get equal scores from each."""
    n, many = 60, 30_000
    docs = spark.createDataFrame([(i, "the " * many) for i in range(n)] + [(n + i, "a rare word stands here") for i in range(n)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pitman_yor.scores(docs, F.lit(True)).collect()}
    total, v = n * (many + 7), 7
    base = many * math.log10((n * many + 1) / (total + v + 1)) + math.log10((2 * n + 1) / (total + v + 1))
    for i in range(n):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (many + 1, many + 1, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-7) and got[i].score == got[0].score > base
        assert got[n + i].n_known == 6 and got[n + i].score == got[n].score


def test_large_rows_are_written_in_small_row_groups(spark):
    """What the reader holds at once: one group of rows, not the file."""
    table = written(spark.range(0, 100, 1, 1), large=True)
    assert sorted(r.id for r in table.collect()) == list(range(100))
    groups = [m.row_group(i).num_rows for f in table.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
    assert sum(groups) == 100 and max(groups) <= 32


def test_scores_of_awkward_rows(docs, awkward, nothing):
    assert pitman_yor.scores(docs, F.lit(True)).count() == 13
    rows = pitman_yor.scores(awkward, F.col("doc_id") < 2).collect()
    assert len(rows) == 8 and sorted(r.n_tokens for r in rows) == sorted(len(tokens(t)) for t in [r.text for r in awkward.collect()])
    assert pitman_yor.scores(nothing, F.lit(True)).count() == 0
    untrained = pitman_yor.scores(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.score == pytest.approx(0) for r in untrained)


def test_toxicity(spark, docs, awkward, nothing):
    bad, good = ["awful", "nasty", "vile"], [f"word{i}" for i in range(50)]
    rng = random.Random(4)
    text = lambda toxic: " ".join(rng.choice(good) for _ in range(20)) + (" you " + " ".join(rng.sample(bad, 2)) if toxic else " you there")
    rows = [(i, text(i % 5 == 0)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(7, 0), (None, 1), (8, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(table, labels)
    assert 0 < len(model.at) < 2000
    scored = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert all((scored[i] >= 0.3) == (i % 5 == 0) for i in range(400, 600))
    kept = toxicity.without_toxic(table.withColumn("__score", F.lit("x")).withColumnRenamed("__score", "score"), model)
    assert kept.count() == 480 and kept.columns == ["doc_id", "text", "score"]
    assert toxicity.score(docs, model).count() == 13 and toxicity.score(awkward, model).count() == 8 and toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(nothing, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert op3_toxicity(spark, SF).where("score < 0 OR score > 1").count() == 0


def nearest(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, row[j - 1] + (x != y), new[j - 1] + 1))
        row = new
    return min(row)


def plain(text):
    return re.findall(r"[^\s!-/:-@\[-`{-~]+", (text or "").lower())


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 6, 8, 12, 20, 33, 50])] + [(50, None), (51, " ., "), (52, "v1")]

    def edited(text, n):
        w = text.split()
        for _ in range(n):
            p = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[p : p + 1] = [] if kind == 0 and len(w) > 1 else [rng.choice(vocabulary)] if kind == 1 else [w[p], rng.choice(vocabulary)]
        return " ".join(w)

    noise = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(d, noise(30) + " " + edited(t, len(t.split()) * k // 20) + ", " + noise(20)) for d, (t, k) in enumerate((t, k) for _, t in items[:10] for k in range(7))]
    rows += [(500, None), (501, ""), (None, items[7][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.leaks(docs, bench).collect()}
    wanted = {}
    for d, t in rows:
        for i, x in items:
            if plain(x) and (n := nearest(plain(x), plain(t))) <= len(plain(x)) // 5 and plain(t):
                wanted[d, i] = n
    assert got == wanted
    assert decontamination.leaks(docs, bench, item_bytes=100).count() == len(wanted)
    clean = decontamination.without_leaks(docs.withColumn("item_id", F.lit(1)), bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in wanted}
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_registered_leaks_reach_recall(spark):
    got = {(r.doc_id, r.item_id) for r in op8_benchmark_decontamination(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        item = " ".join(plain(r.text))
        assert all((d.doc_id, r.item_id) in got for d in docs if f" {item} " in f" {' '.join(plain(d.text))} ")


def brute_neighbours(rows, k=20):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            near = sorted((-float(v @ w), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_neighbours_with_ties_and_unusable_rows(spark):
    rng = random.Random(3)
    same = [0.5, -0.25, 1.0, 0.0]
    rows = [(i, same if i % 3 == 0 else [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(240)]
    rows += [(1000, None), (1020, [0.0] * 4), (1040, [float("nan"), 1.0, 1.0, 1.0]), (1060, [None, 1.0, 1.0, 1.0]), (1080, []), (None, same), (1100, [1.0, 2.0]), (20, rows[20][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, score int")
    got: dict = {}
    for r in hash_forest.nearest_neighbours(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    wanted = {i: v for i, v in brute_neighbours(list(dict(rows).items())).items() if v}
    assert got.keys() == wanted.keys()
    for i in got:
        assert [j for j, _ in got[i]] == [j for j, _ in wanted[i]]
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in wanted[i]])
    assert hash_forest.nearest_neighbours(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    wanted = brute_neighbours(rows)
    got: dict = {}
    for r in op5_hash_prefix_forest(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[i] & {j for j, _ in near}) for i, near in wanted.items())
    assert hits >= 0.9 * sum(len(n) for n in wanted.values())


def test_toxicity_holds_a_sample_once_on_the_driver(spark, monkeypatch):
    """What is learned from are views of the collected table, at 4 bytes a feature, texts without words included; not lists of their own at 8."""
    seen, plain = [], toxicity.ftrl
    monkeypatch.setattr(toxicity, "ftrl", lambda examples, *how: seen.extend(examples) or plain(examples, *how))
    rows = [(i, f"word{i % 7} and text{i}") for i in range(50)] + [(50, ""), (51, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(52)], "doc_id bigint, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, l1=0.0)
    assert len(seen) == 52 and sorted(len(at) for at, _ in seen)[:3] == [0, 0, 6]
    assert all(at.itemsize == 4 and not at.flags.owndata for at, _ in seen) and sum(y for _, y in seen) == 26
    again = plain([(np.array(at, np.int64), y) for at, y in seen], 20, 1.0, 1.0, 0.0, 0.0, 8)
    assert (model.at == again.at).all() and (model.weight == again.weight).all() and model.bias == again.bias


def test_what_is_packed_comes_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 700):
        word, context = np.sort(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)), rng.integers(0, 1 << 20, n)
        word[: n // 2] = word[: 1]  # half of the entries are of one word
        order, first = pitman_yor.by_pair(word, context, 1 << 20)
        word, context, runs = word[order], context[order], np.diff(first, append=n)
        names = ["words", "runs", "contexts"]
        row = dict(zip(names, pitman_yor.pack_pairs(word[first], runs, context, first), strict=True)) | {"n": n, "m": len(first)}
        for got, given in zip(pitman_yor.unpack_pairs(row), (word[first], runs, context, first), strict=True):
            assert (got == given).all() and len(got) == len(given)
        values = rng.integers(-(1 << 40), 9, n)
        assert (packing.unpack_plain(packing.pack_plain(values), n) == values).all()


def test_tokens_travel_short():
    """Hashes ascend, contexts ascend within a word, places are in no order: each is packed by that, at least a fifth shorter than all as differences or whole."""
    rng = np.random.default_rng(5)
    word, context, place = rng.choice(rng.integers(0, 1 << 64, 20_000, np.uint64), 60_000), rng.integers(0, 1 << 20, 60_000), rng.integers(0, 300, 60_000)
    order, _ = pitman_yor.by_pair(word, context, 1 << 20)
    word, context, place = word[order], context[order], place[order]
    size = former = 0
    for _, cut, row in pitman_yor.dealt(word, context, 16, place):
        size += sum(map(len, row[2:]))
        at = pitman_yor.starts_of(word[cut])
        former += len(packing.pack_hashes(word[cut][at], 8)) + sum(len(packing.pack_ints(x)) for x in (np.diff(at, append=len(word[cut])), context[cut], place[cut]))
    assert size < 0.8 * former

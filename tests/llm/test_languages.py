"""Language identification: held-out accuracy, the machines against a plain trainer, n-grams against a loop."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import languages, queries
from spanloom.llm.arrays import buffers

SF = "/root/testdata/sf0.01"


def test_op12(spark):
    """Whole table, folds as asked; rows held out are told right."""
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op12_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    long = [r for r in found if r.held_out and len(langs[r.doc_id][1]) > 60]
    assert len(long) > 200 and np.mean([r.lang_pred == langs[r.doc_id][0] for r in long]) > 0.985
    for lang in ("en", "de", "fr", "es"):
        own = [r for r in long if langs[r.doc_id][0] == lang]
        assert np.mean([r.lang_pred == lang for r in own]) > 0.95


def loop_grams(text, bits):
    folded = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    counts = np.zeros(1 << bits)
    for size in range(1, 5):
        for i in range(len(folded) - size + 1):
            code = int.from_bytes(folded[i : i + size], "big") ^ (size * 0x3C6EF35F & 0xFFFFFFFF)
            counts[(code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)] += 1
    return counts


def test_ngrams_in_pieces(monkeypatch):
    """Whole texts in pieces that cut n-grams; rows of all lengths."""
    texts = ["", "a", "Ab", None, "The quick brown Füchse!", "x" * 37, "日本語 text", "", "zz"]
    raw, offsets = buffers(pa.array(texts))
    wanted = np.array([loop_grams(t or "", 10) for t in texts])
    for piece in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(languages, "PIECE", piece)
        assert (languages.grams(raw, offsets, 10) == wanted).all()
    x = languages.vectors(raw, offsets, 10)
    assert np.allclose((x * x).sum(axis=1), [bool(t) for t in texts])


def test_letters():
    texts = ["", None, "12 34 !?", "a", "Ж", "١٢", "—…", "1é", " ", "漢", "²"]
    raw, offsets = buffers(pa.array(texts))
    assert languages.has_letter(raw, offsets).tolist() == [any(map(str.isalpha, t or "")) for t in texts]


def test_machine_minimises_its_objective():
    """Against plain gradient descent on the same squared hinge loss."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    signs = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 + rng.normal(size=60) * 0.4 > 0, 1.0, -1.0)
    rows = [(np.arange(6), r) for r in x]
    weight = np.where(signs > 0, 30 / (signs > 0).sum(), 30 / (signs < 0).sum()) * 0.5
    full = np.hstack([x, np.ones((60, 1))])
    loss = lambda w: w @ w / 2 + (weight * np.maximum(0, 1 - signs * (full @ w)) ** 2).sum()
    plain = np.zeros(7)
    for _ in range(30_000):
        slack = np.maximum(0, 1 - signs * (full @ plain))
        plain -= 0.002 * (plain - 2 * full.T @ (weight * signs * slack))
    got = languages.machine(rows, signs, 6, cost=0.5, sweeps=2000)
    assert loss(got) == pytest.approx(loss(plain), rel=1e-3)
    assert np.allclose(got, plain, atol=0.02)


def test_families_and_votes(spark):
    """Three languages in one family, one of another and one of no family that is known."""
    words = {"de": "der die und nicht ein", "nl": "het een van niet zijn", "sv": "och att det inte som", "fr": "le la les pas une", "x-none": "qoq zuz qaq zyz quq"}
    rng = np.random.default_rng(1)
    say = lambda lang: " ".join(rng.choice(words[lang].split(), 30))
    rows = [(10 * i + k, say(lang), lang) for i in range(30) for k, lang in enumerate(words)]
    docs = spark.createDataFrame([*rows, (9990, "nichts", None), (9991, None, "de"), (9992, "123 !", "de")], "doc_id bigint, text string, lang string")
    model = languages.fit(docs, usable=F.col("doc_id") % 20 < 10, max_rows=12)
    assert model.languages == {"germanic": ["de", "nl", "sv"], "romance": ["fr"], "=x-none": ["x-none"]}
    assert model.pairs == [("de", "nl"), ("de", "sv"), ("nl", "sv")]
    wanted = {k: lang for k, _, lang in rows} | {9991: "und", 9992: "und"}
    got = {r.doc_id: r for r in languages.predict(docs, model).collect()}
    assert all(got[k].lang_pred == lang for k, lang in wanted.items())
    assert got[9991].score == got[9992].score == 0 and got[9990].lang_pred in words


def test_awkward_rows(spark, docs, awkward, nothing):
    """Clashing names, null and repeated keys, no rows, nothing learnt."""
    named = docs.withColumnsRenamed({"k": "h", "tag": "places", "fp": "number"}).withColumn("task", F.lit(1))
    found = languages.predict(named, languages.fit(named))
    assert found.columns == ["doc_id", "lang_pred", "score"]
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {i: "und" if i in (3, 4, 5) else "en" for i in range(1, 14)}
    lettered = awkward.withColumn("lang", F.when(F.col("text") == "short", "de").otherwise("en"))
    told = languages.predict(lettered, languages.fit(lettered)).collect()
    assert len(told) == 8 and sorted(r.lang_pred for r in told) == ["de", "de", "en", "en", "en", "en", "en", "und"]
    unlabelled = languages.fit(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in languages.predict(awkward, unlabelled).collect()} == {("und", 0.0)}
    empty = nothing.withColumn("lang", F.lit("en"))
    assert languages.predict(empty, languages.fit(empty)).count() == 0


def test_the_sample_is_bounded_and_whole(spark):
    """max_rows texts of the frequent language, all of the rare one; copies are learned from once."""
    rows = [(i, f"text number {i} in plain words", "en") for i in range(3000)] + [(5000 + i, "the very same text", "en") for i in range(1500)] + [(9000 + i, f"seltener Text {i}", "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = languages.sample(docs, None, "doc_id", "text", "lang", 50, 10).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"en": 50, "de": 20}

"""Every stage and operator on tables with clashing column names, null and repeated keys, empty and long texts."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanloom.llm import byte_repeats, decontamination, hash_forest, languages, line_dedup, merkle, middles, near_copies, sentence_pieces, simhash, substrings, token_counts, toxicity

CLASHES = ["leaks", "score", "ids", "n_tokens", "decoded", "__fp", "print", "sid", "root", "component", "rank", "row", "rk", "gone", "lines", "line", "k", "tag", "bucket", "words", "c0", "x0", "at", "Label", "toxic", "item_id", "SID"]


@pytest.fixture(scope="module")
def clashing(awkward):
    return awkward.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES[:-1])])


@pytest.fixture(scope="module")
def bench(spark, texts):
    return spark.createDataFrame([(1, texts[0][1]), (2, None), (3, "")], "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")


def test_stages_keep_all_columns(spark, clashing, bench):
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    model = toxicity.fit(clashing, labels(spark))
    for made in (toxicity.without_toxic(clashing, model), line_dedup.without_repeated_lines(clashing), near_copies.one_of_each(clashing), simhash.one_of_each(clashing), decontamination.without_leaks(clashing, bench)):
        assert made.columns == clashing.columns
        for r in made.collect():
            assert [r[c] for c in CLASHES[:-1]] == list(range(len(CLASHES) - 1))
    coded = sentence_pieces.with_pieces(clashing, pieces)
    assert sorted(coded.columns) == sorted(clashing.columns) and all(r.n_tokens == len(r.ids) // 4 for r in coded.collect())


@pytest.mark.parametrize("empty", [False, True])
def test_operators_ignore_other_columns(spark, clashing, bench, empty):
    table = clashing.limit(0) if empty else clashing
    n = 0 if empty else 8
    assert substrings.without_repeats(table).count() == n
    assert byte_repeats.without_repeats(table).count() == n
    assert simhash.near_duplicates(table).count() == n
    assert line_dedup.line_removals(table).count() == n
    assert sentence_pieces.encode_and_decode(table, public_tokenizers.path("piece_bpe_32k.model")).count() == n
    assert token_counts.count_tokens(table, public_tokenizers.path("word_bpe_49k.json")).count() == n
    assert toxicity.score(table, toxicity.fit(table, labels(spark))).count() == n
    assert decontamination.leaks(table, bench).count() == (0 if empty else decontamination.leaks(table.select("doc_id", "text"), bench).count())


def test_repeated_rows_of_a_labelled_key_do_not_crowd_out_others(spark):
    rows = [(1, f"vile text {i}") for i in range(400)] + [(2, "a calm text of its own"), (3, "vile words stand here")]
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id bigint, toxic int")
    fitted = [toxicity.fit(spark.createDataFrame(r, "doc_id bigint, text string"), marks, max_rows=3, l1=0.0) for r in (rows, rows[::-1])]
    assert (fitted[0].at == fitted[1].at).all() and np.allclose(fitted[0].weight, fitted[1].weight)
    calm = toxicity.text_features(*(np.frombuffer(b"calm", np.uint8), np.array([0, 4])), 20)[1]
    assert set(calm) <= set(fitted[0].at)


def test_one_long_item_takes_no_room_for_short_ones(spark):
    short = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(400)]
    bench = spark.createDataFrame([*short, (999, " ".join(f"long{j % 5000}" for j in range(60000)))], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in short[::40]] + [(5000, "long1 long2 long3")], "doc_id bigint, text string")
    items = decontamination.Items(*map(list, zip(*[(r.item_id, r.text) for r in bench.collect()], strict=True)))
    assert sum(x.nbytes for x in vars(items).values() if isinstance(x, np.ndarray)) < 4 << 20
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == {(i, i) for i, _ in short[::40]}


def test_scores_have_double_precision(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * 3).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array(rows[1][1]) * (1 + i * 1e-12)).tolist()) for i in range(30)]  # apart by less than single precision
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for r in hash_forest.nearest_neighbours(table, F.col("vec_id") % 20 == 0, key="vec_id", vector="embedding").collect():
        assert r.score == pytest.approx(float(np.dot(dict(rows)[r.query_id], dict(rows)[r.vec_id])), rel=1e-15, abs=1e-13)
    wanted = sorted(((-float(np.dot(rows[20][1], v)), i) for i, v in rows if i != 20))[:20]
    got = [r.vec_id for r in hash_forest.nearest_neighbours(table, F.col("vec_id") == 20).orderBy("rank").collect()]
    assert got == [i for _, i in wanted]


@pytest.mark.parametrize("empty", [False, True])
def test_manifest_languages_and_middles_ignore_other_columns(clashing, empty):
    named = clashing.withColumns({"lang": F.when(F.col("text") == "short", "de").when(F.col("text").isNotNull(), "en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint")})
    for i, c in enumerate(("g", "n", "pos", "block", "node", "members", "widths", "levels", "path", "h", "family", "places", "form", "output", "t", "id")):
        named = named.withColumn(c, F.lit(i))
    table, n = (named.limit(0), 0) if empty else (named, 8)
    found = merkle.manifest(table).collect()
    assert len(found) == n and len({r.root for r in found}) == min(n, 1) and all(r.leaf == r.changed_leaf for r in found)
    assert languages.predict(table, languages.fit(table)).count() == n
    assert middles.fill_in_middle(table).count() == n

"""Labels from overlaps, runs, spacing, numbers and titles against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import labels
from spanloom.plans import labels as plans
from spanloom.plans import texts
from spanloom.plans.fixtures import Fixtures

rng = random.Random(4)
CUT = labels.plain_tokenizer()


def test_traced_labels():
    text = "The cat sat on the mat. "
    assert labels.labelled_tokens(CUT, text, []) == (["The", " cat", " sat", " on", " the", " mat", "."], [1] * 7)
    # the space before "sat" belongs to the piece before it and is given back
    assert labels.labelled_tokens(CUT, text, [(8, 11), (15, 24)]) == (["The", " cat", " sat", " on", " the", " mat", "."], [1, 1, 0, 1, 0, 0, 0])
    assert labels.labelled_tokens(CUT, text, [(4, 8)]) == (["The", " cat", " sat", " on", " the", " mat", "."], [1, 0, 1, 1, 1, 1, 1])
    # a piece that cuts a word has tokens of its own
    assert labels.labelled_tokens(CUT, "abcdef", [(2, 4)]) == (["ab", "cd", "ef"], [1, 0, 1])
    assert labels.labelled_tokens(CUT, "", []) == ([], [])


def test_tokens_join_to_the_text():
    for _ in range(200):
        text = "".join(rng.choice(["ab", "c", " ", ". ", "!"]) for _ in range(15))
        while "  " in text:  # the plain tokenizer keeps one blank before a token
            text = text.replace("  ", " ")
        cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text) + 1)))
        tokens, marks = labels.labelled_tokens(CUT, text, list(zip(cuts[::2], cuts[1::2], strict=False)))
        assert "".join(tokens).rstrip() == text.rstrip() and len(tokens) == len(marks)


def loop_extract(tokens, marks, threshold):
    """Run by run, as one string that grows."""
    marks = marks + [0] * (len(tokens) - len(marks))
    out, run = "", []
    for i, (token, mark) in enumerate(zip(tokens, marks, strict=True)):
        run.append((token, mark))
        if token in labels.END_MARKS or i == len(tokens) - 1:
            piece = "".join(t for t, _ in run)
            if sum(m == 0 for _, m in run) / len(run) >= threshold:
                out += " " + piece if out and out[-1] not in " \n" and piece[0] not in " \n" else piece
            run = []
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.5, 1.0])
def test_runs_and_spacing(spark, threshold):
    rows = []
    for i in range(150):
        tokens = [rng.choice(["a", " b", ".", "\n", " c\n", "?", " .", ";"]) for _ in range(rng.randrange(0, 14))]
        rows.append((i, tokens, [rng.randrange(2) for _ in range(rng.randrange(0, len(tokens) + 1))]))
    df = spark.createDataFrame(rows, "i int, tokens array<string>, labels array<int>")
    got = {r.i: r.t for r in df.select("i", labels.spaced(labels.kept_runs(F.col("tokens"), F.col("labels"), threshold)).alias("t")).collect()}
    assert got == {i: loop_extract(t, m, threshold) for i, t, m in rows}


@pytest.mark.parametrize("threshold", [0.0, 0.5, 1.0])
def test_runs_where_tokens_are_made(spark, threshold):
    rows = []
    for i in range(150):
        tokens = [rng.choice(["a", " b", ".", "?", " .", ";"]) for _ in range(rng.randrange(0, 14))]
        rows.append((i, tokens, [rng.randrange(2) for _ in tokens]))
    df = spark.createDataFrame(rows, "i int, tokens array<string>, labels array<int>")
    got = {r.i: r.t for r in df.select("i", labels.kept_runs(F.col("tokens"), F.col("labels"), threshold).alias("t")).collect()}
    assert got == {i: labels.kept_texts(t, m, threshold) for i, t, m in rows}


def test_many_runs_cost_no_product(spark):
    """20,000 runs in a passage: a label or an end that is sought from the start for each run would take minutes."""
    tokens, marks = ["a", " b", "?"] * 20_000, [1, 0, 0, 0, 1, 1] * 10_000
    df = spark.createDataFrame([(tokens, marks)], "tokens array<string>, labels array<int>")
    began = time.monotonic()
    row = df.select(labels.kept_runs(F.col("tokens"), F.col("labels")).alias("kept"), labels.spaced(labels.kept_runs(F.col("tokens"), F.col("labels"))).alias("t")).first()
    assert time.monotonic() - began < 30
    assert row.kept == ["a b?"] * 10_000 and row.t == " ".join(["a b?"] * 10_000)


def test_paragraphs_are_labelled_in_their_rows(spark):
    """Segments and what is kept of them come with their paragraph: nothing meets in a sweep, and texts are those of the sweep."""
    made = {"doc_id": "bigint", "source": "string", "text": "string"}
    texts_ = ["One. Two!  Three? \n\n x. y: z; u", "\n", "", None, "a.b.c.\nno end", "x. " * 30 + "\n" + "\U0001f600 y! " * 9]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts_)], ", ".join(f"{c} {t}" for c, t in made.items()))
    fx = Fixtures(spark, "")
    fx.chapters = docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_idx"), F.col("text").alias("original"))
    found = plans.dataset(fx, "paragraph", 19)
    kept = fx.rated(19).where("kept").select("chapter_idx", F.col("start_char").alias("o_start"), F.col("end_char").alias("o_end"))
    swept = labels.label_passages(labels.with_overlaps(plans.passages(fx, "paragraph"), fx.segments, kept), labels.plain_tokenizer)
    rows = lambda df: sorted((r.chapter_idx, r.idx, r.tokens, r.labels) for r in df.collect())
    assert rows(found) == rows(swept) and rows(found)
    for df in (found, plans.extracts(fx)):
        assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_paragraphs_keep_their_line_breaks(spark):
    given = ["a\nb", "\n", "\n\na\n", "", "a", None, "a\r\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", tx.paragraph_texts(F.col("t")).alias("p")).collect()}
    cut = lambda t: [p + "\n" for p in t.split("\n")[:-1]] + t.split("\n")[-1:]
    assert got == {i: None if t is None else cut(t) for i, t in enumerate(given)}


def test_passages_get_their_overlaps(spark):
    segments = [(c, a, a + 4, f"s{a:02} ") for c in range(3) for a in range(0, 40, 4)]
    passages = [(c, k, a, a + 8) for c in range(3) for k, a in enumerate(range(0, 40, 8))]
    overlaps = [(c, a, a + n) for c in range(3) for a, n in ((0, 3), (9, 4), (6, 4), (30, 2), (33, 7))]
    frames = [spark.createDataFrame(rows, f"chapter_idx bigint, {names}") for rows, names in ((passages, "idx bigint, start_char bigint, end_char bigint"), (segments, "start_char bigint, end_char bigint, text string"), (overlaps, "o_start bigint, o_end bigint"))]
    rows = labels.with_overlaps(*frames).collect()
    assert len(rows) == 15
    for r in rows:
        start = 8 * r.idx
        assert r.text == f"s{start:02} s{start + 4:02} "
        assert [(o.start, o.end) for o in r.overlaps] == sorted((a - start, b - start) for c, a, b in overlaps if c == r.chapter_idx and a >= start and b <= start + 8)


def test_numbers_there_and_back(spark):
    df = spark.range(1, 4000).unionAll(spark.range(4000, 1_000_000, 7919))
    words = df.select("id", tx.number_words(texts.number_in_words(F.col("id"))).alias("n"))
    assert words.where("id <> n").count() == 0
    assert {r.w for r in spark.range(105, 106).select(texts.number_in_words(F.col("id")).alias("w")).collect()} == {"one hundred and five"}
    numerals = spark.range(1, 4000).select("id", texts.roman_of(F.col("id")).alias("r"))
    assert numerals.where(tx.roman_number(F.col("r")) != F.col("id")).count() == 0
    assert numerals.where("id = 1994").first().r == "MCMXCIV"


def test_resolved_titles(spark):
    names = "book_id string, chapter_idx bigint, title string"
    a = spark.createDataFrame([("b", 1, "THE START"), ("b", 2, "Middle"), ("b", 3, "The End"), ("c", 1, "THE START"), ("b", 4, "Same"), ("b", 5, "")], names)
    b = spark.createDataFrame([("b", 1, "The Start"), ("b", 2, "Middle Part"), ("b", 3, "END"), ("c", 2, "The Start"), ("b", 4, "Same"), ("b", 5, "Long")], names)
    assert {tuple(r) for r in texts.resolved(a, b).collect()} == {("b", 1, "THE START", "The Start"), ("b", 2, "Middle", "Middle Part"), ("b", 5, "", "Long")}
    assert {tuple(r) for r in texts.resolved(b, a).collect()} == {("b", 3, "END", "The End")}


def test_short_ngrams(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r.g for r in rows.select(tx.ngrams(F.col("w"), 2).alias("g")).collect()] == [["a b", "b c"], [], []]


def test_subword_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from spanloom.operators import models

    path, rows = public_tokenizers.path("byte_bpe_50k.json"), [(1, "Hello there", None), (2, "<|endoftext|> x", "a b c")]
    one = Tokenizer.from_file(path)
    one.encode_special_tokens = True
    got = {r.i: (r.n, r.m) for r in models.token_counts(spark.createDataFrame(rows, "i int, a string, b string"), {"a": "n", "b": "m"}, models.library_tokenizer(path)).collect()}
    assert got == {i: (len(one.encode(a).ids), len(one.encode(b or "").ids)) for i, a, b in rows}

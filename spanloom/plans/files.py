"""Queries that write a layout and read it back through the data source, and reports that are written by book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import metrics, models, rouge
from spanloom.plans.fixtures import CHAPTER, Fixtures
from spanloom.plans.labels import JOINED, RUNS, ext4_runs
from spanloom.plans.measures import VERSION_COUNTS, version_edits, versions
from spanloom.plans.registry import query
from spanloom.plans.sequential import shared_place
from spanloom.plans.texts import BOOKS, p1
from spanloom.sources import layouts, readers, writers


def by_place(x: str, value: str) -> Column:
    """Values of a group in the order of x."""
    return F.transform(F.array_sort(F.collect_list(F.struct(x, F.col(value).alias("v")))), lambda s: s["v"])


@query("src2_books_from_files", "SELECT book_id, chapter_idx, CAST(length(original) AS BIGINT) AS size FROM chapters WHERE book_id IN ('src3', 'src11')")
def src2_files(fx: Fixtures) -> DataFrame:
    """Two books of the corpus: the others' files are not opened."""
    path = shared_place(fx, "texts")
    writers.write_json(fx.chapters.withColumnRenamed("original", "text"), path)
    return layouts.read(fx.spark, path, "texts", ["src3", "src11"]).select(*CHAPTER, F.length("text").cast("bigint").alias("size"))


@query("src3_chapters_from_files", "SELECT book_id, chapter_idx, md5(original) AS digest FROM chapters")
def src3_files(fx: Fixtures) -> DataFrame:
    path = shared_place(fx, "texts")
    writers.write_json(fx.chapters.withColumnRenamed("original", "text"), path)
    return layouts.read(fx.spark, path, "texts").select(*CHAPTER, F.md5("text").alias("digest"))


@query("src6_segments_from_files", "SELECT book_id, chapter_idx, seg_idx + 1 AS seg_num, par_idx + 1 AS paragraph_num, text FROM segments")
def src6_files(fx: Fixtures) -> DataFrame:
    """Every other chapter in the older layout, with indices from 0 and sentences."""
    listed = fx.nested.withColumn("old", F.col("chapter_idx") % 2 == 0)
    new = lambda c, x: F.when(~F.col("old"), x).alias(c)
    old = lambda c, x: F.when(F.col("old"), x).alias(c)
    path = shared_place(fx, "segments")
    writers.write_json(listed.select(*CHAPTER, new("paragraph_nums", F.transform("pars", lambda p: p + 1)), new("segments", F.col("segments")), old("paragraph_idxs", F.col("pars")), old("sentences", F.col("segments"))), path)
    read = layouts.read(fx.spark, path, "segments").select(*CHAPTER, F.posexplode(F.arrays_zip(F.col("paragraph_nums").alias("n"), F.col("segments").alias("t"))).alias("p", "s"))
    return read.select(*CHAPTER, (F.col("p") + 1).cast("bigint").alias("seg_num"), F.col("s.n").alias("paragraph_num"), F.col("s.t").alias("text"))


@query("src7_alignments_from_files", "SELECT book_id, chapter_idx, row, array_to_string(original_nums, ',') AS original_nums, array_to_string(abridged_nums, ',') AS abridged_nums FROM grouped")
def src7_files(fx: Fixtures) -> DataFrame:
    """Segment numbers are not in the files: they count on through a chapter."""
    path = shared_place(fx, "alignments")
    sides = [by_place("row", c).alias(c) for c in ("original_segments", "abridged_segments")]
    writers.write_json(fx.grouped.groupBy(*CHAPTER).agg(*sides), path)
    zipped = F.arrays_zip(F.col("original_segments").alias("original_segments"), F.col("abridged_segments").alias("abridged_segments"))
    rows = layouts.read(fx.spark, path, "alignments").select(*CHAPTER, F.posexplode(zipped).alias("row", "r")).select(*CHAPTER, F.col("row").cast("bigint").alias("row"), "r.*")
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return readers.nums_from_segments(rows).select(*CHAPTER, "row", listed("original_nums"), listed("abridged_nums"))


SHEET_SQL = "list_transform({0}_segments, lambda s, i: '[' || {0}_nums[i] || '] ' || s)"


@query("src9_sheets_from_files", f"SELECT book_id, chapter_idx, row, 'v' || (chapter_idx % 3) AS validator, md5(array_to_string({SHEET_SQL.format('original')}, chr(10))) AS original, md5(array_to_string({SHEET_SQL.format('abridged')}, chr(10))) AS abridged FROM grouped")
def src9_files(fx: Fixtures) -> DataFrame:
    """Review sheets of three validators, named by their folders."""
    cell = lambda side: writers.sheet_cell(F.col(f"{side}_nums"), F.col(f"{side}_segments"), "\n")
    path = shared_place(fx, "sheets")
    sheet = fx.grouped.select(*CHAPTER, F.concat(F.lit("v"), (F.col("chapter_idx") % 3).cast("string")).alias("validator"), "row", cell("original").alias("Original_Segments"), cell("abridged").alias("Abridged_Segments"))
    writers.write_sheets(sheet, path)
    digest = lambda c: F.md5(F.coalesce(c, F.lit("")))
    return layouts.read(fx.spark, path, "sheets").select(*CHAPTER, "row", "validator", digest("Original_Segments").alias("original"), digest("Abridged_Segments").alias("abridged"))


@query("src10_predictions_from_files", "SELECT book_id, chapter_idx, count(*) AS n_labels, CAST(sum(CAST(NOT kept AS INT)) AS BIGINT) AS n_removed, md5(string_agg(text, '|' ORDER BY seg_idx)) AS digest FROM rated WHERE rater = 19 GROUP BY ALL")
def src10_files(fx: Fixtures) -> DataFrame:
    path = shared_place(fx, "predictions")
    label = F.transform("segments", lambda _, i: F.when((F.col("chapter_idx") * 31 + i * 19) % 10 < 6, 0).otherwise(1))
    writers.write_json(fx.nested.select(*CHAPTER, F.col("segments").alias("tokens"), label.alias("predicted_labels")), path)
    read = layouts.read(fx.spark, path, "predictions")
    return read.select(*CHAPTER, F.size("predicted_labels").cast("bigint").alias("n_labels"), F.aggregate("predicted_labels", F.lit(0).cast("bigint"), lambda a, y: a + y).alias("n_removed"), F.md5(F.array_join("tokens", "|")).alias("digest"))


@query("snk9_extracted_abridgements", f"{RUNS}, j AS ({JOINED}) SELECT book_id, chapter_idx, extract AS predicted_abridgement FROM j JOIN chapters USING (chapter_idx)")
def snk9_extracts(fx: Fixtures) -> DataFrame:
    path = shared_place(fx, "extracts")
    named = ext4_runs(fx).join(fx.chapters.select(*CHAPTER), "chapter_idx")
    writers.write_json(named.select(*CHAPTER, F.col("extract").alias("predicted_abridgement")), path)
    return fx.spark.read.schema("book_id string, chapter_idx bigint, predicted_abridgement string").json(path)


@query("p2_records_of_headings", f"{BOOKS} SELECT chapter_idx, n - 1 AS pos, (n + 3) // 4 AS book_num, 'Part ' || ((n + 3) // 4) AS book_title, CAST(NULL AS BIGINT) AS number, '' AS title, '' AS text FROM p")
def p2_headings(fx: Fixtures) -> DataFrame:
    """The record that each heading of a book opens: its section's number and title, the rest still empty."""
    return p1(fx).select("chapter_idx", "pos", "book_num", "book_title", F.lit(None).cast("bigint").alias("number"), F.lit("").alias("title"), F.lit("").alias("text"))


MEASURES = ["n_orig_words", "n_abrg_words", "n_orig_pars", "n_abrg_pars", "n_orig_sents", "n_abrg_sents", "n_align_rows"]
REPORT = f"""WITH sz AS (SELECT c.book_id, c.chapter_idx, len(regexp_extract_all(lower(original), '[a-z0-9]+')) AS n_orig_words, len(regexp_extract_all(lower(abridged), '[a-z0-9]+')) AS n_abrg_words,
  n_orig_pars, n_abrg_pars, n_orig_sents, n_abrg_sents, n_align_rows FROM chapters c JOIN (SELECT * FROM versions WHERE rater = 17) v USING (chapter_idx)
  JOIN (SELECT chapter_idx, count(DISTINCT par_idx) AS n_orig_pars, count(DISTINCT par_idx) FILTER (kept) AS n_abrg_pars, count(*) AS n_orig_sents, count(*) FILTER (kept) AS n_abrg_sents, count(DISTINCT seg_idx // 2) AS n_align_rows FROM rws GROUP BY ALL) s USING (chapter_idx))
SELECT coalesce(book_id, 'all') AS book_id, count(*) AS n_chapters, {", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}, round(avg({m}), 0) AS mean_{m}, round(CAST(median({m}) AS DOUBLE), 0) AS median_{m}" for m in MEASURES)},
  round(sum(n_abrg_words) / sum(n_orig_words), 3) AS percent_words, round(sum(n_abrg_sents) / sum(n_orig_sents), 3) AS percent_sents FROM sz GROUP BY GROUPING SETS ((book_id), ())"""


def chapter_measures(fx: Fixtures) -> DataFrame:
    """All sizes of both versions, each from its chapter's row."""
    n = lambda x: F.size(x).cast("bigint")
    words = lambda c: n(tx.words(F.array_join(c, "")))
    return fx.pairs(17).select(*CHAPTER, words("source").alias("n_orig_words"), words("target").alias("n_abrg_words"), n(F.array_distinct("source_par")).alias("n_orig_pars"), n(F.array_distinct("target_par")).alias("n_abrg_pars"),
                               n("source").alias("n_orig_sents"), n("target").alias("n_abrg_sents"), F.floor((F.size("source") + 1) / 2).cast("bigint").alias("n_align_rows"))


@query("agg6_size_report", REPORT)
def agg6_report(fx: Fixtures) -> DataFrame:
    """Sums, means, medians and shares of all sizes, by book and for all."""
    three = [x for m in MEASURES for x in (F.sum(m).alias(m), F.round(F.avg(m), 0).alias(f"mean_{m}"), F.round(F.median(m), 0).alias(f"median_{m}"))]
    share = lambda a, b: F.round(F.sum(a) / F.sum(b), 3)
    found = chapter_measures(fx).groupingSets([["book_id"], []], "book_id").agg(F.count("*").alias("n_chapters"), *three, share("n_abrg_words", "n_orig_words").alias("percent_words"), share("n_abrg_sents", "n_orig_sents").alias("percent_sents"))
    return found.withColumn("book_id", F.coalesce("book_id", F.lit("all")))


@query("agg4_subword_tokens")
def agg4_subwords(fx: Fixtures) -> DataFrame:
    """Subword tokens of both versions by a tokenizer that is injected; its file is a parameter."""
    import public_tokenizers

    both = fx.pairs(17).select("chapter_idx", F.array_join("source", "").alias("original"), F.array_join("target", "").alias("abridged"))
    return models.token_counts(both, {"original": "n_orig_toks", "abridged": "n_abrg_toks"}, models.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))).select("chapter_idx", "n_orig_toks", "n_abrg_toks")


SCORED = ("removed", "preserved", "added")
NAMES = dict(zip(SCORED, ("removal", "preservation", "addition"), strict=True))


def all_scores(fx: Fixtures) -> DataFrame:
    """book_id, chapter_idx, and precision, recall and F1 of removal, preservation and addition; both versions' lengths in words."""
    found, columns = version_edits(fx), []
    for name in SCORED:
        p, r = metrics.shares(F.col(f"{name}_p"), F.col(f"{name}_r"), F.col(f"{name}_both"))
        columns += [p.alias(f"{NAMES[name]}_precision"), r.alias(f"{NAMES[name]}_recall"), tx.f_score(p, r).alias(f"{NAMES[name]}_f1")]
    lengths = versions(fx).select("chapter_idx", *[F.size(tx.words(F.col(a))).cast("bigint").alias(b) for a, b in (("predicted", "pred_length"), ("reference", "ref_length"))])
    return found.select("chapter_idx", *columns).join(lengths, "chapter_idx").join(fx.chapters.select(*CHAPTER), "chapter_idx")


def shares_sql(name: str) -> str:
    p, r = (f"CASE WHEN {name}_{a} > 0 THEN {name}_both / {name}_{a} WHEN {name}_{b} > 0 THEN 0.0 ELSE 1.0 END" for a, b in (("p", "r"), ("r", "p")))
    return f"CAST({p} AS DOUBLE) AS {NAMES[name]}_precision, CAST({r} AS DOUBLE) AS {NAMES[name]}_recall"


SCORES = f"""{VERSION_COUNTS}, s AS (SELECT chapter_idx, {", ".join(map(shares_sql, SCORED))} FROM ed), n AS (SELECT chapter_idx, max(len(regexp_extract_all(lower(abridged), '[a-z0-9]+'))) FILTER (rater = 19) AS pred_length, max(len(regexp_extract_all(lower(abridged), '[a-z0-9]+'))) FILTER (rater = 17) AS ref_length FROM versions GROUP BY ALL),
f AS (SELECT *, {", ".join(f"CASE WHEN {x}_precision + {x}_recall > 0 THEN 2 * {x}_precision * {x}_recall / ({x}_precision + {x}_recall) ELSE 0.0 END AS {x}_f1" for x in NAMES.values())} FROM s JOIN n USING (chapter_idx) JOIN chapters USING (chapter_idx)),
m AS (SELECT coalesce(book_id, 'all') AS book_id, {{means}} FROM f GROUP BY GROUPING SETS ((book_id), ()))"""
SCORE_NAMES = [f"{x}_{m}" for x in NAMES.values() for m in ("precision", "recall", "f1")] + ["pred_length", "ref_length"]
MEANS = ", ".join(f"round(avg({c}), 3) AS {c}" for c in SCORE_NAMES)


def mean_scores(fx: Fixtures) -> DataFrame:
    """All scores' means by book and for all, to three digits."""
    found = all_scores(fx).groupingSets([["book_id"], []], "book_id").agg(*[F.round(F.avg(c), 3).alias(c) for c in SCORE_NAMES])
    return found.withColumn("book_id", F.coalesce("book_id", F.lit("all")))


query("agg19_all_mean_scores", f"{SCORES.format(means=MEANS)} SELECT * FROM m")(mean_scores)


@query("agg19_mean_rouge_l")
def agg19_rouge(fx: Fixtures) -> DataFrame:
    named = rouge.rouge_l(versions(fx), "chapter_idx").join(fx.chapters.select(*CHAPTER), "chapter_idx")
    means = named.groupingSets([["book_id"], []], "book_id").agg(*[F.round(F.avg(c), 3).alias(c) for c in ("precision", "recall", "f1")])
    return means.withColumn("book_id", F.coalesce("book_id", F.lit("all")))


@query("snk5_score_json", f"{SCORES.format(means=MEANS)} SELECT * FROM m")
def snk5_json(fx: Fixtures) -> DataFrame:
    """Scores by book and `all` as JSON, an object a line that its book names, and read back."""
    path = shared_place(fx, "scores")
    writers.write_score_json(mean_scores(fx), path)
    fields = ", ".join(f"{c}:double" for c in SCORE_NAMES).replace(", ", ",")
    read = fx.spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,struct<{fields}>>")).alias("book_id", "s"))
    return read.select("book_id", "s.*")

"""Queries over passages: scans, lookups, passage generation, chunks, spans of the short text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import abridgements, chunks
from spanloom.operators.containment import contained, least_behind
from spanloom.plans.fixtures import CHAPTER, Fixtures, keeps
from spanloom.plans.registry import query

KEY = "book_id, chapter_idx"
#: Chapter numbers that share a row of a book's list.
LISTED = 1 << 16


def paragraphs_with_counts(fx: Fixtures) -> DataFrame:
    """A paragraph's segments tile it, so containment is equality of the paragraph: counted with the segments, one shuffle."""
    n = fx.segments.groupBy("chapter_idx", "par_idx").agg(F.count("*").alias("n_sentences"))
    return fx.paragraphs.join(n, ["chapter_idx", "par_idx"], "left").select(*CHAPTER, F.col("par_idx").alias("idx"), F.coalesce("n_sentences", F.lit(0)).cast("bigint").alias("n_sentences"), "start_char", "end_char", "text")


IN_PAR = "JOIN segments s ON s.chapter_idx = p.chapter_idx AND s.start_char >= p.start_char AND s.end_char <= p.end_char"

query("gen2_paragraphs_with_sentence_counts", """SELECT p.book_id, p.chapter_idx, p.par_idx AS idx, (SELECT count(*) FROM segments s WHERE s.chapter_idx = p.chapter_idx AND s.par_idx = p.par_idx) AS n_sentences,
  p.start_char, p.end_char, p.text FROM paragraphs p""")(paragraphs_with_counts)


@query("src1_metadata", f"SELECT book_id, 'Book of ' || book_id AS book_title, 'unknown' AS author, chapter_idx, 'Chapter ' || (chapter_idx + 1) AS chapter_title FROM chapters")
def src1(fx: Fixtures) -> DataFrame:
    from spanloom.sources.readers import metadata_rows

    # a book's list in rows of bounded size: one for each block of chapter numbers
    listed = fx.chapters.groupBy("book_id", F.floor(F.col("chapter_idx") / LISTED).alias("block")).agg(F.array_sort(F.collect_list("chapter_idx")).alias("idxs"))
    titles = F.transform("idxs", lambda i: F.concat(F.lit("Chapter "), (i + 1).cast("string")))
    as_json = listed.select(F.to_json(F.map_from_arrays(F.array("book_id"), F.array(F.struct(F.concat(F.lit("Book of "), "book_id").alias("book_title"), F.lit("unknown").alias("author"), titles.alias("listed_titles"), F.col("idxs").alias("chapter_idxs"))))).alias("value"))
    return metadata_rows(as_json)


@query("src2_split_selection", f"SELECT {KEY} FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_idx) AS r FROM chapters) WHERE r = 1")
def src2(fx: Fixtures) -> DataFrame:
    dev = fx.chapters.groupBy("book_id").agg(F.min("chapter_idx").alias("dev"))
    return fx.chapters.join(dev, "book_id").where("chapter_idx = dev").select(*CHAPTER)


@query("src3_chapter_keys", f"SELECT {KEY} FROM chapters")
def src3(fx: Fixtures) -> DataFrame:
    from spanloom.sources.readers import chapter_key

    path = F.concat_ws("/", F.lit("corpus"), "book_id", F.concat(F.col("chapter_idx").cast("string"), F.lit(".json")))
    return fx.chapters.select(*chapter_key(path))


@query("src4_plain_chapter_lines", "SELECT doc_id AS chapter_idx, unnest(range(len(p))) AS par_idx, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def src4(fx: Fixtures) -> DataFrame:
    return fx.chapters.select("chapter_idx", F.posexplode(F.split("original", "\n", -1)).alias("par_idx", "line")).withColumn("par_idx", F.col("par_idx").cast("bigint"))


@query("src5_blank_line_paragraphs", r"""SELECT doc_id AS chapter_idx, CAST(len(p) AS BIGINT) AS n_paragraphs, CAST(length(p[1]) AS BIGINT) AS first_length FROM (
  SELECT doc_id, list_transform(string_split(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda x: regexp_replace(x, '\n+', ' ', 'g')) AS p FROM documents)""")
def src5(fx: Fixtures) -> DataFrame:
    p = tx.blank_line_paragraphs(F.col("original"))
    return fx.chapters.select("chapter_idx", F.size(p).cast("bigint").alias("n_paragraphs"), F.length(F.get(p, 0)).cast("bigint").alias("first_length"))


@query("src6_segments_from_legacy_indices", f"SELECT {KEY}, seg_idx, par_idx + 1 AS paragraph_num FROM segments")
def src6(fx: Fixtures) -> DataFrame:
    from spanloom.sources.readers import paragraph_nums

    old = fx.segments.groupBy(*CHAPTER).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "par_idx"))), lambda s: s["par_idx"]).alias("paragraph_idxs")).withColumn("paragraph_nums", F.lit(None).cast("array<bigint>"))
    return old.select(*CHAPTER, F.posexplode(paragraph_nums()).alias("seg_idx", "paragraph_num")).withColumn("seg_idx", F.col("seg_idx").cast("bigint"))


@query("src7_alignment_nums_by_running_count", "SELECT chapter_idx, row, original_nums[1] AS first_num, CAST(len(original_nums) AS BIGINT) AS n_original, CAST(len(abridged_nums) AS BIGINT) AS n_abridged FROM grouped")
def src7(fx: Fixtures) -> DataFrame:
    from spanloom.sources.readers import nums_from_segments

    bare = fx.grouped.select(*CHAPTER, "row", "original_segments", "abridged_segments")
    return nums_from_segments(bare).select("chapter_idx", "row", F.get("original_nums", 0).alias("first_num"), F.size("original_nums").cast("bigint").alias("n_original"), F.size("abridged_nums").cast("bigint").alias("n_abridged"))


@query("src8_columnar_to_rows", "SELECT chapter_idx, seg_idx, par_idx, CAST(length(text) AS BIGINT) AS size FROM segments")
def src8(fx: Fixtures) -> DataFrame:
    packed = fx.segments.groupBy("chapter_idx").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "par_idx", F.length("text").alias("size")))).alias("s"))
    columns = packed.select("chapter_idx", F.transform("s", lambda x: x["seg_idx"]).alias("seg_idx"), F.transform("s", lambda x: x["par_idx"]).alias("par_idx"), F.transform("s", lambda x: x["size"]).alias("size"))
    return columns.select("chapter_idx", F.inline(F.arrays_zip("seg_idx", "par_idx", "size"))).withColumn("size", F.col("size").cast("bigint"))


@query("src9_sheet_name_parts", "SELECT chapter_idx, book_id AS sheet_book, 'v' || (chapter_idx % 3) AS validator FROM chapters")
def src9(fx: Fixtures) -> DataFrame:
    from spanloom.sources.readers import sheet_validator

    name = F.concat_ws(".", "book_id", F.col("chapter_idx").cast("string"), F.lit("alignment"), F.lit("sheet"), F.concat(F.lit("v"), (F.col("chapter_idx") % 3).cast("string")), F.lit("csv"))
    return fx.chapters.select("chapter_idx", F.split(name, "\\.")[0].alias("sheet_book"), sheet_validator(name).alias("validator"))


@query("src10_predictions_from_json_lines", "SELECT chapter_idx, CAST(sum(CASE WHEN kept THEN 0 ELSE 1 END) AS BIGINT) AS n_removed, count(*) AS n_labels FROM rws GROUP BY chapter_idx")
def src10(fx: Fixtures) -> DataFrame:
    labels = fx.rows.groupBy("chapter_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.when(F.col("kept"), 0).otherwise(1).alias("y")))), lambda s: s["y"]).alias("predicted_labels"))
    read = labels.select("chapter_idx", F.from_json(F.to_json(F.struct("predicted_labels")), "predicted_labels array<int>").alias("j"))
    return read.select("chapter_idx", F.aggregate("j.predicted_labels", F.lit(0).cast("bigint"), lambda a, y: a + y).alias("n_removed"), F.size("j.predicted_labels").cast("bigint").alias("n_labels"))


@query("src13_passages_by_chapter", f"SELECT {KEY}, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size FROM paragraphs GROUP BY ALL")
def src13(fx: Fixtures) -> DataFrame:
    listed = fx.paragraphs.groupBy(*CHAPTER).agg(F.array_sort(F.collect_list(F.struct("par_idx", "text"))).alias("passages"))
    return listed.select(*CHAPTER, F.size("passages").cast("bigint").alias("n"), F.aggregate("passages", F.lit(0).cast("bigint"), lambda a, p: a + F.length(p["text"])).alias("size"))


@query("src14_gold_and_predicted_by_position", "SELECT chapter_idx, seg_idx, max(CAST(NOT kept AS INT)) FILTER (rater = 17) AS gold, max(CAST(NOT kept AS INT)) FILTER (rater = 19) AS predicted FROM rated GROUP BY chapter_idx, seg_idx")
def src14(fx: Fixtures) -> DataFrame:
    return fx.segments.select("chapter_idx", "seg_idx", (~keeps(17)).cast("int").alias("gold"), (~keeps(19)).cast("int").alias("predicted"))


@query("flt1_one_book", "SELECT chapter_idx FROM chapters WHERE book_id = 'src3'")
def flt1(fx: Fixtures) -> DataFrame:
    return fx.chapters.where(F.col("book_id") == "src3").select("chapter_idx")


@query("flt2_one_chapter", f"SELECT {KEY}, CAST(length(original) AS BIGINT) AS size FROM chapters WHERE chapter_idx = 7")
def flt2(fx: Fixtures) -> DataFrame:
    return fx.chapters.where("chapter_idx = 7").select(*CHAPTER, F.length("original").cast("bigint").alias("size"))


@query("flt3_sentences_in_passage", "SELECT chapter_idx, seg_idx FROM segments WHERE start_char >= 100 AND end_char <= 900")
def flt3(fx: Fixtures) -> DataFrame:
    return fx.segments.where("start_char >= 100 AND end_char <= 900").select("chapter_idx", "seg_idx")


@query("flt4_sentences_per_row", "SELECT chapter_idx, row, CAST(len(original_segments) AS BIGINT) AS n_sentences FROM grouped")
def flt4(fx: Fixtures) -> DataFrame:
    pairs = fx.segments.groupBy("chapter_idx", F.floor(F.col("seg_idx") / 2).cast("bigint").alias("row")).agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))
    spans = fx.segments.select("chapter_idx", "start_char", "end_char")
    return contained(spans, pairs).groupBy("chapter_idx", F.col("outer.row").alias("row")).agg(F.count("*").alias("n_sentences"))


OV_PAR = "SELECT p.chapter_idx, p.par_idx AS idx, o.pos, o.o_start, o.o_end, o.a_start, o.a_end, o.o_start >= p.start_char AND o.o_end <= p.end_char AS inside, o.o_start >= p.end_char AS beyond FROM paragraphs p JOIN reordered o USING (chapter_idx)"


def numbered_paragraphs(fx: Fixtures) -> DataFrame:
    return fx.paragraphs.select("chapter_idx", F.col("par_idx").alias("idx"), "start_char", "end_char")


def overlaps_by_paragraph(fx: Fixtures) -> DataFrame:
    """chapter_idx, idx, pos, o_start, o_end, a_start, a_end of the overlaps in each paragraph, with the paragraph's end_char"""
    found = contained(fx.reordered.drop("book_id"), numbered_paragraphs(fx), inner_span=("o_start", "o_end"))
    return found.select("chapter_idx", "outer.idx", "outer.end_char", *[f"inner.{c}" for c in ("pos", "o_start", "o_end", "a_start", "a_end")])


@query("flt5_overlaps_until_first_beyond", f"""WITH op AS ({OV_PAR}), stop AS (SELECT chapter_idx, idx, min(pos) AS stop FROM op WHERE beyond GROUP BY ALL)
  SELECT chapter_idx, idx, count(*) AS n_overlaps, min(o_start) AS first_start, max(o_end) AS last_end FROM op LEFT JOIN stop USING (chapter_idx, idx) WHERE inside AND (stop IS NULL OR pos < stop) GROUP BY ALL""")
def flt5(fx: Fixtures) -> DataFrame:
    """The scan of a passage stops at the first overlap in list order that starts behind it, so reordered later ones are lost."""
    starts = fx.reordered.select("chapter_idx", F.col("o_start").alias("at"), "pos")
    stops = least_behind(starts, numbered_paragraphs(fx).select("chapter_idx", "idx", F.col("end_char").alias("at")), "pos")
    kept = overlaps_by_paragraph(fx).join(stops.select("chapter_idx", "idx", "least"), ["chapter_idx", "idx"]).where("least IS NULL OR pos < least")
    return kept.groupBy("chapter_idx", "idx").agg(F.count("*").alias("n_overlaps"), F.min("o_start").alias("first_start"), F.max("o_end").alias("last_end"))


@query("flt6_overlaps_of_all_passages", f"WITH op AS ({OV_PAR}) SELECT chapter_idx, idx, count(*) AS n_overlaps FROM op WHERE inside GROUP BY ALL")
def flt6(fx: Fixtures) -> DataFrame:
    return overlaps_by_paragraph(fx).groupBy("chapter_idx", "idx").agg(F.count("*").alias("n_overlaps"))


@query("flt7_abridged_spans_of_passages", f"WITH op AS ({OV_PAR}) SELECT p.chapter_idx, p.par_idx AS idx, min(a_start) AS first_start, max(a_end) AS last_end FROM paragraphs p LEFT JOIN op ON op.chapter_idx = p.chapter_idx AND op.idx = p.par_idx AND inside GROUP BY ALL")
def flt7(fx: Fixtures) -> DataFrame:
    found = overlaps_by_paragraph(fx).groupBy("chapter_idx", "idx").agg(F.min("a_start").alias("first_start"), F.max("a_end").alias("last_end"))
    return fx.paragraphs.select("chapter_idx", F.col("par_idx").alias("idx")).join(found, ["chapter_idx", "idx"], "left")


@query("flt8_overlaps_of_chapters", "SELECT chapter_idx, count(*) AS n_overlaps FROM ovl GROUP BY ALL")
def flt8(fx: Fixtures) -> DataFrame:
    return fx.overlaps.groupBy("chapter_idx").agg(F.count("*").alias("n_overlaps"))


@query("prj1_text_slices", "SELECT chapter_idx, seg_idx, text FROM segments")
def prj1(fx: Fixtures) -> DataFrame:
    spans = fx.segments.select("chapter_idx", "seg_idx", "start_char", "end_char")
    return spans.join(fx.chapters.select("chapter_idx", "original"), "chapter_idx").select("chapter_idx", "seg_idx", tx.slice_of(F.col("original"), F.col("start_char"), F.col("end_char")).alias("text"))


@query("prj2_chapter_extents", "SELECT chapter_idx, CAST(0 AS BIGINT) AS original_start_char, CAST(length(original) AS BIGINT) AS original_end_char, CAST(length(abridged) AS BIGINT) AS abridged_end_char FROM chapters JOIN versions USING (chapter_idx) WHERE rater = 17")
def prj2(fx: Fixtures) -> DataFrame:
    size = lambda c: F.length(c).cast("bigint")
    return fx.chapters.join(fx.abridged(17).drop("book_id"), "chapter_idx").select("chapter_idx", F.lit(0).cast("bigint").alias("original_start_char"), size("original").alias("original_end_char"), size("abridged").alias("abridged_end_char"))


@query("prj3_shown_texts", "SELECT chapter_idx, substr(original, 1, 1000) || CASE WHEN length(original) > 1000 THEN '...' ELSE '' END AS shown FROM chapters")
def prj3(fx: Fixtures) -> DataFrame:
    return fx.chapters.select("chapter_idx", tx.shown(F.col("original")).alias("shown"))


@query("gen1_sentences", f"SELECT {KEY}, seg_idx AS idx, start_char, end_char, text FROM segments")
def gen1(fx: Fixtures) -> DataFrame:
    return fx.segments.select(*CHAPTER, F.col("seg_idx").alias("idx"), "start_char", "end_char", "text")


@query("gen3_row_spans", "SELECT chapter_idx, seg_idx AS idx, a_start AS start_char, a_end AS end_char, abridged AS text FROM rws")
def gen3(fx: Fixtures) -> DataFrame:
    return fx.rows.select("chapter_idx", F.col("seg_idx").alias("idx"), F.col("a_start").alias("start_char"), F.col("a_end").alias("end_char"), F.col("abridged").alias("text"))


@query("gen8_paired_rows", "SELECT chapter_idx, seg_idx AS idx, start_char AS original_start_char, end_char AS original_end_char, text AS original, a_start AS abridged_start_char, a_end AS abridged_end_char, abridged, CAST(1 AS BIGINT) AS n_original_sentences, CAST(kept AS BIGINT) AS n_abridged_sentences FROM rws")
def gen8(fx: Fixtures) -> DataFrame:
    return fx.rows.select("chapter_idx", F.col("seg_idx").alias("idx"), F.col("start_char").alias("original_start_char"), F.col("end_char").alias("original_end_char"), F.col("text").alias("original"), F.col("a_start").alias("abridged_start_char"), F.col("a_end").alias("abridged_end_char"), "abridged", F.lit(1).cast("bigint").alias("n_original_sentences"), F.col("kept").cast("bigint").alias("n_abridged_sentences"))


@query("chk6_paragraph_split", f"SELECT {KEY}, par_idx, start_char, end_char, text FROM paragraphs")
def chk6(fx: Fixtures) -> DataFrame:
    return fx.paragraphs.select(*CHAPTER, "par_idx", "start_char", "end_char", "text")


def window_sql(extra: str = "") -> str:
    return f"""SELECT chapter_idx, seg_idx AS i, w AS window_size, md5(string_agg(text, '' ORDER BY k)) AS digest FROM (
  SELECT s.chapter_idx, s.seg_idx, w, t.seg_idx AS k, t.text FROM segments s, (SELECT unnest([1, 2, 3, 4]) AS w) JOIN segments t ON t.chapter_idx = s.chapter_idx AND t.seg_idx BETWEEN s.seg_idx AND s.seg_idx + w - 1{extra}) GROUP BY ALL"""


@query("chk7_sliding_windows", window_sql())
def chk7(fx: Fixtures) -> DataFrame:
    """Every window of 1 to 4 segments: one window function per size over one sort by chapter."""
    order = Window.partitionBy("chapter_idx").orderBy("seg_idx")
    joined = [F.array_join(F.collect_list("text").over(order.rowsBetween(0, w - 1)), "") for w in (1, 2, 3, 4)]
    wide = fx.segments.select("chapter_idx", F.col("seg_idx").alias("i"), F.array(*[F.md5(j) for j in joined]).alias("d"))
    return wide.select("chapter_idx", "i", F.posexplode("d").alias("p", "digest")).select("chapter_idx", "i", (F.col("p") + 1).alias("window_size"), "digest")


#: Chunks by a fold over a chapter's paragraphs: pc counts sentences, fold numbers chunks.
PAR_COUNTS = "WITH pc AS (SELECT book_id, chapter_idx, par_idx, min(seg_idx) AS f, count(*) AS n, row_number() OVER (PARTITION BY chapter_idx ORDER BY par_idx) AS i, max(par_idx) OVER (PARTITION BY chapter_idx) AS last_par FROM segments GROUP BY book_id, chapter_idx, par_idx)"
START = "SELECT DISTINCT chapter_idx, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS first_c, CAST(-1 AS BIGINT) AS c, CAST(0 AS BIGINT) AS size FROM pc UNION ALL"
NEXT = "FROM fold JOIN pc ON pc.chapter_idx = fold.chapter_idx AND pc.i = fold.i + 1"
MADE = "made AS (SELECT book_id, chapter_idx, idx, min(par_idx) AS first_par, max(par_idx) AS last_par, count(*) AS n_sentences, min(start_char) AS start_char, max(end_char) AS end_char FROM placed GROUP BY ALL)"


def max_chunks_sql(most: int) -> str:
    joins = f"c >= 0 AND n <= {most} AND size + n <= {most}"
    return f"""{PAR_COUNTS}, fold AS ({START} SELECT pc.chapter_idx, pc.i, CASE WHEN {joins} THEN c ELSE c + 1 END, CASE WHEN {joins} THEN c ELSE c + 1 + (n - 1) // {most} END, CASE WHEN {joins} THEN size + n ELSE n - (n - 1) // {most} * {most} END {NEXT}),
placed AS (SELECT s.*, first_c + (seg_idx - f) // {most} AS idx FROM segments s JOIN pc USING (chapter_idx, par_idx) JOIN fold ON fold.chapter_idx = s.chapter_idx AND fold.i = pc.i), {MADE}"""


def min_chunks_sql(least: int) -> str:
    joins = f"c >= 0 AND (size < {least} OR (par_idx = last_par AND n < {least}))"
    return f"""{PAR_COUNTS}, fold AS ({START} SELECT pc.chapter_idx, pc.i, CASE WHEN {joins} THEN c ELSE c + 1 END, CASE WHEN {joins} THEN c ELSE c + 1 END, CASE WHEN {joins} THEN size + n ELSE n END {NEXT}),
sizes AS (SELECT chapter_idx, c, sum(n) AS n, max(c) OVER (PARTITION BY chapter_idx) AS last_c FROM fold JOIN pc USING (chapter_idx, i) GROUP BY chapter_idx, c),
placed AS (SELECT s.*, CASE WHEN fold.c > 0 AND fold.c = last_c AND sizes.n < {least} THEN fold.c - 1 ELSE fold.c END AS idx FROM segments s JOIN pc USING (chapter_idx, par_idx) JOIN fold ON fold.chapter_idx = s.chapter_idx AND fold.i = pc.i JOIN sizes ON sizes.chapter_idx = s.chapter_idx AND sizes.c = fold.c), {MADE}"""


ALL_CHUNKS = "SELECT * FROM made"
DIGESTS = "SELECT chapter_idx, idx, n_sentences, md5(substr(original, CAST(start_char + 1 AS BIGINT), CAST(end_char - start_char AS BIGINT))) AS digest FROM made JOIN chapters USING (chapter_idx)"


@query("chk1_max_chunks", f"{max_chunks_sql(10)} {ALL_CHUNKS}")
def chk1(fx: Fixtures) -> DataFrame:
    return chunks.chunks(fx.paragraphs, fx.segments, max_sentences=10)


@query("chk2_min_chunks", f"{min_chunks_sql(3)} {ALL_CHUNKS}")
def chk2(fx: Fixtures) -> DataFrame:
    return chunks.chunks(fx.paragraphs, fx.segments, merge_sentences=3)


@query("chk3_chunks_tile_chapters", "SELECT chapter_idx, count(*) AS n_sentences, CAST(length(original) AS BIGINT) AS covered FROM segments JOIN chapters USING (chapter_idx) GROUP BY chapter_idx, original")
def chk3(fx: Fixtures) -> DataFrame:
    """Whatever the grouping, chunks hold all sentences and all characters."""
    return chunks.chunks(fx.paragraphs, fx.segments, max_sentences=3).groupBy("chapter_idx").agg(F.sum("n_sentences").alias("n_sentences"), F.sum(F.col("end_char") - F.col("start_char")).alias("covered"))


def chunk_texts(fx: Fixtures, **how: int) -> DataFrame:
    made = chunks.chunks(fx.paragraphs, fx.segments, **how)
    return made.join(fx.chapters.drop("book_id"), "chapter_idx").select("chapter_idx", "idx", "n_sentences", F.md5(tx.slice_of(F.col("original"), F.col("start_char"), F.col("end_char"))).alias("digest"))


@query("chk4_chunk_texts", f"{min_chunks_sql(4)} {DIGESTS}")
def chk4(fx: Fixtures) -> DataFrame:
    return chunk_texts(fx, merge_sentences=4)


@query("gen4_chunks_of_one_version", f"{max_chunks_sql(5)} {DIGESTS}")
def gen4(fx: Fixtures) -> DataFrame:
    return chunk_texts(fx, max_sentences=5)


@query("chk5_split_by_passage_type", "SELECT 'segment' AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size FROM segments UNION ALL SELECT 'paragraph', count(*), CAST(sum(length(text)) AS BIGINT) FROM paragraphs UNION ALL SELECT 'chapter', count(*), CAST(sum(length(original)) AS BIGINT) FROM chapters")
def chk5(fx: Fixtures) -> DataFrame:
    kinds = (("segment", fx.segments, "text"), ("paragraph", fx.paragraphs, "text"), ("chapter", fx.chapters, "original"))
    parts = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.sum(F.length(c)).cast("bigint").alias("size")) for k, df, c in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def short_chapters(fx: Fixtures) -> DataFrame:
    """Length and sentence ends of the short versions."""
    return fx.rows.groupBy("chapter_idx").agg(F.max("a_end").alias("a_length"), F.collect_set(F.when(F.col("kept"), F.col("a_end"))).alias("a_ends"))


def inferred(fx: Fixtures, passages: DataFrame) -> DataFrame:
    return abridgements.infer(passages.select("chapter_idx", "idx", "start_char", "end_char"), fx.overlaps, short_chapters(fx))


def inferred_sql(passages: str) -> str:
    """Spans of the short text for (chapter_idx, idx, start_char, end_char). Its claims come in order and end with sentences, so each one ends where its last overlap does and the last one takes the rest."""
    return f"""WITH ps AS ({passages}), own AS (SELECT p.chapter_idx, p.idx, max(o.a_end) AS e FROM ps p LEFT JOIN ovl o ON o.chapter_idx = p.chapter_idx AND o.o_start >= p.start_char AND o.o_end <= p.end_char GROUP BY ALL),
upto AS (SELECT chapter_idx, idx, coalesce(max(e) OVER (PARTITION BY chapter_idx ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, coalesce(max(e) OVER (PARTITION BY chapter_idx ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS e, row_number() OVER (PARTITION BY chapter_idx ORDER BY idx DESC) AS r FROM own)
SELECT chapter_idx, idx, s AS abridged_start, CASE WHEN r = 1 THEN a_length ELSE e END AS abridged_end FROM upto JOIN (SELECT chapter_idx, max(a_end) AS a_length FROM rws GROUP BY ALL) USING (chapter_idx)"""


@query("gen5_paired_sentences", inferred_sql("SELECT chapter_idx, seg_idx AS idx, start_char, end_char FROM segments"))
def gen5(fx: Fixtures) -> DataFrame:
    return inferred(fx, fx.segments.withColumnRenamed("seg_idx", "idx"))


@query("gen6_paired_paragraphs", inferred_sql("SELECT chapter_idx, par_idx AS idx, start_char, end_char FROM paragraphs"))
def gen6(fx: Fixtures) -> DataFrame:
    return inferred(fx, fx.paragraphs.withColumnRenamed("par_idx", "idx"))


@query("gen7_paired_chunks", max_chunks_sql(10) + ", " + inferred_sql("SELECT chapter_idx, idx, start_char, end_char FROM made")[5:])
def gen7(fx: Fixtures) -> DataFrame:
    return inferred(fx, chunks.chunks(fx.paragraphs, fx.segments, max_sentences=10))


@query("aln1_abridgements_tile_the_short_text", "SELECT p.chapter_idx, count(*) AS n, (SELECT max(a_end) FROM rws r WHERE r.chapter_idx = p.chapter_idx) AS covered FROM paragraphs p WHERE p.chapter_idx IN (SELECT chapter_idx FROM segments) GROUP BY p.chapter_idx")
def aln1(fx: Fixtures) -> DataFrame:
    found = inferred(fx, fx.paragraphs.withColumnRenamed("par_idx", "idx"))
    return found.groupBy("chapter_idx").agg(F.count("*").alias("n"), F.sum(F.col("abridged_end") - F.col("abridged_start")).alias("covered"))


@query("aln3_claims_to_spans", "SELECT chapter_idx, par_idx AS idx, min(a_start) AS start_char, max(a_end) AS end_char FROM rws WHERE kept GROUP BY ALL")
def aln3(fx: Fixtures) -> DataFrame:
    return fx.rows.where("kept").groupBy("chapter_idx", F.col("par_idx").alias("idx")).agg(F.min("a_start").alias("start_char"), F.max("a_end").alias("end_char"))


@query("aln5_sentence_boundaries", "SELECT DISTINCT chapter_idx, a_end AS boundary FROM rws WHERE kept")
def aln5(fx: Fixtures) -> DataFrame:
    return fx.rows.where("kept").select("chapter_idx", F.col("a_end").alias("boundary")).distinct()


@query("jn1_sentences_in_paragraphs", f"SELECT p.chapter_idx, p.par_idx AS idx, count(*) AS n_sentences, min(s.seg_idx) AS first_seg FROM paragraphs p {IN_PAR} GROUP BY ALL")
def jn1(fx: Fixtures) -> DataFrame:
    spans = fx.segments.select("chapter_idx", "seg_idx", "start_char", "end_char")
    return contained(spans, numbered_paragraphs(fx)).groupBy("chapter_idx", F.col("outer.idx").alias("idx")).agg(F.count("*").alias("n_sentences"), F.min("inner.seg_idx").alias("first_seg"))


@query("jn2_overlaps_in_paragraphs", "SELECT p.chapter_idx, p.par_idx AS idx, count(*) AS n_overlaps, min(o.o_start) AS first_start, max(o.o_end) AS last_end FROM paragraphs p JOIN ovl o ON o.chapter_idx = p.chapter_idx AND o.o_start >= p.start_char AND o.o_end <= p.end_char GROUP BY ALL")
def jn2(fx: Fixtures) -> DataFrame:
    found = contained(fx.overlaps.select("chapter_idx", "o_start", "o_end"), numbered_paragraphs(fx), inner_span=("o_start", "o_end"))
    return found.groupBy("chapter_idx", F.col("outer.idx").alias("idx")).agg(F.count("*").alias("n_overlaps"), F.min("inner.o_start").alias("first_start"), F.max("inner.o_end").alias("last_end"))


@query("jn3_positional_pairs", "SELECT o.chapter_idx, o.seg_idx AS idx, o.text AS original, a.text AS abridged FROM segments o JOIN (SELECT chapter_idx, seg_idx, abridged AS text FROM rws) a USING (chapter_idx, seg_idx)")
def jn3(fx: Fixtures) -> DataFrame:
    return fx.segments.select("chapter_idx", F.col("seg_idx").alias("idx"), F.col("text").alias("original")).join(fx.rows.select("chapter_idx", F.col("seg_idx").alias("idx"), "abridged"), ["chapter_idx", "idx"])



"""Files in the old and the new layouts read alike; what is written reads back."""

import json

from pyspark.sql import functions as F

from spanloom.plans.fixtures import Fixtures
from spanloom.sources import readers, writers
from spanloom.streaming.chapters import paragraphs_stream

SF = "/root/testdata/sf0.001"


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))
    return path


def test_metadata(spark, tmp_path):
    book = {"book_title": "T", "author": "A", "chapter_titles": ["one", "two", "three"], "chapter_idxs": [0, 2], "dev_chapter_idxs": [2]}
    path = str(put(tmp_path / "meta.json", {"b": book}))
    assert [tuple(r) for r in readers.metadata(spark, path).orderBy("chapter_idx").collect()] == [("b", "T", "A", 0, "one"), ("b", "T", "A", 2, "three")]
    assert [r.chapter_idx for r in readers.metadata(spark, path, "dev").collect()] == [2]


def test_packed_chapters(spark, tmp_path):
    side = {"text": "ab cd", "paragraph_chars": [[0, 5]], "segment_chars": [[0, 3], [3, 5]], "row_chars": [[0, 5]], "overlap_chars": [[0, 2]]}
    put(tmp_path / "book" / "7.json", {"original": side, "abridged": side})
    r = readers.packed_chapters(spark, str(tmp_path / "book" / "*.json")).first()
    assert (r.book_id, r.chapter_idx, [(s.start, s.end) for s in r.original.segments]) == ("book", 7, [(0, 3), (3, 5)])


def test_packed_chapters_tile(spark, tmp_path):
    """Chapters packed by us, read back: paragraphs, segments and rows are the text again, on both sides."""
    for k in range(5):
        sides = {}
        for name in ("original", "abridged"):
            parts = [f"Ünï {name} {k} {i}. " + "\n" * (i % 3 == 2) for i in range(3 * k + 1)]
            ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
            spans = [[a, b] for a, b in zip([0, *ends], ends, strict=False)]
            whole = [[0, ends[-1]]]
            sides[name] = {"text": "".join(parts), "paragraph_chars": whole, "segment_chars": spans, "row_chars": [[a, b] for (a, _), (_, b) in zip(spans[::2], spans[1::2] + spans[-1:] * (len(spans) % 2), strict=True)], "overlap_chars": []}
        put(tmp_path / f"book{k % 2}" / f"{k}.json", sides)
    df = readers.packed_chapters(spark, str(tmp_path / "*" / "*.json"))
    joined = lambda v, c: F.array_join(F.transform(F.col(f"{v}.{c}"), lambda s: F.substring(F.col(f"{v}.text"), s["start"] + 1, s["end"] - s["start"])), "") == F.col(f"{v}.text")
    checks = [joined(v, c).alias(f"{v}_{c}") for v in ("original", "abridged") for c in ("paragraphs", "segments", "rows")]
    rows = df.select("chapter_idx", *checks).collect()
    assert len(rows) == 5 and all(all(r[1:]) for r in rows)


def test_segment_layouts(spark, tmp_path):
    put(tmp_path / "b" / "1.json", {"paragraph_nums": [1, 2], "segments": ["x", "y"]})
    put(tmp_path / "b" / "2.json", {"paragraph_idxs": [0, 1], "sentences": ["x", "y"]})
    got = readers.segments(spark, str(tmp_path / "b" / "*.json")).orderBy("chapter_idx", "seg_num").collect()
    assert [(r.seg_num, r.paragraph_num, r.text) for r in got] == [(1, 1, "x"), (2, 2, "y")] * 2


def test_alignment_layouts(spark, tmp_path):
    rows = [{"original_paragraph_nums": [1], "original_segments": ["a", "b"], "abridged_paragraph_nums": [1], "abridged_segments": ["a"]}, {"original_paragraph_nums": [1], "original_segments": ["c"], "abridged_paragraph_nums": [], "abridged_segments": []}]
    put(tmp_path / "b" / "1.json", rows)
    put(tmp_path / "b" / "2.json", {k: [r[k] for r in rows] for k in rows[0]})
    got = readers.alignments(spark, str(tmp_path / "b" / "*.json")).orderBy("chapter_idx", "row").collect()
    assert [(r.original_nums, r.abridged_nums) for r in got] == [([1, 2], [1]), ([3], [])] * 2


def test_sheets_and_json(spark, tmp_path):
    cell = writers.sheet_cell(F.array(F.lit(1), F.lit(2)), F.array(F.lit("a \"q\""), F.lit("b")), "\n")
    writers.write_sheet(spark.range(1).select(cell.alias("Original_Segments")), str(tmp_path / "s"))
    assert readers.sheets(spark, str(tmp_path / "s")).first().Original_Segments == '[1] a "q"\n[2] b'
    fx = Fixtures(spark, SF)
    writers.write_json(fx.chapters.limit(5), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 5
    writers.write_texts(fx.chapters.limit(3).select("book_id", F.col("original").alias("text")), str(tmp_path / "t"))
    writers.write_scores(spark.createDataFrame([(2, 0.5), (1, 0.25)], "i int, f1 double"), str(tmp_path / "c"), ["i"])
    assert [r.i for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["1", "2"]
    writers.write_vectors(spark.createDataFrame([(1, [0.5]), (3, [0.25])], "window_size int, vec array<float>"), str(tmp_path / "v"))
    assert readers.vectors(spark, str(tmp_path / "v"), 2).count() == 1
    put(tmp_path / "p.jsonl", {"tokens": ["a"], "predicted_labels": [1]})
    assert readers.predictions(spark, str(tmp_path / "p.jsonl")).first().predicted_labels == [1]
    put(tmp_path / "items.json", [{"text": "a", "name": "x"}])
    assert readers.items(spark, str(tmp_path / "items.json")).drop("text").first().name == "x"


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in" / "b"
    folder.mkdir(parents=True)
    (folder / "1.txt").write_text("One. Two!\nThree")
    query = paragraphs_stream(spark, str(tmp_path / "in" / "*")).writeStream.format("memory").queryName("pars").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("pars").orderBy("par_idx").collect()] == [("b", 1, 0, "One. Two!\n", 2), ("b", 1, 1, "Three", 1)]


def test_models(spark):
    from spanloom.operators import models

    texts = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b c")], "i int, text string")
    vectors = {r.i: r.vec for r in models.vectors(texts, "text", models.hashed_words(16)).collect()}
    assert sum(vectors[1]) == 3 and sum(vectors[2]) == 0 and len(vectors[3]) == 16
    made = models.generated(texts, "text", lambda batch: [t.upper() for t in batch], prefix="x: ")
    assert {r.i: r.generated for r in made.collect()} == {1: "X: A B A", 2: "X: ", 3: "X: B C"}

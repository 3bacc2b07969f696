"""The data source: all layouts in their forms, files in parts, and files of other books and chapters that are not opened."""

import json

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from spanloom.sources import layouts, writers


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=4))


@pytest.fixture
def corpus(tmp_path):
    """Segments of three books: single files in the old and the new layout, and lines in a folder that Spark has named."""
    put(tmp_path / "a" / "1.json", {"paragraph_nums": [1, 2], "segments": ["x", "ÿ"]})
    put(tmp_path / "a" / "2.json", {"paragraph_idxs": [0, 1], "sentences": ["x", "ÿ"]})
    put(tmp_path / "b" / "1.json", {"paragraph_nums": [], "segments": []})
    put(tmp_path / "book_id=c%20d" / "part-0.json", "".join(json.dumps({"chapter_idx": i, "paragraph_nums": [i], "segments": [str(i)]}) + "\n" for i in range(5)))
    put(tmp_path / "_SUCCESS", "")
    put(tmp_path / "a" / ".1.json.crc", "no json")
    return tmp_path


def test_segments(spark, corpus):
    got = sorted((r.book_id, r.chapter_idx, r.paragraph_nums, r.segments) for r in layouts.read(spark, str(corpus), "segments").collect())
    assert got == [("a", 1, [1, 2], ["x", "ÿ"]), ("a", 2, [1, 2], ["x", "ÿ"]), ("b", 1, [], []), *(("c d", i, [i], [str(i)]) for i in range(5))]
    assert layouts.read(spark, f"file://{corpus}", "segments", ["c d"]).count() == 5
    assert layouts.read(spark, str(corpus), "segments", []).count() == 0


def reader(corpus, **more):
    options = {"path": str(corpus), "layout": "segments", **more}
    return layouts.PushdownReader(options, None)


def planned(r):
    return sorted(p.rsplit("/", 2)[-2] + "/" + p.rsplit("/", 1)[-1] for part in r.partitions() for p in part.paths)


def test_files_are_pruned(corpus):
    assert planned(reader(corpus)) == ["a/1.json", "a/2.json", "b/1.json", "book_id=c%20d/part-0.json"]
    r = reader(corpus)
    asked = [In(("book_id",), ("a", "c d")), EqualTo(("chapter_idx",), 2), GreaterThan(("chapter_idx",), 0)]
    assert list(r.pushFilters(asked)) == asked
    assert planned(r) == ["a/2.json", "book_id=c%20d/part-0.json"]
    r = reader(corpus, books='["b", "a"]')
    list(r.pushFilters([EqualTo(("book_id",), "b")]))
    assert planned(r) == ["b/1.json"]


def test_files_share_partitions(corpus, monkeypatch):
    assert len(reader(corpus).partitions()) == 1
    monkeypatch.setattr(layouts, "PART_BYTES", 1)
    assert len(reader(corpus).partitions()) == 4


def test_conditions_are_pushed(spark, corpus):
    """Files of other books may be broken: nobody opens them."""
    put(corpus / "broken" / "7.json", "{")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        rows = layouts.read(spark, str(corpus), "segments").where("book_id = 'a' AND chapter_idx IN (2, 9)").collect()
        assert [(r.book_id, r.chapter_idx) for r in rows] == [("a", 2)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert layouts.read(spark, str(corpus), "segments", ["a"]).count() == 2


def test_other_layouts(spark, tmp_path):
    rows = [{"original_paragraph_nums": [1], "original_segments": ["a", "b"], "abridged_paragraph_nums": [1], "abridged_segments": ["a"]}, {"original_paragraph_nums": [1], "original_segments": ["c"], "abridged_paragraph_nums": [], "abridged_segments": []}]
    put(tmp_path / "al" / "b" / "1.json", rows)
    put(tmp_path / "al" / "b" / "2.json", {k: [r[k] for r in rows] for k in rows[0]})
    one, two = layouts.read(spark, str(tmp_path / "al"), "alignments").orderBy("chapter_idx").collect()
    assert one[2:] == two[2:] and one.original_segments == [["a", "b"], ["c"]] and one.abridged_paragraph_nums == [[1], []]
    put(tmp_path / "sh" / "b.12.alignment.sheet.anna.csv", '"Original_Segments","Abridged_Segments"\n"[1] a ""q""\n[2] b","[1] a"\n"[3] c",""\n')
    # the folder names no book here: the file does
    sheets = layouts.read(spark, str(tmp_path / "sh"), "sheets").orderBy("row").collect()
    assert [tuple(r) for r in sheets] == [("b", 12, "anna", 0, '[1] a "q"\n[2] b', "[1] a"), ("b", 12, "anna", 1, "[3] c", "")]
    put(tmp_path / "tx" / "b" / "3.txt", "One.\r\nTwo ü\n")
    assert [tuple(r) for r in layouts.read(spark, str(tmp_path / "tx"), "texts").collect()] == [("b", 3, "One.\r\nTwo ü\n")]
    side = {"text": "ab", "paragraph_chars": [[0, 2]], "segment_chars": [[0, 1], [1, 2]], "row_chars": [[0, 2]], "overlap_chars": []}
    put(tmp_path / "pk" / "b" / "7.json", {"original": side, "abridged": side})
    packed = layouts.read(spark, str(tmp_path / "pk"), "packed").first()
    assert (packed.chapter_idx, packed.original.segment_chars, packed.abridged.overlap_chars) == (7, [[0, 1], [1, 2]], [])
    put(tmp_path / "pr" / "book_id=b" / "p.json", '{"tokens": ["a"], "predicted_labels": [1]}\n\n')
    assert [tuple(r) for r in layouts.read(spark, str(tmp_path / "pr"), "predictions").collect()] == [("b", None, ["a"], [1])]


def test_sheets_that_we_write(spark, tmp_path):
    rows = [("b", 1, "v0", 3, ' [1] "x"\n[2] y ', "z"), ("c", 2, "v1", 0, "", "q,\\")]
    writers.write_sheets(spark.createDataFrame(rows, "book_id string, chapter_idx bigint, validator string, row bigint, Original_Segments string, Abridged_Segments string"), str(tmp_path / "s"))
    assert sorted(tuple(r) for r in layouts.read(spark, str(tmp_path / "s"), "sheets").select("book_id", "chapter_idx", "validator", "row", "Original_Segments", "Abridged_Segments").collect()) == rows


def test_empty_folder(spark, tmp_path):
    assert layouts.read(spark, str(tmp_path), "predictions").count() == 0

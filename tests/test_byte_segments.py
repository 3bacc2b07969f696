"""Segments as places in bytes, and what is counted from them, against DuckDB on odd texts and against loops."""

import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanloom.operators import byte_segments, models
from spanloom.plans import catalog, labels
from spanloom.plans.fixtures import Fixtures

rng = random.Random(8)
PIECES = ["a", "Bc", "3", " ", " ", "  ", ".", "!", "?", "\n", "\t", "\r", "\f", "\v", "\xa0", "\u2003", "\x1c", "\xe9", "\u03a3", "\u0130", "\U0001f600", "|", "#", "_", "-"]
ODD = ["", None, "\n", "\n\n", " ", ".", "...", "a", "a.b.c.d e.f", "3.14.15", "x. \n y.\n\nz", ". .\n. ", "One. Two!  Three? \n\n x. y: z; u", "no end", "Σ. ΟΔΟΣ İ", "a. b c d.", "x. " * 70 + "\n" + "\U0001f600 y! " * 9, "A\n" * 40]


def odd_texts(n=300):
    return ODD + ["".join(rng.choices(PIECES, k=rng.randrange(1, 60))) for _ in range(n)]


def both(spark, name, texts, path):
    """The query's rows and DuckDB's over documents with these texts."""
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "source": ["s"] * len(texts)})
    pq.write_table(table, path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    df = catalog.callables()[name](spark, str(path))
    assert sorted(df.columns) == sorted(names)
    return sorted(tuple(r) for r in df.select(*names).collect()), sorted(found.fetchall())


def test_window_vectors_of_odd_texts(spark, tmp_path):
    """Words that meet at a segment's end, letters whose lower case hangs on their neighbours, blanks that are none to SQL."""
    got, wanted = both(spark, "mdl2_window_vectors", odd_texts(), tmp_path)
    assert got == wanted


@pytest.mark.parametrize("group", [1, 200, 1 << 19])
def test_segments_of_grouped_texts(monkeypatch, group):
    monkeypatch.setattr(byte_segments, "GROUP", group)
    texts = [t or "" for t in odd_texts()]
    wanted = [(i, p, m) for i, t in enumerate(texts) for p, line in enumerate(re.findall("[^\n]*\n|[^\n]+", t)) for m in re.findall("[^.!?]*[.!?]+[\t\n\f\r ]*|[^.!?]+", line)]
    got = []
    for a, _, s in byte_segments.grouped(pa.array(["before", *texts])[1:]):
        raw = s.data.tobytes()
        got += [(a + k, p, raw[x:y].decode()) for k, p, x, y in zip(s.text.tolist(), s.paragraph.tolist(), s.starts.tolist(), s.ends.tolist(), strict=True)]
    assert got == wanted


def test_a_segment_is_read_once(spark, monkeypatch):
    """Windows are not encoded one by one, and nothing is sorted after the chapters are dealt out."""
    plan = catalog.callables()["mdl2_window_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange") == 1
    asked = []
    plain = models.bucket
    monkeypatch.setattr(models, "bucket", lambda w, size: asked.append(w) or plain(w, size))
    (_, _, s), = byte_segments.grouped(pa.array(["a b. c d. e f. a b.", "a b. g"]))
    assert [x.sum() for x in models.window_counts(s, 16, 4)] == [11, 18, 22, 24]
    assert sorted(asked) == [b"a", b"b.", b"c", b"d.", b"e", b"f.", b"g"]


def test_label_data_of_odd_texts(spark, tmp_path):
    """All kinds of passages, with blanks of any sort where segments, pieces and passages end."""
    texts = odd_texts() + ["a. " * n + "\n" + "b!\n" * 4 + "c? " * m for n in (9, 10, 11, 21) for m in (1, 7, 12)]
    got, wanted = both(spark, "lbl2_label_datasets", texts, tmp_path)
    assert got == wanted and {r[0] for r in got} == set(labels.KINDS)


def test_a_chapter_is_tokenised_once(spark):
    """No passage meets its segments in a sweep or a join: the five kinds come from one pass over the chapters as dealt out."""
    df = catalog.callables()["lbl2_label_datasets"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Sort", "Join", "Union")) and plan.count("Exchange") == 1
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    for kind in labels.KINDS:
        rows = lambda d: sorted((r.chapter_idx, r.idx, r.n_tokens, r.n_modified, r.digest) for r in d.collect())
        assert rows(df.where(F.col("kind") == kind)) == rows(labels.counted(labels.dataset(fx, kind)))

"""The registered queries, with their own parameters and digests, against brute force over whole tables."""

import hashlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_dedup import brute_bytes, brute_components, brute_lines, brute_words, rows_of  # noqa: E402

from spanloom.llm import byte_repeats, pitman_yor, queries, substrings  # noqa: E402

SF = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b).hexdigest()


def found(spark, query, *columns):
    return sorted(tuple(r[c] for c in columns) for r in query(spark, SF).collect())


def rows(spark):
    return rows_of(spark.read.parquet(f"{SF}/documents.parquet"))


def test_op2(spark):
    wanted = sorted((k, n, gone, sha(kept.encode())) for k, n, gone, kept in brute_words(rows(spark)))
    assert found(spark, queries.op2_substring_dedup, "doc_id", "n_words", "n_removed", "kept_sha256") == wanted
    assert any(gone for _, _, gone, _ in wanted)


def test_op4(spark):
    wanted = sorted((k, f"{p:016x}", c) for k, p, c in brute_components(rows(spark)))
    assert found(spark, queries.op4_simhash_near_dedup, "doc_id", "fingerprint", "component_id") == wanted


def test_op9(spark):
    """Strings of 200 bytes, anchored by blocks of 137."""
    wanted = sorted((k, n, gone, spans, sha(kept)) for k, n, gone, spans, kept in brute_bytes(rows(spark), 200))
    assert found(spark, queries.op9_suffix_array_dedup, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == wanted
    assert any(gone for _, _, gone, _, _ in wanted)


def test_op10(spark):
    wanted = sorted((k, n, len(gone), ",".join(map(str, gone))) for k, n, gone in brute_lines(rows(spark)))
    assert found(spark, queries.op10_line_dedup, "doc_id", "n_lines", "n_removed", "removed_lines") == wanted
    assert any(n for _, _, n, _ in wanted)


#: Texts of these numbers share a 32-bit hash.
PAIR = (199253, 316055)


def numbered_text(i):
    return " ".join(hashlib.md5(str(i * 100 + k).encode()).hexdigest()[:5] for k in range(1, 41 + i % 5))


@pytest.mark.parametrize("key", [None, 7])
def test_rows_of_one_key_and_one_short_hash(spark, key):
    """Two texts under one key that hash alike in 32 bits: what a third document repeats of one of them is not taken from the other."""
    a, b = map(numbered_text, PAIR)
    docs = spark.createDataFrame([(1, a), (key, a), (key, b)], "doc_id bigint, text string")
    assert len({r.h for r in docs.select(F.hash("text").alias("h")).collect()}) == 1
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.without_repeats(docs).collect()) == sorted([(1, len(a.split()), 0), (key or 0, len(a.split()), len(a.split())), (key or 0, len(b.split()), 0)])
    assert sorted((r.n_bytes, r.n_removed) for r in byte_repeats.without_repeats(docs).collect()) == sorted([(len(a), len(a)), (len(a), len(a)), (len(b), 0)])
    scored = pitman_yor.scores(docs, F.col("doc_id") == 1).where(F.col("doc_id").eqNullSafe(F.lit(key))).collect()
    assert sorted(r.n_tokens for r in scored) == sorted((len(a.split()) + 1, len(b.split()) + 1)) and len({r.score for r in scored}) == 2


@pytest.mark.parametrize("summed", [2, 256])
def test_totals_in_rounds(spark, monkeypatch, summed):
    """Sums of sums are the sums: scores do not depend on how many buckets meet at once."""
    monkeypatch.setattr(pitman_yor, "SUMMED", summed)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 17}" for k in range(12))) for i in range(30)], "doc_id bigint, text string")
    got = [(r.doc_id, round(r.score, 9)) for r in pitman_yor.scores(docs, F.col("doc_id") < 20).orderBy("doc_id").collect()]
    TOTALS.setdefault("first", got)
    assert got == TOTALS["first"]


TOTALS = {}

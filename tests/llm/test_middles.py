"""Fill-in-middle against the pattern itself, and exact round trips."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import middles, queries

SF = "/root/testdata/sf0.001"
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
EVENTS = middles.automaton()
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute(key, text):
    """n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    units, digits = UNIT.findall(text), sha(f"42:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


pieces = st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "\t\v", "\f\r", "日本", "🙂", " ", " ", "<P>", "<S", ">", "<", "M>", "\x00", "\x1c", "\x85"]), max_size=20).map("".join)


@settings(max_examples=500, deadline=None)
@given(pieces | st.text(max_size=40))
def test_units_are_those_of_the_pattern(text):
    units, found = middles.Units(text, EVENTS), UNIT.findall(text)
    assert units.n == len(found)
    assert [units.end(k) for k in range(units.n + 1)] == [sum(map(len, found[:k])) for k in range(len(found) + 1)]
    assert units.has_sentinel == any(s in text for s in ("<P>", "<S>", "<M>"))


def test_op13(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op13_fill_in_middle(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        n, form, prefix, middle, output = brute(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(texts[r.doc_id]))
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_awkward_rows(spark, docs, texts, awkward, nothing):
    """Null, empty, blank and long texts, null and repeated keys, clashing names, no rows."""
    many = [(i, t) for i in range(40) for t in (texts[i % len(texts)][1], "<P> own sentinel", "a <", "<M", " trailing \n", "b" * 50_000 + " " * 50_000)]
    frame = spark.createDataFrame([(k, t, "form", 1) for k, t in [*many, (None, "A b c"), (None, None)]], "doc_id bigint, text string, output string, n int")
    for source, rows in ((frame, [*many, (None, "A b c"), (None, None)]), (awkward, [(r.doc_id, r.text) for r in awkward.collect()]), (docs, texts)):
        cut = middles.fill_in_middle(source)
        got = cut.withColumn("back", middles.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted(((k, *brute(k, t)) for k, t in rows), key=repr)
        assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert middles.fill_in_middle(nothing).count() == 0


@pytest.mark.parametrize("share, spm_share, forms", [(0, 80, {"plain"}), (100, 100, {"spm"}), (100, 0, {"psm"})])
def test_shares(spark, share, spm_share, forms):
    docs = spark.createDataFrame([(i, f"some text number {i} ") for i in range(60)], "doc_id bigint, text string")
    got = middles.fill_in_middle(docs, seed=7, share=share, spm_share=spm_share)
    assert {r.form for r in got.collect()} == forms
    assert sorted(r.b for r in got.select(middles.restored(F.col("output"), F.col("form")).alias("b")).collect()) == sorted(f"some text number {i} " for i in range(60))

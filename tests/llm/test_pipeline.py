"""Each stage of the pipeline against brute force on its own input, and run() as their chain."""

import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))
from test_dedup import brute_lines  # noqa: E402
from test_models import nearest, plain  # noqa: E402
from test_near_copies import brute  # noqa: E402

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out.append(docs)
    return [{r.doc_id: r for r in d.collect()} for d in out]


def test_columns_stay(steps):
    assert all(set(next(iter(s.values())).asDict()) >= {"doc_id", "text", "lang", "source", "n_chars"} for s in steps)


def test_toxicity_stage(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = steps[0].keys() - steps[1].keys()
    assert gone and sum(labels.get(k, 0) for k in gone) >= 0.8 * len(gone & labels.keys())
    assert all(steps[1][k].text == steps[0][k].text for k in steps[1])


def test_line_stage(steps):
    gone = {k: set(j) for k, _, j in brute_lines([(k, r.text) for k, r in steps[1].items()])}
    assert steps[2].keys() == steps[1].keys()
    for k, r in steps[2].items():
        assert r.text == "\n".join(x for j, x in enumerate(steps[1][k].text.split("\n")) if j not in gone[k])
        assert r.n_chars == len(r.text)


def test_near_duplicate_stage(steps):
    """One document of each group that Jaccard similarities of 0.8 or more link."""
    assert steps[3].keys() == brute([(k, r.text) for k, r in steps[2].items()])


def test_decontamination_stage(spark, steps):
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, r in steps[3].items():
        words = plain(r.text)
        held = any(set(i) & set(words) and nearest(i, words) <= len(i) // 5 for i in items) if len(words) < 400 else None
        if held is not None:
            assert held == (k not in steps[4])


def test_encoding_stage(steps):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert steps[5].keys() == steps[4].keys()
    for k, r in steps[5].items():
        ids = model.encode(steps[4][k].text, add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.text == model.decode(ids)


def test_run_is_the_chain(spark, steps):
    assert {r.doc_id: (r.text, r.n_tokens) for r in pipeline.run(spark, SF).collect()} == {k: (r.text, r.n_tokens) for k, r in steps[5].items()}


def test_toxicity_stage_on_awkward_rows(spark, awkward, nothing, tmp_path):
    """Null and repeated keys, null texts, null labels and keys of labels; columns with names of its own."""
    clean, vile = [(i, f"a{i} b{i} c{i}") for i in range(300, 700)], [(i, f"vile words of number {i}") for i in range(200, 240)]  # mostly clean, and nothing but toxic texts share words
    marks = [(1, 0), (2, 0), (None, 1), (3, None), *((i, 0) for i, _ in clean), *((i, 1) for i, _ in vile)]
    spark.createDataFrame(marks, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = awkward.unionByName(spark.createDataFrame(clean + vile, "doc_id bigint, text string"))
    docs = whole.selectExpr("doc_id", "text", "1 AS score", "'x' AS toxic", "2 AS k")
    kept = pipeline.toxicity_stage(spark, docs, str(tmp_path))
    wanted = docs.where("doc_id IS NULL OR doc_id NOT BETWEEN 200 AND 239")
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, wanted.collect()))
    assert pipeline.toxicity_stage(spark, nothing, str(tmp_path)).count() == 0
    marked = spark.createDataFrame([], "doc_id bigint, toxic int")
    marked.write.parquet(f"{tmp_path}/none/labels.parquet")
    assert pipeline.toxicity_stage(spark, docs, f"{tmp_path}/none").count() == docs.count()

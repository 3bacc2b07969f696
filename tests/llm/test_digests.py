"""The registered op6, op7 and op3 as they are: digests against the libraries, training against a second, plain one."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spanloom.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op6(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = queries.op6_sentence_pieces(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        ids = model.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_op7(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = queries.op7_token_counts(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def plain_ftrl(examples, alpha, beta, l1, l2, epochs):
    """Coordinate by coordinate, in dictionaries; the bias is the coordinate None."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for at, label in examples:
            own = [*at, None]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in own:
                had = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / alpha * w[i]
                n[i] = had + g * g
    return {i: w for i in z if (w := weight(i))}


@pytest.mark.parametrize("alpha, beta, l1, l2", [(1.0, 1.0, 8.0, 0.0), (0.3, 0.5, 0.5, 0.1)])
def test_training_equals_a_plain_one(alpha, beta, l1, l2):
    rng = np.random.default_rng(3)
    examples = []
    for _ in range(120):
        label = int(rng.random() < 0.4)
        examples.append((np.unique(np.concatenate([rng.integers(0, 200, 12), rng.integers(200 + 20 * label, 220 + 20 * label, 3)])), label))
    model = toxicity.ftrl(examples, 8, alpha, beta, l1, l2, 5)
    wanted = plain_ftrl([(at.tolist(), y) for at, y in examples], alpha, beta, l1, l2, 5)
    assert dict(zip(model.at.tolist(), model.weight.tolist(), strict=True)) == pytest.approx({i: w for i, w in wanted.items() if i is not None})
    assert model.bias == pytest.approx(wanted.get(None, 0.0)) and wanted


def test_op3_scores_are_those_of_the_plain_model(spark, texts):
    """Features, training and scores of the registered query, from its own rows; labels of held-out rows are not used."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    learned = sorted(k for k in labels if k in texts and zlib.crc32(str(k).encode()) % 4 != 2)

    def features(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        _, at = toxicity.text_features(raw, np.array([0, len(raw)]), 20)
        return np.unique(at)

    from pyspark.sql import functions as F

    order = {r.k: r.h for r in spark.createDataFrame([(k,) for k in learned], "k bigint").select("k", F.xxhash64("k").alias("h")).collect()}
    examples = [(features(texts[k]).tolist(), int(labels[k] > 0)) for k in sorted(learned, key=order.get)]
    weights = plain_ftrl(examples, 1.0, 1.0, 8.0, 0.0, 8)
    for r in queries.op3_toxicity(spark, SF).collect():
        total = weights.get(None, 0.0) + sum(weights.get(i, 0.0) for i in features(texts[r.doc_id]).tolist())
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9) and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)

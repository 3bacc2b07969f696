"""The Merkle manifest against a plain tree: whole digests, proofs and tampered leaves."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm import merkle, queries

SF = "/root/testdata/sf0.001"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The top node, and for each leaf the siblings (before, after) of every level."""
    level, up = list(leaves), [[] for _ in leaves]
    at = list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k - k % 8
            up[i].append(("".join(level[run:k]), "".join(level[k + 1 : run + 8])))
        level, at = [H(*level[r : r + 8]) for r in range(0, len(level), 8)], [k // 8 for k in at]
    return level[0] if level else None, up


def brute(rows, lowers=lambda k: k is not None and zlib.crc32(str(k).encode()) % 3 == 0):
    """rows: (doc_id, source, lang, n_chars, text)."""
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, paths, out = [], {}, []
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        top, paths[g] = tree([x[2] for x in groups[g]])
        tops.append(top)
    root, trunk = tree(tops)
    for g, top, above in zip(order, tops, trunk, strict=True):
        for (_, _, leaf, r), own in zip(groups[g], paths[g], strict=True):
            path, node = own + above, leaf_of(*r[:4], lower(r[4])) if lowers(r[0]) else leaf
            for before, after in path:
                node = H(before, node, after)
            out.append((r[0], leaf, top, root, H(*(b + a for b, a in path)), node, node == root))
    return sorted(out, key=repr)


def columns(found):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)


def rows_of(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def manifest(docs):
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    found = merkle.manifest(docs, changed={"text": lowered})
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("path"), F.col("changed_leaf")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def test_op11(spark):
    wanted = brute(rows_of(spark.read.parquet(f"{SF}/documents.parquet")))
    assert columns(queries.op11_merkle_manifest(spark, SF)) == wanted
    assert {v for *_, v in wanted} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8, 9), (64, 65, 63), (7, 513), (512,), (1200, 3)])
def test_sizes_at_the_edges_of_runs_and_blocks(spark, sizes):
    """Runs of one node, whole runs, and languages of more than a block, in one round and in two."""
    rows = [(10_000 * g + i, "s", None if g == 0 else f"l{g}", i, f"Text {i % 7}") for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert columns(manifest(docs)) == brute(rows)


def test_awkward_rows(spark):
    """Nulls in every column, empty texts, one key on several texts, repeated rows, groups that only bytes order, clashing names."""
    rows = [(None, None, None, None, None), (None, "a", "é", 1, "X"), (1, "a", "z", None, ""), (1, "a", "z", None, None), (1, "a", "z", 3, "ABC"), (2, "b", "Z", 3, "ABC ünd"), (2, "b", "", 3, "q" * 100_000)]
    rows += [(7, "hot", "en", 5, "SAME")] * 600 + [(-5, "neg", "en", 5, "less")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, g int, node string, pos string")
    assert columns(manifest(docs)) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert columns(manifest(docs)) == []


def test_other_fields_and_a_group_of_numbers(spark):
    """The operator's own interface: any key, group and fields; unchanged rows verify."""
    docs = spark.createDataFrame([(f"k{i:03}", i % 3, i) for i in range(40)], "name string, part int, v int")
    found = merkle.manifest(docs, key="name", group="part", fields=("name", "v")).collect()
    tops = [tree([leaf_of(f"k{i:03}", i) for i in range(g, 40, 3)])[0] for g in range(3)]
    assert {r.root for r in found} == {tree(tops)[0]}
    assert all(r.leaf == r.changed_leaf for r in found)

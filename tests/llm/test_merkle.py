"""Merkle manifest: the query and odd tables against a plain tree, the heap sweep against a plain loop."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from stagewatch.llm import merkle, queries
from stagewatch.llm.merkle import Subtree

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    shown = [None if v is None else str(v) for v in values]
    return digest(*("-" if v is None else f"{len(v.encode())}:{v}" for v in shown))


def tree(leaves):
    """Root, and each leaf's siblings by level as (left, right)."""
    proofs, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, place in enumerate(at):
            first = place - place % 3
            proofs[k].append(("".join(leaves[first:place]), "".join(leaves[place + 1:first + 3])))
        leaves = [digest(*leaves[i:i + 3]) for i in range(0, len(leaves), 3)]
        at = [place // 3 for place in at]
    return (leaves[0] if leaves else None), proofs


def folded(found, proof):
    for left, right in proof:
        found = digest(left, found, right)
    return found


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of (doc_id, text, lang, source, n)."""
    groups = {}
    for d, text, lang, source, n in rows:
        own = leaf((d, source, lang, n, text))
        changed = own
        if d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and text is not None:
            changed = leaf((d, source, lang, n, text.replace("\n", "")))
        groups.setdefault(source, []).append(((d is not None, d or 0, own), d, own, changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda g: g[0])
        trees[s] = tree([g[2] for g in groups[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, d, own, changed), proof in zip(groups[s], trees[s][1]):
            proof = proof + top
            got = folded(changed, proof)
            out.append((d, own, trees[s][0], root, digest(*(a + b for a, b in proof)), got, got == root))
    return sorted(out, key=str)


def run(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def plain(frame):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in frame.collect()]


def test_query(spark):
    table = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute(plain(table))
    assert {g[-1] for g in got} == {True, False}


def test_odd_table(spark, odd_documents, tmp_path):
    odd = odd_documents.union(odd_documents.limit(3)).withColumn("tree", F.lit(1)).withColumn("place", F.lit("x"))
    assert run(spark, odd, tmp_path) == brute(plain(odd))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [3], [4, 1], [243], [244, 2, 1], [800, 1, 3]])
def test_sizes(spark, sizes, tmp_path):
    rows = [(i, f"a\n{i}", "en", f"s{k}" if k else None, 1) for k, n in enumerate(sizes) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert run(spark, frame.repartition(5), tmp_path) == brute(rows)


def test_empty_table(spark, odd_documents, tmp_path):
    assert run(spark, odd_documents.limit(0), tmp_path) == []


@pytest.mark.parametrize("leaves", [1, 2, 3, 8, 9, 10, 26, 27, 28, 100, 243])
def test_subtree(leaves):
    digests = [digest(str(i)) for i in range(leaves)]
    got = Subtree(digests, merkle.height(leaves))
    root, proofs = tree(digests)
    assert got.digests[-1] == [root]
    found = list(got.proofs("x.y"))
    assert [p for p, _ in found] == list(reversed(range(leaves)))
    for place, proof in found:
        assert [tuple(x.split(".")) for x in proof.split("/")] == [*proofs[place], ("x", "y")]


def test_a_changed_byte_is_found(spark):
    frame = spark.createDataFrame([(i, f"text {i}", "s") for i in range(30)], "doc_id long, text string, source string")
    other = {"other": merkle.leaf_digest([F.col("doc_id"), F.concat("text", F.lit("."))])}
    got = merkle.merkle_manifest(frame, ["doc_id", "text"], keep=other)
    right = merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")
    wrong = merkle.fold(F.col("other"), F.col("proof")) == F.col("root")
    assert got.where(right).count() == 30 and got.where(wrong).count() == 0

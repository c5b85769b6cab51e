"""Line dedup: both ways of probing against a plain loop, the perfect hash and the shards' bytes."""

import hashlib

import numpy as np
import pytest

from stagewatch.llm import line_dedup, queries
from stagewatch.llm.line_dedup import PerfectHash, Shard, Shards, shard_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\v\f\r").translate(LOWER)


def brute(rows, shortest=40, least=5):
    holders = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest:
                holders.setdefault(key(line), set()).add((d is not None, d or 0))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= least
                                         and max(holders[key(x)]) != (d is not None, d or 0))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def got(frame, **kw):
    return sorted((tuple(r) for r in line_dedup.drop_lines(frame, **kw).collect()), key=str)


def repeated():
    """Lines in 4, 5 and very many documents, in other case, with white space at the ends, twice in one document."""
    often = "A line that very many documents hold, Été and all"
    five, four = "five documents hold this line, no more of them", "four documents hold this line, no more of them"
    edge, short = "x" * 40, "y" * 39
    rows = []
    for i in range(60):
        lines = [f"own line {i} of a document that is long enough", often.upper() if i % 7 == 0 else f"\t {often} \r"]
        lines += [five] * (i % 12 == 0) + [four] * (i % 15 == 0) + [edge] * (i < 6) + [short] * (i < 9)
        lines += [often] * (i == 3) + ["", "  "] * (i % 2)
        rows.append((i, "\n".join(lines)))
    return rows + [(None, often), (None, often + "\n" + five), (59, often), (100, None), (101, ""), (102, "\n"), (103, often.replace("É", "é"))]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_repeated_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "SHARD_PROBES", 7)          # the frequent line's shard is copied
    rows = repeated()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    assert got(frame, broadcast_bytes=limit) == want
    assert sum(w[2] for w in want) > 60


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_documents(spark, limit):
    frame = queries.table(spark, "/root/testdata/sf0.01", "documents")
    want = brute(rows_of(frame))
    assert got(frame, broadcast_bytes=limit) == want and any(w[2] for w in want)


def test_query(spark):
    frame = queries.table(spark, "/root/testdata/sf0.001", "documents")
    want = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows_of(frame)))
    assert sorted(tuple(r) for r in queries.op12_line_dedup(spark, "/root/testdata/sf0.001").collect()) == want


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_odd_table(spark, odd_documents, limit):
    odd = odd_documents.withColumnsRenamed({"lang": "hi", "source": "shard", "n_chars": "drop"})
    assert got(odd, broadcast_bytes=limit, shortest=1, least=2) == brute(rows_of(odd), 1, 2)
    assert got(odd.limit(0), broadcast_bytes=limit) == []


def test_other_ids(spark):
    rows = [(f"id {i:02d}", f"the same line of more than forty characters\n{i}") for i in range(8)]
    frame = spark.createDataFrame(rows, "name string, body string")
    found = line_dedup.drop_lines(frame, id_col="name", text_col="body").collect()
    assert {r.doc_id: r.n_dropped for r in found} == {d: int(d != "id 07") for d, _ in rows}


def hashes(n, seed=1):
    return np.random.default_rng(seed).integers(0, 2**64, (n, 2), dtype=np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 64, 5000])
@pytest.mark.parametrize("levels", [0, 1, 24])
def test_perfect_hash(n, levels):
    known = hashes(n)
    index = PerfectHash.build(known, levels)
    assert sorted(index(known)) == list(range(n))
    assert ((index(hashes(500, 2)) >= -1) & (index(hashes(500, 2)) < max(n, 1))).all()


def test_hashes_that_share_a_half():
    known = np.array([[5, i] for i in range(300)] + [[i, 5] for i in range(300) if i != 5], np.uint64)
    assert sorted(PerfectHash.build(known)(known)) == list(range(len(known)))


def test_shards_keep_their_arrays():
    known = hashes(3000)
    counts, owners = np.arange(3000) + 5, np.arange(3000) - 1500
    dealt = shard_of(known, 4)
    packed = {k: Shard.build(known[dealt == k], counts[dealt == k], owners[dealt == k]).pack() for k in range(4)}
    shards = Shards(packed, 4)
    other = hashes(3000, 9)
    found = shards.probe(np.concatenate([known, other]))
    assert (found[0][:3000] == counts).all() and (found[1][:3000] == owners).all() and not found[0][3000:].any()
    assert sum(map(len, packed.values())) < 3000 * 21 + 4 * 1000

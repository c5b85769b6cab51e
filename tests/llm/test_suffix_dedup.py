"""Repeated byte strings against brute force, suffix arrays against plain sorting."""

import hashlib
import random

import numpy as np
import pytest

from stagewatch.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"
BIG = 2**63 - 1


def brute(rows, length=50):
    first = {}
    texts = [(BIG if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for (raw, _), (i, b) in zip(rows, texts):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((raw, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(rows):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans),
                    hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=repr)


def cases(length):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    common, line = say(40), say(12)
    rows = [(i, say(rnd.randint(0, 120))) for i in range(40)]
    rows += [(i, say(10) + common + say(10)) for i in range(40, 55)] + [(i, common) for i in range(55, 60)]
    rows += [(i, say(3) + "\n" + line + "\n" + say(3)) for i in range(60, 80)]
    rows += [(80, "z" * 400), (81, "z" * 300), (82, "y" + "z" * 200 + "y"), (83, "ab" * 200), (84, "ab" * 300),
             (85, common + common), (86, ""), (87, None), (88, "x" * (length - 1)), (89, "x" * length), (90, "x" * length),
             (None, common), (None, "only null " * 20), (91, "\0" * 120), (92, "\0" * 90 + "a")]
    rows += [rows[3], rows[41], (41, rows[41][1] + "!"), (7, say(80)), (-5, common[:len(common) // 2])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("length,gram,hot,shard", [(50, 20, 50_000, 2_000_000), (50, 16, 2, 2_000_000),
                                                   (16, 8, 50_000, 300), (20, 20, 3, 500)])
def test_against_brute_force(spark, monkeypatch, length, gram, hot, shard):
    monkeypatch.setattr(suffix_dedup, "SUFFIX_SHARD_BYTES", shard)
    rows = cases(length)
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, joint int").repartition(4)
    got = suffix_dedup.repeated_spans(table, length, gram, 5_000, hot).collect()
    assert digest(got) == brute(rows, length)


@pytest.mark.parametrize("fold", [2_000_000, 50])
def test_a_frequent_line_does_not_gather_in_its_shard(spark, monkeypatch, fold):
    monkeypatch.setattr(suffix_dedup, "FOLD_RUNS", fold)
    resolve = suffix_dedup._resolve

    def watched(parts, hot):
        anchors, keys = (np.concatenate(x) for x in list(zip(*parts))[1:])
        assert np.unique(np.stack([anchors, keys]), axis=1, return_counts=True)[1].max() <= 8    # one a slice
        return resolve(parts, hot)

    monkeypatch.setattr(suffix_dedup, "_resolve", watched)
    rnd = random.Random(5)
    rule = "-" * 40 + " all rights reserved, see the licence " + "-" * 40
    rows = [(i, "%032x\n" % rnd.getrandbits(128) + rule * (i % 3) + "\n%032x" % rnd.getrandbits(128))
            for i in range(900)] + [(None, rule), (None, rule), (4, rule + "4")]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4)
    assert digest(suffix_dedup.repeated_spans(table, 50, 20, 100_000).collect()) == brute(rows)


def test_shards_are_merged_by_binary_search():
    rnd = np.random.default_rng(2)
    ids = np.arange(60)
    runs = [bytes(rnd.choice([97, 98], rnd.integers(8, 14)).astype(np.uint8)) for _ in ids]
    merger, got = suffix_dedup.Merger(8), []
    for at in range(0, 60, 7):
        got += merger.shard(np.zeros(len(ids[at:at + 7]), np.int64), ids[at:at + 7], runs[at:at + 7])
    for i, r in enumerate(runs):
        before = {x[p:p + 8] for x in runs[:i] for p in range(len(x) - 7)}
        assert got[i].tolist() == [r[p:p + 8] in before for p in range(len(r) - 7)]


def test_suffix_array_and_prefixes():
    rnd = np.random.default_rng(3)
    text = rnd.choice([97, 98], 700).astype(np.uint8)
    raw = text.tobytes()
    order = suffix_dedup.suffix_array(text, 64)
    assert [raw[i:i + 64].ljust(64, b"\0") for i in order] == sorted(raw[i:i + 64].ljust(64, b"\0") for i in range(700))
    begins, counts = np.array([0, 200, 500]), np.array([120, 250, 140])
    window = np.zeros(700, bool)
    for b, c in zip(begins, counts):
        window[b:b + c] = True
    order = order[window[order]]
    found = suffix_dedup.common_prefixes(text, order, begins, counts, 50)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1]:][:50], raw[order[k]:][:50]
        assert found[k] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_query_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op5_suffix_dedup(spark, SF)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([(d.doc_id, d.text) for d in docs.collect()])
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0

"""Quality classifier: held-out accuracy and calibration, word vectors against a plain loop, odd tables."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stagewatch.llm import quality, queries

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    rows = queries.op4_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return rows, labels


def test_held_out_accuracy(scored):
    rows, labels = scored
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    pairs = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = (np.array([s for s, y in pairs if y == v]) for v in (1, 0))
    auc = (good[:, None] > bad[None, :]).mean()
    assert auc > 0.99
    assert (good >= 0.7).mean() > 0.98 and (bad < 0.7).mean() > 0.85
    assert np.mean([(s - y) ** 2 for s, y in pairs]) < 0.03          # calibrated: a small Brier score


def test_held_out_labels_do_not_matter(spark):
    sf = SF.replace("0.1", "0.01")
    docs, labels = (queries.table(spark, sf, t) for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score_quality(docs, x).collect()} for x in (labels, turned))
    assert a == b
    c = {r.doc_id: r.score for r in quality.score_quality(docs, labels, fit_rows=50).collect()}
    assert c != a and len(c) == len(a)


def test_word_vectors(spark):
    texts = ["a b c a", "", None, "b\nb", "x, y"]
    table = spark.createDataFrame([(t,) for t in texts], "text string").fillna("")
    index, sums = quality.index_vectors().astype(int), np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    entry = lambda w: zlib.crc32(w.encode()) % quality.BUCKETS
    for words in (["a", "b", "c", "a"], ["b", "b"], ["x", ",", "y"]):
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                sums[entry(w)] += index[entry(words[j])]
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    want = sums / np.where(norms > 0, norms, 1)
    got = quality.word_vectors(table)
    assert np.allclose(got, want, atol=1e-6)
    x = quality.features(pa.array(["a b", ""]), got)
    pair = want[[entry("a"), entry("b")]]
    assert np.allclose(x[0, :quality.DIMENSIONS], pair.mean(axis=0), atol=1e-5)
    assert np.allclose(x[0, quality.DIMENSIONS:-2], pair.std(axis=0), atol=1e-3)
    assert np.isclose(x[0, -2], ((pair[0] - pair[1]) ** 2).sum(), atol=1e-5) and not x[1].any()


def test_odd_tables(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (1, 0)], "doc_id long, quality int")
    rows = quality.score_quality(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and {r.score for r in rows} == {1.0}
    none = quality.score_quality(odd_documents, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(odd_documents.limit(0), labels).count() == 0
    assert quality.keep_quality(odd_documents, labels).count() == odd_documents.count()
    many = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    kept = quality.keep_quality(odd_documents, many, threshold=0.0)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count()


def plain_network(x, y, hidden=32, rounds=60, seed=1):
    """The network written out number by number in the order its definition gives; returns a score function."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    centre = [sum(col) / n for col in x.T]
    scale = [(sum((v - c) ** 2 for v in col) / n) ** 0.5 + 1e-6 for col, c in zip(x.T, centre)]
    z = [[(v - c) / s for v, c, s in zip(row, centre, scale)] for row in x]
    fit = [i for i in range(n) if i % 5]
    w = rng.normal(0, width ** -0.5, (width, hidden)).tolist()
    b, u, c = [0.0] * hidden, None, [0.0]
    u = rng.normal(0, hidden ** -0.5, hidden).tolist()

    def forward(row):
        h = [math.tanh(sum(row[i] * w[i][j] for i in range(width)) + b[j]) for j in range(hidden)]
        return h, sum(hj * uj for hj, uj in zip(h, u)) + c[0]

    state, step = {}, 0

    def moved(key, value, grad):
        m, v = state.get(key, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        state[key] = m, v
        return value - 3e-3 * (m / (1 - 0.9 ** step)) / (math.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    for _ in range(rounds):
        order = rng.permutation(fit).tolist()
        parts = max(1, len(fit) // 128)
        sizes = [len(order) // parts + (k < len(order) % parts) for k in range(parts)]
        for k in range(parts):
            part = order[sum(sizes[:k]):sum(sizes[:k + 1])]
            gw = [[1e-4 * w[i][j] for j in range(hidden)] for i in range(width)]
            gb, gu, gc = [0.0] * hidden, [1e-4 * v for v in u], 0.0
            for i in part:
                h, raw = forward(z[i])
                err = (1 / (1 + math.exp(-raw)) - y[i]) / len(part)
                gc += err
                for j in range(hidden):
                    gu[j] += err * h[j]
                    back = err * u[j] * (1 - h[j] * h[j])
                    gb[j] += back
                    for d in range(width):
                        gw[d][j] += z[i][d] * back
            step += 1
            w = [[moved(("w", d, j), w[d][j], gw[d][j]) for j in range(hidden)] for d in range(width)]
            b = [moved(("b", j), b[j], gb[j]) for j in range(hidden)]
            u = [moved(("u", j), u[j], gu[j]) for j in range(hidden)]
            c = [moved("c", c[0], gc)]
    aside = [(forward(z[i])[1], y[i]) for i in range(n) if i % 5 == 0]
    steps = [math.exp(math.log(0.25) + k * (math.log(8) - math.log(0.25)) / 60) for k in range(61)]
    heat = min(steps, key=lambda t: sum(math.log(1 + math.exp((-r if a == 1 else r) / t)) for r, a in aside))
    return lambda row: 1 / (1 + math.exp(-forward([(v - m) / s for v, m, s in zip(row, centre, scale)])[1] / heat))


def test_network_against_plain_numbers():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 4)) * [1, 5, 0.1, 2] + [0, 3, 0, -1]
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=60) > 1).astype(float)
    slow = plain_network(x, y, hidden=3, rounds=15)
    fresh = rng.normal(size=(20, 4))
    got = quality.Network(x, y, hidden=3, rounds=15).score(fresh)
    assert np.allclose(got, [slow(row) for row in fresh], atol=1e-9) and got.std() > 0.05


def test_repeated_ids_give_one_text_to_the_fit(spark):
    docs = queries.table(spark, SF.replace("0.1", "0.001"), "documents").select("doc_id", "text")
    labels = queries.table(spark, SF.replace("0.1", "0.001"), "labels")
    own = quality.fit_quality(docs, labels)
    first = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    assert first.count() == docs.count()
    again = quality.fit_quality(docs.union(docs).union(docs), labels)
    # three times every text: three times every sum, the same unit vectors and the same rows to fit
    assert np.allclose(own.vectors, again.vectors, atol=1e-6)
    texts = pa.array([r.text for r in docs.limit(50).collect()])
    assert np.allclose(own.score(texts), again.score(texts), atol=1e-3)


@pytest.mark.parametrize("buckets", [64, 1 << 16])
def test_number_of_entries_is_a_parameter(spark, buckets):
    sf = SF.replace("0.1", "0.001")
    docs, labels = (queries.table(spark, sf, t) for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels, buckets=buckets)
    assert model.vectors.shape == (buckets, quality.DIMENSIONS)
    rows = quality.score_quality(docs, labels, buckets=buckets)
    assert rows.count() == docs.count() and rows.where("score < 0 or score > 1 or score is null").count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, quality.FEATURES))
    p = 1 / (1 + np.exp(-x[:, 0]))
    net = quality.Network(x, (rng.random(4000) < p).astype(float))
    fresh = rng.normal(size=(4000, quality.FEATURES))
    got, want = net.score(fresh), 1 / (1 + np.exp(-fresh[:, 0]))
    for low in (0.1, 0.3, 0.5, 0.7):
        inside = (got >= low) & (got < low + 0.2)
        assert abs(got[inside].mean() - want[inside].mean()) < 0.1

"""The pipeline, stage by stage, against brute force on the stage's own input."""

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from stagewatch.llm import quality, queries
from tests.llm.test_dedup import brute_components, brute_exact, brute_fingerprint, brute_leaks, words
from tests.llm.test_tokens import check_packing, library_ids

SF = "/root/testdata/sf0.001"


def test_stages(spark, monkeypatch):
    inputs, outputs = [], []
    kept = {}

    def watched(number, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            rows = out.collect()
            inputs.append([tuple(r) for r in docs.collect()])
            outputs.append(rows)
            kept[number] = out.columns
            return out
        return run

    stages = [(name, watched(k, f)) for k, (name, f) in enumerate(corpus_pipeline.STAGES)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    final = corpus_pipeline.run(spark, SF)
    table = queries.table(spark, SF, "documents")
    assert all(kept[k] == table.columns for k in range(4))
    after = [Counter(tuple(r) for r in rows) for rows in outputs[:4]]
    for k in range(1, 5):
        assert Counter(inputs[k]) == after[k - 1]
    start = [(r[0], r[1]) for r in inputs[0]]

    scores = {r.doc_id: r.score for r in quality.score_quality(table, queries.table(spark, SF, "labels")).collect()}
    assert {r[0] for r in after[0]} == {d for d, _ in start if scores[d] >= 0.7}
    second = [(r[0], r[1]) for r in inputs[1]]
    assert sorted(r[0] for r in after[1].elements()) == sorted(w[0] for w in brute_exact(second) if w[3])
    third = [(r[0], brute_fingerprint(r[1])) for r in inputs[2]]
    assert sorted(r[0] for r in after[2].elements()) == sorted(d for d, _, c in brute_components(third) if d == c)
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    grams = {g for _, x in items for g in zip(*[words(x)[j:] for j in range(5)])}
    near = [(r[0], r[1]) for r in inputs[3] if grams & set(zip(*[words(r[1])[j:] for j in range(5)]))]
    leaked = {d for d, _ in brute_leaks(near, items)}
    assert {r[0] for r in after[3]} == {r[0] for r in inputs[3]} - leaked and leaked
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    last = [(r[0], library_ids(path, [r[1]])[0]) for r in inputs[4]]
    sizes = check_packing(final.collect(), last, 4096)
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes)
    assert len(after[3]) < len(after[2]) < len(after[1]) < len(start)
    assert not re.search("limit|sample", " ".join(final.columns))


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_tables(spark, odd_documents, tmp_path):
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, odd_documents, SF)
        assert out.columns == odd_documents.columns and out.count() > 0
        assert stage(spark, odd_documents.limit(0), SF).count() == 0
    first, last = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[4][1]
    good = first(spark, odd_documents, SF)
    assert good.columns == odd_documents.columns
    scores = quality.fit_quality(odd_documents, queries.table(spark, SF, "labels")).score(
        odd_documents.select("text").toArrow()["text"].combine_chunks())
    assert good.count() == int((scores >= 0.7).sum())
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    sizes = check_packing(last(spark, odd_documents, SF).collect(),
                          [(r.doc_id, library_ids(path, [r.text])[0]) for r in odd_documents.collect()], 4096)
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes)
    for stage in (first, last):
        assert stage(spark, odd_documents.limit(0), SF).count() == 0

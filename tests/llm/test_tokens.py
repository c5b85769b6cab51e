"""Encoder, packing, counting and the token store against the library itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stagewatch.llm import packing, queries, token_counts, token_store
from stagewatch.llm.common import scratch_path
from stagewatch.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
BYTE, WORD = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library_ids(path, texts):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_gives_the_librarys_ids(path, texts):
    letters = [chr(c) for c in range(0x20, 0x260)]
    more = [a + b for a in letters for b in (" x", "a", "1", "'s", ".")] + ["".join(letters), " ".join(letters)]
    odd = [x or "" for x in texts] + more
    encoder = Encoder(path)
    assert encoder.kind in ("byte", "word")
    for batch in (odd, odd[:5], odd[::-1], [""], ["", ""]):
        ids, counts = encoder.encode(pa.array(batch, pa.string()))
        got = np.split(ids, np.cumsum(counts)[:-1])
        for x, mine, theirs in zip(batch, got, library_ids(path, batch)):
            assert mine.tolist() == theirs, x


def mixed_texts():
    """Texts of many scripts, white space of every kind, combining marks and special strings, put together at random."""
    rng = np.random.default_rng(11)
    parts = ["the", "Word", "it's", "’s", "“quoted”", "—", "€5", "12", "½", "Привет", "мир,", "日本語。", "テキスト", "한국어", "नमस्ते",
             "العربية", "J\u030c", "e\u0301", "\u0301", "İ", "ΣΑΣ", "ǅ", "🙂🏽", "\u200b", "\u00ad", "x\u00a0y", "<|", "|>",
             "<|endoftext|>", "<|startoftext|>", "a<|endoftext|>b", "<|end", "!!'s", "''", "\x00", "\x1f", "\ufeff", "ﬁ"]
    gaps = [" ", " ", " ", " ", "  ", "   ", "\t", "\r\n", "\n", " \n", "\n ", "\u3000", "\u2009", "\u00a0", "\u2028", "\x85",
            "\x1c", "", ""]
    texts = ["".join(str(x) for pair in zip(rng.choice(parts, n), rng.choice(gaps, n)) for x in pair)
             for n in rng.integers(1, 40, 1500)]
    return texts + [a + g + b for a in parts for g in gaps for b in parts[::5]]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_mixed_texts_are_counted_by_pre_token(path, monkeypatch):
    texts = mixed_texts()
    want = library_ids(path, texts)
    encoder = Encoder(path)
    monkeypatch.setattr(encoder, "whole", None)                        # no text goes to the library whole
    for batch in (range(0, len(texts)), range(3), range(700, 760)):
        ids, counts = encoder.encode(pa.array([texts[i] for i in batch], pa.string()))
        for i, mine in zip(batch, np.split(ids, np.cumsum(counts)[:-1])):
            assert mine.tolist() == want[i], repr(texts[i])
    chunks, index, bounds = encoder.chunks_of(pa.array(texts, pa.string()))
    assert len(set(chunks)) == len(chunks)
    sizes = np.array([len(encoder.chunk_ids(c)) // 4 for c in chunks])
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        assert sizes[index[a:b]].sum() == len(want[i])


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_on_documents(spark, path):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ids, counts = Encoder(path).encode(pa.array(docs, pa.string()))
    assert ids.tolist() == [i for x in library_ids(path, docs) for i in x]
    assert counts.sum() == len(ids)


def test_encoder_of_another_kind_uses_the_library(tmp_path):
    t = Tokenizer.from_file(BYTE)
    t.pre_tokenizer = __import__("tokenizers").pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.save(str(tmp_path / "t.json"))
    e = Encoder(str(tmp_path / "t.json"))
    assert e.kind == "whole"
    assert e.encode(pa.array(["ab c", ""]))[0].tolist() == t.encode("ab c").ids


def check_packing(rows, docs, capacity, end_id=2):
    """Every id in exactly one piece, sequences gapless and of at most the capacity; returns sequence sizes."""
    wanted = defaultdict(list)
    for doc_id, ids in docs:
        wanted[doc_id].append(ids + [end_id])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, r.doc_tokens, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, copies in wanted.items():
        total = sum(len(x) for x in copies)
        assert sum(len(p[2]) for p in pieces[doc_id]) == total
        if len(copies) == 1:
            assert [i for p in sorted(pieces[doc_id]) for i in p[2]] == copies[0]
            assert {p[1] for p in pieces[doc_id]} == {total}
    assert set(pieces) == set(wanted)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return [sum(n for _, n in parts) for parts in sequences.values()]


@pytest.mark.parametrize("capacity,max_open", [(64, 1024), (64, 2), (4096, 1024)])
def test_packing(odd_documents, texts, capacity, max_open):
    rows = packing.pack(odd_documents, WORD, 2, capacity, max_open).collect()
    docs = [(r.doc_id, library_ids(WORD, [r.text])[0]) for r in odd_documents.collect()]
    sizes = check_packing(rows, docs, capacity)
    assert all(n == capacity or n & (n - 1) == 0 for n in sizes)      # no padding at all


def test_whole_sequences(odd_documents):
    pieces = packing.pack(odd_documents, WORD, 2, 64)
    for r in packing.sequences(pieces, 64, pad_id=7).collect():
        n = len(r.ids) // 4
        assert n == 64 or n == r.n_tokens
    assert pieces.sparkSession.createDataFrame([], odd_documents.schema).count() == 0


def test_sum_of_squares_choice():
    """Each tail goes where the sum of squared level counts grows least (checked by trying every level)."""
    rng = np.random.default_rng(5)
    p = packing.Packer(16, 10**6, 0)
    for k in range(400):
        size = int(rng.integers(1, 16))
        before, best = p.levels.copy(), None
        for level in range(0, 17 - size):
            if level and not before[level]:
                continue
            after = before.copy()
            after[level] -= level > 0
            if level + size < 16:
                after[level + size] += 1
            cost = int((after ** 2).sum())
            best = cost if best is None else min(best, cost)
        p.add(k, b"\0\0\0\0" * size)
        assert int((p.levels ** 2).sum()) == best


def test_counts(odd_documents, texts):
    for head in (0, 5, 1 << 17):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens)
                     for r in token_counts.count_tokens(odd_documents, BYTE, head).collect())
        want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()),
                       len(library_ids(BYTE, [r.text])[0])) for r in odd_documents.collect())
        assert got == want


def test_counts_of_mixed_texts(spark, tmp_path):
    texts = mixed_texts()[::7] + ["-" * 300 + " x", None] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    other = Tokenizer.from_file(BYTE)
    other.pre_tokenizer = __import__("tokenizers").pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "t.json"))
    for path, head in ((BYTE, 30), (BYTE, 1 << 17), (WORD, 30), (str(tmp_path / "t.json"), 30)):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path, head).collect()}
        assert got == {i: (len((x or "").encode()), len(ids))
                       for i, (x, ids) in enumerate(zip(texts, library_ids(path, texts)))}


def test_count_query(spark):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op3_token_counts(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [len(x) for x in library_ids(BYTE, [d.text for d in docs])]
    assert got == {d.doc_id: (len((d.text or "").encode()), n, n > 1024) for d, n in zip(docs, want)}


def test_store_round_trip(spark, odd_documents):
    path = scratch_path(spark, "test-tokens")
    token_store.write_tokens(odd_documents, path, BYTE, 0)
    rows = token_store.read_tokens(spark, path).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    want = sorted(((x.doc_id, library_ids(BYTE, [x.text])[0] + [0]) for x in odd_documents.collect()), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=repr) == want
    one = token_store.read_tokens(spark, path, 24, 24)
    assert {r.doc_id for r in one.collect()} == {24}
    assert "ids" not in token_store.read_metadata(spark, path).columns


def test_store_query(spark):
    got = {r.doc_id: r for r in queries.op7_token_store(spark, SF).collect()}
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    at = 0
    for d, ids in zip(docs, library_ids(BYTE, [d.text for d in docs])):
        ids = ids + [0]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_tables(spark, odd_documents):
    empty = spark.createDataFrame([], odd_documents.schema)
    assert packing.pack(empty, WORD, 2).count() == 0
    assert token_counts.count_tokens(empty, BYTE).count() == 0
    path = scratch_path(spark, "test-empty")
    token_store.write_tokens(empty, path, BYTE, 0)
    assert token_store.read_tokens(spark, path).count() == 0

"""Token counts without materialised ids: pieces counted once per distinct pre-token.

A pre-token here is a chunk of a text (see ``tokens``): plain characters
between two spaces, or one of the library's own pre-tokens where a text has
other characters.  No token crosses its borders, so a text's count is the sum
of its chunks' counts.

1. Frequent chunks: each slice of a task reports chunks it meets at least
   ``LOCAL_MIN`` times; summed over the corpus, the most frequent (at most
   ``head_limit``, found by a histogram of the sums) form the head table,
   whose pieces are counted once and broadcast.  Which chunks are in the head
   affects the cost only.
2. Every document is read as chunk frequencies.  The head's part is summed in
   place; the other (document, chunk, frequency) rows are shuffled by chunk,
   where each distinct chunk is counted once and joined to its frequencies.
   Chunks too long for the head may be frequent as well; each is dealt to
   ``SPREAD`` tasks by row.
3. Sum per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, slices
from .tokens import LONGEST_KEPT, encoder

LOCAL_MIN, SPREAD = 4, 32


def frequent_chunks(rows: DataFrame, tokenizer: str, head_limit: int) -> dict[str, int]:
    """At most ``head_limit`` frequent chunks of at most 64 characters, with their numbers of pieces."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        for batch in slices(batches):
            if codes.kind == "whole":
                continue
            distinct, index, _ = codes.chunks_of(batch.column("text"))
            n = np.bincount(index, minlength=len(distinct))
            often = [i for i in np.flatnonzero(n >= LOCAL_MIN).tolist() if len(distinct[i]) <= LONGEST_KEPT]
            yield pa.RecordBatch.from_arrays([pa.array([distinct[i] for i in often], pa.string()),
                                              pa.array(n[often].astype(np.int64))], ["chunk", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        for batch in batches:
            chunks = batch.column("chunk")
            yield pa.RecordBatch.from_arrays(
                [chunks, pa.array([len(codes.chunk_ids(c)) // 4 for c in chunks.to_pylist()], pa.int64())],
                ["chunk", "pieces"])

    counted = cut(rows.select("text").mapInArrow(local, "chunk string, n long").groupBy("chunk")
                  .agg(F.sum("n").alias("n")), "frequent")
    # 8 buckets for each doubling of the count: a few hundred rows whatever the corpus
    bucket = F.floor(F.log2("n") * 8)
    sizes = counted.groupBy(bucket.alias("b")).count().orderBy(F.desc("b")).collect()
    total, least = 0, None
    for b, n in sizes:
        total += n
        if total > head_limit:
            break
        least = b
    if least is None:
        return {}
    head = counted.where(bucket >= least).select("chunk").mapInArrow(pieces, "chunk string, pieces long")
    return {r.chunk: r.pieces for r in head.collect()}      # at most head_limit short strings


def count_tokens(docs: DataFrame, tokenizer: str, head_limit: int = 1 << 17,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row's whole text, as the tokenizers library counts them.

    No begin, end or added special tokens; special strings inside texts as the
    library's default; no truncation.  A null text counts as empty (0, 0);
    repeated ids and rows stay rows of their own; an empty table gives no rows.
    """
    rows = documents(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    head = rows.sparkSession.sparkContext.broadcast(frequent_chunks(rows, tokenizer, head_limit))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, known = encoder(tokenizer), head.value
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            n, texts = batch.num_rows, batch.column("text")
            row_ids = np.arange(row, row + n)
            row += n
            tokens = np.zeros(n, np.int64)
            if codes.kind == "whole":
                tokens[:] = [len(x) for x in codes.whole(texts.to_pylist())]
                texts = pa.array([""] * n, pa.string())
            distinct, index, bounds = codes.chunks_of(texts)
            of = np.repeat(np.arange(n), np.diff(bounds))
            pieces = np.fromiter((known.get(c, -1) for c in distinct), np.int64, len(distinct))
            pieces[[i for i, c in enumerate(distinct) if not c]] = 0
            found = pieces[index]
            seen = found >= 0
            tokens += np.bincount(of[seen], found[seen], n).astype(np.int64)
            rest, freq = np.unique(of[~seen] * len(distinct) + index[~seen], return_counts=True)
            owner, chunk = np.divmod(rest, max(len(distinct), 1))
            used, place = np.unique(chunk, return_inverse=True)
            strings = pa.array([distinct[i] for i in used.tolist()], pa.string()).take(pa.array(place))
            k = len(rest)
            schema = pa.schema([("row_id", pa.int64()), ("doc_id", batch.schema.field("doc_id").type),
                                ("n_bytes", pa.int64()), ("tokens", pa.int64()), ("chunk", pa.string()),
                                ("freq", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_ids), batch.column("doc_id"),
                 pc.binary_length(batch.column("text")).cast(pa.int64()),
                 pa.array(tokens), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())], schema=schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_ids[owner]), pa.nulls(k, schema.field("doc_id").type), pa.nulls(k, pa.int64()),
                 pa.nulls(k, pa.int64()), strings, pa.array(freq.astype(np.int32))], schema=schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        for batch in batches:
            coded = batch.column("chunk").dictionary_encode()
            pieces = np.array([len(codes.chunk_ids(c)) // 4 for c in coded.dictionary.to_pylist()], np.int64)
            tail = pc.is_valid(coded).to_numpy(zero_copy_only=False)
            tokens = batch.column("tokens").fill_null(0).to_numpy().copy()
            tokens[tail] = (pieces[coded.indices.filter(pa.array(tail)).to_numpy()]
                            * batch.column("freq").filter(pa.array(tail)).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens)],
                ["row_id", "doc_id", "n_bytes", "tokens"])

    parts = rows.mapInArrow(frequencies, f"row_id long, doc_id {id_type}, n_bytes long, tokens long, "
                                         "chunk string, freq int")
    spread = F.when(F.length("chunk") > LONGEST_KEPT, F.col("row_id") % SPREAD)
    by_chunk = (parts.repartition(F.coalesce("chunk", F.col("row_id").cast("string")), spread)
                .sortWithinPartitions("chunk"))
    return (by_chunk.mapInArrow(joined, f"row_id long, doc_id {id_type}, n_bytes long, tokens long")
            .groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                   F.sum("tokens").alias("n_tokens")).drop("row_id"))

"""Packing: sum-of-squares online placement of documents into windows of a fixed number of tokens.

``levels[h]`` counts the windows of this task that hold ``h`` tokens.  Each
document's tail (what is left after its full windows) goes to the fill level
that makes the sum of the squared counts smallest.  A window leaves memory as
soon as it is full.  When a task's documents end, or when more than
``max_open`` windows wait, the emptiest windows are cut up to fill the fullest;
what is left of the very last one becomes sequences of 2**k tokens, so that no
sequence needs padding.

Every task packs its own documents: no shuffle, memory bounded by ``max_open``
windows, and a task that is run again on the same rows gives the same
sequences.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices
from .tokens import encoder

SCHEMA = ("doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


class Packer:
    """Windows of one task; a piece is (doc_id, start, doc_tokens, ids as little-endian bytes)."""

    def __init__(self, capacity: int, max_open: int, first_sequence: int):
        self.capacity, self.max_open = capacity, max_open
        self.next_sequence = first_sequence
        self.levels = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list]] = defaultdict(list)
        self.done: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total, start, step = len(ids) // 4, 0, self.capacity
        while total - start >= step:
            self._close([(doc_id, start, total, ids[start * 4:(start + step) * 4])])
            start += step
        if start < total:
            self._place((doc_id, start, total, ids[start * 4:]))

    def _place(self, piece: tuple) -> None:
        size, top = len(piece[3]) // 4, self.capacity
        # change of the sum of squares when a window of level h gets the piece; a new window at h = 0
        change = 2 * (self.levels[size:top + 1] - self.levels[:top - size + 1]) + 2
        change[0] = 2 * self.levels[size] + 1
        change[-1] = 1 - 2 * self.levels[top - size]
        empty = self.levels[:top - size + 1] == 0
        empty[0] = False
        change[empty] = np.iinfo(np.int64).max
        level = int(top - size - np.argmin(change[::-1]))     # the fullest of the best
        window = self.windows[level].pop() if level else []
        self.levels[level] -= level > 0
        window.append(piece)
        if level + size == top:
            self._close(window)
            return
        self.windows[level + size].append(window)
        self.levels[level + size] += 1
        if self.levels.sum() > self.max_open:
            self._merge(last=False)

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, total, ids in window:
            self.done.append((doc_id, start, len(ids) // 4, total, self.next_sequence, offset, ids))
            offset += len(ids) // 4
        self.next_sequence += 1

    def _merge(self, last: bool) -> None:
        """Cut the emptiest windows to fill the fullest; one window that is not full remains at most."""
        waiting = deque(w for level in sorted(self.windows, reverse=True) for w in self.windows[level])
        self.windows.clear()
        self.levels[:] = 0
        loose: list[tuple] = []                       # pieces of the window that is being cut up
        while waiting or loose:
            window = waiting.popleft() if waiting else []
            fill = sum(len(p[3]) for p in window) // 4
            while fill < self.capacity and (loose or waiting):
                loose = loose or waiting.pop()
                doc_id, start, total, ids = loose.pop()
                free = (self.capacity - fill) * 4
                window.append((doc_id, start, total, ids[:free]))
                fill += len(ids[:free]) // 4
                if len(ids) > free:
                    loose.append((doc_id, start + free // 4, total, ids[free:]))
            if fill == self.capacity:
                self._close(window)
            elif last:
                self._close_powers(window, fill)
            else:
                self.windows[fill].append(window)
                self.levels[fill] += 1

    def _close_powers(self, window: list[tuple], fill: int) -> None:
        pieces = iter(window)
        piece = next(pieces)
        for power in reversed(range(fill.bit_length())):
            want, part = (fill & (1 << power)) * 4, []
            while want:
                doc_id, start, total, ids = piece
                part.append((doc_id, start, total, ids[:want]))
                if len(ids) > want:
                    piece, want = (doc_id, start + want // 4, total, ids[want:]), 0
                else:
                    want -= len(ids)
                    piece = next(pieces, None)
            if part:
                self._close(part)

    def finish(self) -> None:
        self._merge(last=True)

    def taken(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, max_open: int = 1024,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token ids of whole documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, start`` (ids of its document before
    it), ``length, doc_tokens`` (with the end id), ``sequence_id, offset``
    (its place in the sequence) and ``ids`` (little-endian unsigned 32-bit).
    Each id lies in exactly one piece.  A null text counts as empty and packs
    its end id; null and repeated ids stay as they are, every row is packed;
    an empty table gives no rows; other columns are ignored.
    """
    rows = documents(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes = encoder(tokenizer)
        packer = Packer(capacity, max_open, TaskContext.get().partitionId() << 40)
        end, schema = np.array([end_id], "<u4").tobytes(), None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.taken())) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in slices(batches):
            schema = schema or pa.schema([("doc_id", batch.schema.field("doc_id").type), ("start", pa.int64()),
                                          ("length", pa.int64()), ("doc_tokens", pa.int64()),
                                          ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
            ids, counts = codes.encode(batch.column("text"))
            raw, at = ids.tobytes(), 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                packer.add(doc_id, raw[at:at + 4 * n] + end)
                at += 4 * n
            yield out()
        if schema:
            packer.finish()
            yield out()

    return rows.mapInArrow(run, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))


def sequences(pieces: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """Whole sequences of ``pack``: ``sequence_id, n_tokens, ids`` padded to ``capacity`` unless a power of two.

    No pieces give no sequences; null document ids and empty texts (a piece of
    the end id alone) are pieces like any other.
    """
    pad = F.lit(int(pad_id).to_bytes(4, "little"))
    whole = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    power = F.bit_count("n_tokens") == 1
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    padding = F.aggregate(F.array_repeat(pad, F.when(power, 0).otherwise(capacity - F.col("n_tokens")).cast("int")),
                          F.lit(b""), lambda a, p: F.concat(a, p))
    return whole.select("sequence_id", "n_tokens", F.concat(joined, padding).alias("ids"))

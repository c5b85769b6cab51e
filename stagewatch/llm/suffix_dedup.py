"""Removal of repeated byte strings by suffix arrays over shards of candidate text.

A window is a string of ``length`` bytes inside one document.  A window is
repeated if it also starts in a document with a smaller id; every byte of a
repeated window goes.  Suffix arrays over all bytes would have to be merged
over the whole corpus, so the work is first narrowed by content:

1. Runs.  Each window's anchor is the smallest hash of its ``gram``-byte
   strings.  Equal windows have equal anchors, so windows are dealt into
   shards by anchor.  Consecutive windows with one anchor are a run, known by
   (anchor, hash of the run's bytes).  Inside a slice of texts only a run's
   smallest id need ask, as 12 bytes; the slice's other documents with the
   run are known to repeat it, and say so without passing through its shard.
2. A shard sorts its runs.  A run whose twin lies in a smaller document is
   repeated as a whole.  Of the others only the first of its kind remains, and
   only if its anchor has different runs: their bytes are fetched.
3. Suffix shards.  Fetched runs are sorted by (anchor, id) and taken in shards
   of bounded size: Larsson-Sadakane refinement sorts the suffixes, Kasai's
   walk gives the common prefixes, windows that share ``length`` bytes form a
   class, and the class's smallest id decides.  Where an anchor continues from
   shard to shard, the windows of the shards before (smaller ids, by the sort)
   are merged in by binary search.
4. An anchor with more than ``hot`` different runs would fill one task: its
   windows are dealt out one by one by their bytes instead, pre-aggregated.

Nothing is capped: the steps differ in cost only.  Equality of whole runs is
that of 96 bits of hash; all other comparisons are of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, slices, text_or_empty

SUFFIX_SHARD_BYTES = 2_000_000
RUN_SLICE_BYTES = 2_000_000
FOLD_RUNS = 2_000_000
NO_ID = np.iinfo(np.int64).max
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_LOW48 = np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _C
    x ^= x >> np.uint64(29)
    x *= _A
    return x ^ (x >> np.uint64(32))


def _words(raw: bytes, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from every position on, as numbers."""
    return np.ndarray((len(raw) - 7,), kind, raw, 0, (1,))


class Runs:
    """Runs of a batch of texts: document (index), start and end of the windows in the joined bytes, anchor and key."""

    def __init__(self, texts: pa.Array, length: int, gram: int):
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        total = int(self.ends[-1]) if len(sizes) else 0
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        data = texts.buffers()[2]
        self.raw = (data.to_pybytes()[offsets[0]:offsets[-1]] if data is not None else b"") + bytes(length + 8)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        if not total:
            self.doc = self.begin = self.end = np.empty(0, np.int64)
            self.anchor = self.key = np.empty(0, np.uint64)
            return
        words = _words(self.raw)
        n, steps = total + length - gram, length - gram + 1
        value = np.zeros(n, np.uint64)
        for at in [*range(0, gram - 7, 8), gram - 8]:
            value = _mix(value * _A + words[at:at + n])
        reach = 1
        while reach * 2 <= steps:
            value = np.minimum(value[:-reach], value[reach:])
            reach *= 2
        if steps > reach:
            value = np.minimum(value[:reach - steps], value[steps - reach:])
        window = np.arange(total) + length <= self.ends[owner]
        value = value[:total]
        first = window.copy()
        first[1:] &= (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]) | ~window[:-1]
        last = window.copy()
        last[:-1] &= first[1:] | ~window[1:]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = owner[self.begin]
        self.anchor = _mix(value[self.begin])
        # hash of a run's bytes: a polynomial of mixed 8-byte words, from prefix sums
        power = np.cumprod(np.full(len(words), _B))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words ^ _B) * power)])
        inverse = np.cumprod(np.full(len(words), np.uint64(pow(int(_B), -1, 1 << 64))))
        part = (sums[self.end + (length - 8)] - sums[self.begin]) * inverse[self.begin]
        self.key = _mix(part ^ (self.end - self.begin).astype(np.uint64) * _A)


def _joint(anchor: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for a run inside its document."""
    return (anchor & _LOW48) * _A ^ (key & _LOW48) * _B


def _pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy()


def _firsts(ids: np.ndarray, anchors: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the smallest id of each distinct run, and of the greater ids, each once per run: those repeat it."""
    order = np.lexsort((ids, keys, anchors))
    ids, anchors, keys = ids[order], anchors[order], keys[order]
    new_run = np.r_[True, (anchors[1:] != anchors[:-1]) | (keys[1:] != keys[:-1])]
    fresh = new_run | np.r_[True, ids[1:] != ids[:-1]]
    return order[new_run], order[fresh & (ids > ids[new_run][np.cumsum(new_run) - 1])]


def _resolve(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], hot: int) -> list[np.ndarray]:
    """Of a shard's runs (ids, anchors, keys): id, joint key and kind of those repeated (0), to be compared (1) or
    to be dealt out (2), each once."""
    ids, anchors, keys = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, keys, anchors))
    ids, anchors, keys = ids[order], anchors[order], keys[order]
    new_anchor = np.r_[True, anchors[1:] != anchors[:-1]]
    new_run = new_anchor | np.r_[True, keys[1:] != keys[:-1]]
    run, group = np.cumsum(new_run) - 1, np.cumsum(new_anchor) - 1
    first = ids[new_run]                                       # the smallest id of each distinct run
    group_of = group[new_run]
    starts = np.flatnonzero(np.r_[True, group_of[1:] != group_of[:-1]])
    several = np.minimum.reduceat(first, starts) < np.maximum.reduceat(first, starts)
    number = np.diff(np.r_[starts, len(group_of)])
    fresh = new_run | np.r_[True, ids[1:] != ids[:-1]]         # once per document
    repeated = first[run] < ids
    kind = np.where(repeated, 0, np.where(number[group] <= hot, 1, 2))
    use = np.flatnonzero(fresh & (repeated | several[group]))
    return [ids[use], _joint(anchors[use], keys[use]).view(np.int64), kind[use].astype(np.int32)]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes or more (Larsson-Sadakane refinement).

    Groups are sorted by 8 bytes first; each round sorts those that are not
    single by the group of the suffix behind the part already compared, which
    doubles the part.
    """
    n = len(text)
    order = np.argsort(_words(text.tobytes() + bytes(8), ">u8")[:n].astype(np.uint64), kind="stable")
    head = _words(text.tobytes() + bytes(8), ">u8")[:n].astype(np.uint64)[order]
    new = np.r_[True, head[1:] != head[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    slots = np.arange(n)
    h = 8
    while True:
        last = np.r_[np.flatnonzero(new)[1:] - 1, n - 1]       # a group is named after its last place
        rank[order] = last[np.cumsum(new) - 1]
        if h >= depth:
            return order
        open_ = slots[~(new & np.r_[new[1:], True])]
        if not len(open_):
            return order
        some = order[open_]
        pair = rank[some] * (n + 1) + rank[np.minimum(some + h, n)] + 1
        place = np.argsort(pair, kind="stable")
        order[open_] = some[place]
        pair = pair[place]
        new[open_] = np.r_[True, pair[1:] != pair[:-1]]
        h *= 2


def common_prefixes(text: np.ndarray, sorted_windows: np.ndarray, begins: np.ndarray, counts: np.ndarray,
                    length: int) -> np.ndarray:
    """Of each sorted window, the bytes it shares with the one before, at most ``length`` (Kasai's walk).

    The walk goes through the windows of a run in text order and gives up one
    byte a step, as long as the neighbour's next window is a window too and
    still sorted before; all runs are walked at once.
    """
    n = len(text)
    before = np.full(n + 1, -1)
    before[sorted_windows[1:]] = sorted_windows[:-1]
    place = np.full(n + 1, n)                  # of other positions: behind all windows
    place[sorted_windows] = np.arange(len(sorted_windows))
    shared = np.zeros(n + 1, np.int64)
    live, carry = np.arange(len(begins)), np.zeros(len(begins), np.int64)
    for step in range(int(counts.max(initial=0))):
        live = live[counts[live] > step]
        at = begins[live] + step
        prev = before[at]
        have = np.where(prev >= 0, carry[live], 0)
        grow = np.flatnonzero(prev >= 0)
        while len(grow):
            h = have[grow]
            grow = grow[(h < length)]
            grow = grow[text[at[grow] + have[grow]] == text[prev[grow] + have[grow]]]
            have[grow] += 1
        shared[at] = have
        carry[live] = np.where((prev >= 0) & (place[prev + 1] < place[at + 1]), np.maximum(have - 1, 0), 0)
    return shared[sorted_windows]


class Merger:
    """Repeated windows of runs that come sorted by (anchor, id), a shard at a time."""

    def __init__(self, length: int):
        self.length, self.anchor = length, None
        self.known = np.empty(0, f"S{length}")       # sorted windows of the anchor that the last shard ended with

    def shard(self, anchors: np.ndarray, ids: np.ndarray, runs: list[bytes]) -> list[np.ndarray]:
        """For each run: which of its windows start in a document with a smaller id."""
        length = self.length
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        text = np.frombuffer(b"".join(runs) + bytes(length), np.uint8)
        begins, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        owner = np.repeat(np.arange(len(runs)), counts)
        starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        of = np.full(len(text), -1)
        of[starts] = owner
        order = suffix_array(text, length)
        order = order[of[order] >= 0]
        shared = common_prefixes(text, order, begins, counts, length)
        group = np.cumsum(shared < length) - 1
        least = np.minimum.reduceat(ids[of[order]], np.flatnonzero(shared < length))
        repeated = np.zeros(len(text), bool)
        repeated[order] = least[group] < ids[of[order]]

        def windows(of_runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = starts[np.isin(owner, of_runs)]
            return at, np.ascontiguousarray(text[at[:, None] + np.arange(length)]).view(f"S{length}").ravel()

        if self.anchor is not None and anchors[0] == self.anchor and len(self.known):
            at, value = windows(np.flatnonzero(anchors == self.anchor))
            place = np.minimum(np.searchsorted(self.known["w"], value), len(self.known) - 1)
            found = self.known[place]
            repeated[at] |= (found["w"] == value) & (found["id"] < ids[of[at]])
        self._keep(anchors, ids, of, windows)
        return [repeated[b:b + c] for b, c in zip(begins.tolist(), counts.tolist())]

    def _keep(self, anchors, ids, of, windows) -> None:
        """Keep the distinct windows of the shard's last anchor with their smallest ids, for the next shard."""
        same = self.anchor is not None and anchors[-1] == self.anchor
        at, value = windows(np.flatnonzero(anchors == anchors[-1]))
        rows = np.empty(len(at), [("w", f"S{self.length}"), ("id", np.int64)])
        rows["w"], rows["id"] = value, ids[of[at]]
        if same and len(self.known):
            rows = np.concatenate([self.known, rows])
        rows = rows[np.lexsort((rows["id"], rows["w"]))]
        self.known = rows[np.r_[True, rows["w"][1:] != rows["w"][:-1]]] if len(rows) else rows
        self.anchor = anchors[-1]


def _per_document(shards: DataFrame) -> DataFrame:
    kinds = [F.collect_list(F.when(F.col("kind") == k, F.col("joint"))).alias(n)
             for k, n in enumerate(("repeated", "compare", "deal"))]
    return shards.groupBy(F.nullif("run_id", F.lit(int(NO_ID))).alias("run_id")).agg(*kinds)


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 20, shard_bytes: int = 16_000_000,
                   hot: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row: the removed byte spans (start, end) and the bytes that stay.

    Ids are integers.  A null id counts as the largest integer; rows that share an id are one
    document's, so a string they share is not repeated by that; a string that
    occurs twice in one document is not repeated by that either.  Null texts
    are empty; texts shorter than ``length`` keep all; an empty table gives no
    rows; other columns are ignored.
    """
    if not 8 <= gram <= length:
        raise ValueError("8 <= gram <= length")
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=RUN_SLICE_BYTES):
            runs, ids = Runs(batch.column("text"), length, gram), _ids(batch)
            if not len(runs.doc):
                continue
            first, again = _firsts(ids[runs.doc], runs.anchor, runs.key)
            shard = (runs.anchor[first] >> np.uint64(40)) % np.uint64(n_shards)
            order = first[np.lexsort((runs.doc[first], shard))]
            shard, doc = np.sort(shard), runs.doc[order]
            bounds = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            out = []
            for b, e in zip(bounds.tolist(), np.r_[bounds[1:], len(order)].tolist()):
                of, counts = np.unique(doc[b:e], return_counts=True)
                out.append((int(shard[b]), ids[of].astype("<i8").tobytes(), counts.astype("<i4").tobytes(),
                            _pack48(runs.anchor[order[b:e]]), _pack48(runs.key[order[b:e]])))
            if len(again):          # answered already: any task may pass them on, a negative shard spreads them
                joint = _joint(runs.anchor[again], runs.key[again])
                out.append((-1 - int(joint[0] >> np.uint64(2)), ids[runs.doc[again]].astype("<i8").tobytes(), b"", b"",
                            joint.astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] + [pa.binary()] * 4)],
                ["shard", "ids", "counts", "anchors", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns):
            for at in range(0, len(columns[0]), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 500_000]) for c in columns],
                                                 ["run_id", "joint", "kind"])

        def known(ids, joints):
            return out([ids, joints.view(np.int64), np.zeros(len(ids), np.int32)])

        shard, parts, held, most = None, [], 0, FOLD_RUNS
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("shard", "ids", "counts", "anchors", "keys"))):
                number, ids, counts, anchors, keys = (x.as_py() for x in row)
                if number < 0:
                    yield from known(np.frombuffer(ids, "<i8"), np.frombuffer(keys, "<u8"))
                    continue
                if number != shard and parts:
                    yield from out(_resolve(parts, hot))
                    parts, held, most = [], 0, FOLD_RUNS
                shard = number
                parts.append((np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i4")),
                              _unpack48(anchors), _unpack48(keys)))
                held += len(parts[-1][0])
                if held >= most:            # only distinct runs are held on
                    ids, anchors, keys = (np.concatenate(x) for x in zip(*parts))
                    first, again = _firsts(ids, anchors, keys)
                    yield from known(ids[again], _joint(anchors[again], keys[again]))
                    parts, held = [(ids[first], anchors[first], keys[first])], len(first)
                    most = max(FOLD_RUNS, 2 * held)
        if parts:
            yield from out(_resolve(parts, hot))

    asked = rows.mapInArrow(ask, "shard long, ids binary, counts binary, anchors binary, keys binary")
    shards = asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        answer, "run_id long, joint long, kind int")
    answers = cut(_per_document(shards), "repeated-runs")
    # the texts are shuffled once: the uses below have the same columns of the same exchange
    known = rows.join(answers, F.col("doc_id").eqNullSafe(F.col("run_id")), "left").drop("run_id")

    def listed(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
        """The keys that are listed in a column, with their rows."""
        lists = batch.column(column)
        counts = pc.list_value_length(lists).fill_null(0).to_numpy()
        return np.repeat(np.arange(len(counts)), counts), lists.flatten().to_numpy().view(np.uint64)

    def chosen(runs: Runs, of: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Which runs are listed for their document."""
        if not len(values) or not len(runs.doc):
            return np.zeros(len(runs.doc), bool)
        mark = lambda doc, joint: _mix(doc.astype(np.uint64) * _A + _mix(joint.astype(np.uint64)))
        return np.isin(mark(runs.doc, _joint(runs.anchor, runs.key)), mark(of, values))

    def fetch(column: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = (b.filter(pc.greater(pc.list_value_length(b.column(column)).fill_null(0), 0)) for b in batches)
            for batch in slices(wanted, limit=RUN_SLICE_BYTES):
                of, values = listed(batch, column)
                runs, ids = Runs(batch.column("text"), length, gram), _ids(batch)
                use = np.flatnonzero(chosen(runs, of, values))
                joint = _joint(runs.anchor, runs.key)[use].view(np.int64)
                _, once = np.unique(np.stack([ids[runs.doc[use]], joint], axis=1), axis=0, return_index=True)
                use, joint = use[once], joint[once]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.anchor[use].view(np.int64)), pa.array(ids[runs.doc[use]]),
                     pa.array(joint),
                     pa.array([runs.raw[b:e + length - 1] for b, e in zip(runs.begin[use].tolist(),
                                                                          runs.end[use].tolist())], pa.binary())],
                    ["anchor", "run_id", "joint", "bytes"])
        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, held, size = Merger(length), [], 0

        def out():
            anchors, ids, joints, runs = zip(*held)
            marks = merger.shard(np.array(anchors), np.array(ids), list(runs))
            some = [(i, j, np.packbits(m).tobytes()) for i, j, m in zip(ids, joints, marks) if m.any()]
            columns = list(zip(*some)) or [[]] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))],
                ["run_id", "joint", "marks"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "run_id", "joint", "bytes"))):
                held.append(row)
                size += len(row[3])
                if size >= SUFFIX_SHARD_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    fetched = "anchor long, run_id long, joint long, bytes binary"
    marks = (known.select("doc_id", "text", "compare").mapInArrow(fetch("compare"), fetched)
             .repartition("anchor").sortWithinPartitions("anchor", "run_id")
             .mapInArrow(compare, "run_id long, joint long, marks binary")
             .withColumn("places", F.lit(None).cast("array<int>")))
    if not answers.where(F.size("deal") > 0).isEmpty():
        # hot anchors: windows dealt by their bytes; the smallest id of each is a partial aggregate
        hot_runs = cut(known.select("doc_id", "text", "deal").mapInArrow(fetch("deal"), fetched), "hot-runs")
        windows = (hot_runs.select("run_id", "joint", "bytes",
                           F.posexplode(F.sequence(F.lit(1), F.octet_length("bytes") - length + 1)).alias("at", "from"))
                   .select("run_id", "joint", "at", F.substring("bytes", F.col("from"), F.lit(length)).alias("w")))
        least = windows.groupBy("w").agg(F.min("run_id").alias("least"))
        marks = marks.unionByName(
            windows.join(least, "w").where("least < run_id").groupBy("run_id", "joint")
            .agg(F.collect_list("at").alias("places"))
            .select("run_id", "joint", F.lit(None).cast("binary").alias("marks"), "places"))
    marks = marks.groupBy(F.nullif("run_id", F.lit(int(NO_ID))).alias("mark_id")).agg(
        F.collect_list(F.struct("joint", "marks", "places")).alias("marks"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, limit=RUN_SLICE_BYTES):
            runs = Runs(batch.column("text"), length, gram)
            of, values = listed(batch, "repeated")
            whole = np.flatnonzero(chosen(runs, of, values))
            begin, end = [runs.begin[whole]], [runs.end[whole] + length - 1]
            parts = {}
            for row, found in enumerate(batch.column("marks").to_pylist()):
                for m in found or ():
                    parts[row, m["joint"]] = m
            if parts:
                joint = _joint(runs.anchor, runs.key).view(np.int64)
                for r in np.flatnonzero(np.isin(joint, np.array([j for _, j in parts], np.int64))).tolist():
                    m = parts.get((int(runs.doc[r]), int(joint[r])))
                    if m is not None:
                        at = (np.flatnonzero(np.unpackbits(np.frombuffer(m["marks"], np.uint8)))
                              if m["marks"] is not None else np.array(m["places"], np.int64))
                        begin.append(runs.begin[r] + at)
                        end.append(runs.begin[r] + at + length)
            total = int(runs.ends[-1])
            change = (np.bincount(np.concatenate(begin), minlength=total + 1)
                      - np.bincount(np.concatenate(end), minlength=total + 1))
            gone = np.concatenate([[False], np.cumsum(change)[:total] > 0, [False]])
            starts = np.flatnonzero(gone[1:-1] & ~gone[:-2])
            stops = np.flatnonzero(gone[1:-1] & ~gone[2:]) + 1
            base = runs.ends - runs.sizes
            # removed runs of neighbouring documents may touch: cut them at the documents' borders
            border = base[(base > 0) & (base < total)]
            border = border[gone[1:-1][border] & gone[:-2][border]]
            starts, stops = np.unique(np.r_[starts, border]), np.unique(np.r_[stops, border])
            doc = np.searchsorted(runs.ends, starts, "right")
            spans = [[] for _ in range(batch.num_rows)]
            for d, s, e in zip(doc.tolist(), (starts - base[doc]).tolist(), (stops - base[doc]).tolist()):
                spans[d].append({"start": s, "end": e})
            stay = ~gone[1:-1]
            left = np.frombuffer(runs.raw, np.uint8, total)[stay].tobytes()
            counts = np.concatenate([[0], np.cumsum(stay)])
            bounds = np.concatenate([[0], counts[runs.ends]])
            kept = pa.array([left[b:e] for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(runs.sizes), pa.array(spans, span), kept],
                ["doc_id", "n_bytes", "spans", "kept"])

    final = known.join(marks, F.col("doc_id").eqNullSafe(F.col("mark_id")), "left")
    return final.select("doc_id", "text", "repeated", "marks").mapInArrow(
        remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")

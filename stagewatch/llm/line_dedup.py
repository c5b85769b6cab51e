"""Line dedup: a sharded minimal perfect hash over distinct line hashes, probed by the documents.

1. A line's key is the line without white space at its ends, A-Z lower-cased.
   Keys become 128-bit hashes; an aggregate counts the documents of each
   distinct hash and finds the largest id among them.
2. The hashes of keys that are frequent enough are dealt into shards.  Each
   shard is a minimal perfect hash (levels of bits; a hash's place is the rank
   of its bit) that indexes plain arrays: a fingerprint, the number of
   documents and a hash of the largest id.  That is 20 bytes and a few bits a
   line, whatever its length.
3. Documents probe the arrays; line texts are never shuffled or joined.  Up to
   ``broadcast_bytes`` of arrays go to every executor, and the documents are
   rewritten where they are read.  Beyond it the hashes of the documents'
   lines are dealt to the shards, probe them there, and only ids with the
   hashes they must drop come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, slices

# Fixed value: the white space that is stripped.
SPACE = " \t\n\v\f\r"
#: Distinct hashes a shard is meant to hold, and rows that a task takes of one shard's probes.
SHARD_KEYS, SHARD_PROBES = 4096, 1_000_000
#: Bits a level has for each hash that is left; after the last level the hashes left are listed.
ROOM, LEVELS = 2, 24
KEY = "hi long, lo long"


def line_hashes(lines: pa.Array, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of lines whose key has ``shortest`` code points or more, and the keys' hashes (two 64-bit halves)."""
    keys = pc.ascii_trim(pc.ascii_lower(lines), characters=SPACE)
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), shortest).to_numpy(zero_copy_only=False))
    coded = keys.take(pa.array(long)).dictionary_encode()
    digests = b"".join([blake2b(k.as_buffer(), digest_size=16).digest() for k in coded.dictionary])
    return long, np.frombuffer(digests, "<u8").reshape(-1, 2)[coded.indices.to_numpy()]


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts, and where each text's lines begin."""
    lists = pc.split_pattern(texts, "\n")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(bounds[0], bounds[-1] - bounds[0]), bounds - bounds[0]


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of each hash for every level."""
    with np.errstate(over="ignore"):
        x = hashes[:, 0] ^ (hashes[:, 1] + np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit hashes: numbers from 0 to n - 1, and anything for other hashes."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.placed = int(ones.sum())
        self.at = {r.tobytes(): self.placed + i for i, r in enumerate(rest)}

    @classmethod
    def build(cls, hashes: np.ndarray, levels: int = LEVELS) -> "PerfectHash":
        sizes, words, left = [], [], hashes
        while len(left) and len(sizes) < levels:
            size = -(-len(left) * ROOM // 64) * 64
            bits = _mixed(left, len(sizes)) % np.uint64(size)
            alone = np.bincount(bits.astype(np.int64), minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[bits.astype(np.int64)]]
        return cls(np.array(sizes, np.int64), np.concatenate([np.empty(0, "<u8"), *words]), left)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's number; -1 where none can be."""
        out = np.full(len(hashes), -1, np.int64)
        left, base = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes.tolist()):
            bit = (_mixed(hashes[left], level) % np.uint64(size)).astype(np.int64)
            word, place = base + (bit >> 6), (bit & 63).astype(np.uint64)
            value = self.words[word]
            met = (value >> place) & np.uint64(1) == 1
            lower = np.bitwise_count(value & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
            out[left[met]] = (self.before[word] + lower)[met]
            left, base = left[~met], base + (size >> 6)
        if self.at and len(left):
            out[left] = [self.at.get(h.tobytes(), -1) for h in hashes[left]]
        return out


class Shard:
    """One shard: its perfect hash and the arrays ``prints``, ``counts`` and ``owners`` that it indexes."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.index, self.prints, self.counts, self.owners = index, prints, counts, owners

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> "Shard":
        index = PerfectHash.build(hashes)
        order = np.argsort(index(hashes))
        return cls(index, hashes[order, 1], counts[order].astype("<u4"), owners[order])

    def pack(self) -> bytes:
        head = np.array([len(self.index.sizes), len(self.index.words), len(self.index.rest), len(self.prints)], "<i8")
        parts = [head, self.index.sizes.astype("<i8"), self.index.words, self.index.rest, self.prints,
                 self.owners.astype("<i8"), self.counts]
        return b"".join([np.ascontiguousarray(p).tobytes() for p in parts])

    @classmethod
    def unpack(cls, packed: bytes) -> "Shard":
        levels, words, rest, keys = np.frombuffer(packed, "<i8", 4).tolist()
        at = 32

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(packed, kind, n, at)
            at += out.nbytes
            return out

        index = PerfectHash(read("<i8", levels), read("<u8", words), read("<u8", 2 * rest).reshape(-1, 2))
        prints, owners = read("<u8", keys), read("<i8", keys)
        return cls(index, prints, read("<u4", keys), owners)

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's number of documents (0: not in here) and the hash of its largest id."""
        if not len(self.prints):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        place = self.index(hashes)
        safe = np.maximum(place, 0)
        met = (place >= 0) & (self.prints[safe] == hashes[:, 1])
        return np.where(met, self.counts[safe], 0).astype(np.int64), self.owners[safe]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes[:, 0] % np.uint64(max(shards, 1))).astype(np.int64)


class Shards:
    """All shards of a corpus, as they are sent to executors."""

    def __init__(self, packed: dict[int, bytes], number: int):
        self.packed, self.number, self.open = packed, number, {}

    def __getstate__(self):
        return {"packed": self.packed, "number": self.number, "open": {}}

    def shard(self, number: int) -> Shard | None:
        if number not in self.open and number in self.packed:
            self.open[number] = Shard.unpack(self.packed[number])
        return self.open.get(number)

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, owners = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        dealt = shard_of(hashes, self.number)
        order = np.argsort(dealt, kind="stable")
        met, begins = np.unique(dealt[order], return_index=True)
        for number, own in zip(met.tolist(), np.split(order, begins[1:])):
            shard = self.shard(number)
            if shard is not None:
                counts[own], owners[own] = shard.probe(hashes[own])
        return counts, owners


def _id_hash(doc_id: Column) -> Column:
    """64 bits that tell ids apart: for integers no two ids share them."""
    return F.xxhash64(doc_id)


def hash_lines(rows: DataFrame, shortest: int) -> DataFrame:
    """``doc_id, hi, lo`` of every line of ``rows`` (``doc_id, text``) whose key is long enough; once per text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines, bounds = split_lines(batch.column("text"))
            long, hashes = line_hashes(lines, shortest)
            if not len(long):
                continue
            text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))[long]
            both = np.column_stack([text.astype("<u8"), hashes])
            order = np.lexsort((both[:, 2], both[:, 1], both[:, 0]))
            both = both[order]
            both = both[np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(both[:, 0].astype(np.int64))),
                 pa.array(both[:, 1].view("<i8")), pa.array(both[:, 2].view("<i8"))], ["doc_id", "hi", "lo"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {KEY}")


def _frequent(lines: DataFrame, least: int) -> DataFrame:
    """``hi, lo, n, owner`` of every hash that ``least`` documents or more hold."""
    # a struct counts a null id too, as the smallest; documents are told apart before the count, so no hash is hot
    one = F.struct("doc_id")
    return lines.groupBy("hi", "lo").agg(F.count_distinct(one).alias("n"), F.max(one).alias("most")).where(
        F.col("n") >= least).select("hi", "lo", "n", _id_hash(F.col("most.doc_id")).alias("owner"))


def _shard_column(shards: int) -> Column:
    return F.expr(f"cast(pmod(cast(hi as decimal(20,0)) + if(hi < 0, 18446744073709551616, 0), {max(shards, 1)}) as int)")


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """``shard, packed`` of ``keys`` (``hi, lo, n, owner``): each shard is built in the task that its keys are dealt to."""
    def build(rows: pa.Table) -> pa.Table:
        halves = [rows.column(c).combine_chunks().to_numpy().view("<u8") for c in ("hi", "lo")]
        counts, owners = (rows.column(c).combine_chunks().to_numpy() for c in ("n", "owner"))
        packed = Shard.build(np.column_stack(halves), np.minimum(counts, 2**32 - 1), owners).pack()
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()),
                         "packed": pa.array([packed], pa.binary())})

    return keys.withColumn("shard", _shard_column(shards)).groupBy("shard").applyInArrow(
        build, "shard int, packed binary")


def _dropped(batch: pa.RecordBatch, shortest: int, drop) -> pa.RecordBatch:
    """Texts without the lines for which ``drop(text numbers, hashes)`` holds."""
    lines, bounds = split_lines(batch.column("text"))
    long, hashes = line_hashes(lines, shortest)
    text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    keep = np.ones(len(lines), bool)
    if len(long):
        keep[long] = ~drop(text[long], hashes)
    n_lines = np.diff(bounds)
    n_kept = np.bincount(text[keep], minlength=batch.num_rows)
    kept = batch.column("text")
    if not keep.all():
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_kept)]), pa.int32())
        kept = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.filter(pa.array(keep))), "\n")
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_lines - n_kept, pa.int64()), kept],
        ["doc_id", "n_lines", "n_dropped", "kept"])


def _rewrite_here(rows: DataFrame, packed: dict[int, bytes], shards: int, shortest: int, least: int, schema: str) -> DataFrame:
    """Every executor holds all shards."""
    shared = rows.sparkSession.sparkContext.broadcast(Shards(packed, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("id_hash").to_numpy()

            def drop(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
                counts, owners = shared.value.probe(hashes)
                return (counts >= least) & (owners != ids[text])

            yield _dropped(batch, shortest, drop)

    return rows.withColumn("id_hash", _id_hash(F.col("doc_id"))).mapInArrow(run, schema)


def _rewrite_dealt(rows: DataFrame, lines: DataFrame, built: DataFrame, shards: int, shortest: int, least: int,
                   schema: str) -> DataFrame:
    """The shards stay where they are: line hashes come to them, and what is to be dropped goes to its document."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    probes = lines.withColumn("shard", _shard_column(shards))
    # a shard that very many lines ask (a very frequent line) is copied, and its probes are split among the copies
    copies = probes.groupBy("shard").agg((F.floor(F.count(F.lit(1)) / SHARD_PROBES) + 1).cast("int").alias("copies"))
    arrays = built.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
                                                "packed", F.lit(0).alias("kind"))
    dealt = probes.join(copies, "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id"), "copies").cast("int").alias("copy"), F.lit(1).alias("kind"), "doc_id",
        "hi", "lo", _id_hash(F.col("doc_id")).alias("id_hash"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            places = np.column_stack([batch.column(c).to_numpy() for c in ("shard", "copy")])
            begins = np.flatnonzero((kinds == 0) | np.concatenate([[True], (places[1:] != places[:-1]).any(axis=1)]))
            for begin, end in zip(begins, [*begins[1:], batch.num_rows]):
                if tuple(places[begin]) != at:
                    at, shard = tuple(places[begin]), None
                if kinds[begin] == 0:
                    shard, begin = Shard.unpack(batch.column("packed")[int(begin)].as_py()), begin + 1
                own = batch.slice(begin, end - begin)
                if shard is None or not own.num_rows:
                    continue
                hashes = np.column_stack([own.column(c).to_numpy().view("<u8") for c in ("hi", "lo")])
                counts, owners = shard.probe(hashes)
                hit = pa.array((counts >= least) & (owners != own.column("id_hash").to_numpy()))
                found = own.filter(hit)
                yield pa.RecordBatch.from_arrays([found.column(c) for c in ("doc_id", "hi", "lo")], ["doc_id", "hi", "lo"])

    both = arrays.unionByName(dealt, allowMissingColumns=True)
    for c in ("hi", "lo", "id_hash"):           # plain columns for the arrays' rows too
        both = both.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
    both = both.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    hits = cut(both.mapInArrow(ask, f"doc_id {id_type}, {KEY}"), "line-hits").groupBy("doc_id").agg(
        F.collect_set(F.struct("hi", "lo")).alias("drop"))            # no more than the document's own lines
    asked = rows.join(hits.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wanted = [{(h["hi"], h["lo"]) for h in hit or ()} for hit in batch.column("drop").to_pylist()]

            def drop(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
                return np.array([tuple(h) in wanted[t] for t, h in zip(text, hashes.view("<i8").tolist())], bool)

            yield _dropped(batch, shortest, drop)

    return asked.select("doc_id", "text", "drop").mapInArrow(run, schema)


def drop_lines(docs: DataFrame, shortest: int = 40, least: int = 5, id_col: str = "doc_id", text_col: str = "text",
               broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of every row: its text without the lines that other documents repeat.

    A line goes if its key has ``shortest`` code points or more, is found in
    ``least`` documents or more, and the document is not the one with the
    largest id among them.  Documents are told apart by id: rows that share an
    id count as one document and all keep the lines that it keeps; a null id
    is one document, smaller than all others.  Texts are split at line feeds;
    a null or empty text is one empty line.  Equal keys are those with equal
    128-bit hashes.  An empty table gives no rows; other columns are ignored.
    """
    rows = documents(docs, id_col, text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept string"
    lines = hash_lines(rows, shortest)
    keys = cut(_frequent(lines, least), "line-keys")
    shards = -(-keys.count() // SHARD_KEYS)
    built = cut(build_shards(keys, shards), "line-shards")
    size = built.agg(F.sum(F.length("packed"))).first()[0] or 0
    if size <= broadcast_bytes:
        return _rewrite_here(rows, {r.shard: bytes(r.packed) for r in built.collect()}, shards, shortest, least, schema)
    return _rewrite_dealt(rows, cut(lines, "line-hashes"), built, shards, shortest, least, schema)

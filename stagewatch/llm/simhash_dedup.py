"""SimHash near-dedup with a byte-position inverted index and count filtering.

A fingerprint has eight bytes.  Two fingerprints that differ in at most d < 8
bits share at least 8 - d bytes at their positions.  The index lists distinct
fingerprints by the values of small sets of byte positions, chosen so that
every set of 8 - d positions holds one of them: each linked pair meets in some
list.  Inside a list, each pair's shared positional bytes are tallied in numpy
blocks; pairs with the guaranteed minimum are verified by their differing
bits.  A list reports a spanning forest of its links, not its pairs, so what
leaves a task is linear in the list; long lists are split into pairs of blocks
over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, quoted, slices, text_or_empty
from .components import components

BLOCK = 4096


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """SimHash of a text's word shingles, as an unsigned number; 0 without words."""
    import xxhash

    words = text.encode("utf-8").lower().split()       # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    values = np.fromiter((hashed(joined[s:e], seed) for s, e in zip((ends - sizes)[:n].tolist(), last.tolist())),
                         np.uint64, n)
    bits = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(n, 64)
    ones = bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def text_key(name: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text_or_empty(name))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, fp`` (signed 64-bit) of every row; null texts count as empty."""
    rows = documents(docs, id_col, text_col).select("doc_id", text_key("text").alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"),
                                              pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def position_sets(shared: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` of the 8 byte positions such that any ``shared`` positions hold one of them."""
    if (shared, size) != (4, 3):
        return list(combinations(range(8), size))
    # with the positions in three classes, triples inside a class or of two from a class and one from the next
    turn = lambda t: sorted(p % 3 for p in t)
    return [t for t in combinations(range(8), 3) if turn(t) in ([0, 0, 0], [1, 1, 1], [2, 2, 2], [0, 0, 1],
                                                               [1, 1, 2], [0, 2, 2])]


def linked(a: np.ndarray, b: np.ndarray, shared: int, distance: int) -> np.ndarray:
    """Which (broadcast) pairs share at least ``shared`` positional bytes and differ in at most ``distance`` bits."""
    differ = a ^ b
    tally = np.zeros(differ.shape, np.uint8)
    for position in range(8):
        tally += (differ >> np.uint64(8 * position)) & np.uint64(255) == 0
    ok = tally >= shared
    ok[ok] = np.bitwise_count(differ[ok]) <= distance
    return ok


def forest(rest: np.ndarray, shared: int, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside a list of distinct fingerprints, found block by block."""
    links: list[tuple[int, int]] = []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            some, front = front[:256], front[256:]
            above = np.full(len(rest), -1)
            for begin in range(0, len(rest), BLOCK):
                ok = linked(some[:, None], rest[None, begin:begin + BLOCK], shared, distance)
                above[begin:begin + BLOCK] = np.where(ok.any(axis=0), ok.argmax(axis=0), -1)
            new = above >= 0
            links += zip(some[above[new]].tolist(), rest[new].tolist())
            front, rest = np.concatenate([front, rest[new]]), rest[~new]
    return links


def near_links(fps: DataFrame, distance: int = 4, index_bytes: int | None = None) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect all within ``distance`` bits.

    ``index_bytes``: positions per index set; 3, and 4 beyond 2**27 distinct
    fingerprints, where lists of 3 would get long.  Either finds all links.
    """
    if not 0 <= distance < 8:
        raise ValueError("at 8 or more differing bits no byte need be shared")
    shared = 8 - distance
    if index_bytes is None:
        index_bytes = 3 if fps.count() <= 1 << 27 else 4
    sets = position_sets(shared, min(index_bytes, shared))
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) for p in range(8)]
    keys = []
    for number, positions in enumerate(sets):
        key = F.lit(number).cast("long")
        for p in positions:
            key = key * 256 + byte[p]
        keys.append(key)
    lists = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK)
    # a long list: every fingerprint in one of its blocks, every pair of blocks a list of its own
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    split = (lists.join(sizes, "key", "left").select(
        "fp", "key", F.explode(F.when(F.col("size").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
                               .otherwise(F.transform(F.sequence(F.lit(0), blocks - 1),
                                                      lambda o: F.struct(F.least(own, o).alias("i"),
                                                                         F.greatest(own, o).alias("j")))))
        .alias("pair")).select("key", "pair.i", "pair.j", "fp"))
    dealt = split.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links):
            pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        held, last = np.empty((0, 4), np.int64), None
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j", "fp")], axis=1)
            held = np.concatenate([held, table])
            change = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)) + 1
            if len(change):
                yield out(links_of(held[:change[-1]]))
                held = held[change[-1]:]
        if len(held):
            yield out(links_of(held))

    def links_of(table: np.ndarray) -> list[tuple[int, int]]:
        begins = np.flatnonzero(np.r_[True, (table[1:, :3] != table[:-1, :3]).any(axis=1)])
        sizes, fp = np.diff(np.r_[begins, len(table)]), table[:, 3].copy().view(np.uint64)
        twos = begins[sizes == 2]
        twos = twos[linked(fp[twos], fp[twos + 1], shared, distance)]
        links = list(zip(fp[twos].tolist(), fp[twos + 1].tolist()))
        for b, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            links += forest(fp[b:b + n], shared, distance)
        return links

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, seed: int = 42, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id reachable over links of fingerprints.

    Fingerprints link at ``distance`` or fewer differing bits.  A text with
    fewer words than the shingle is one shingle; a text without words, null
    texts included, has fingerprint zero and links like any other.  Rows with
    a null id link too and take a component's smallest id (null only if all
    its ids are).  Repeated rows stay; an empty table gives no rows; other
    columns are ignored.
    """
    return _rooted(docs, shingle, distance, seed, id_col, text_col).select("doc_id", "fp", "component_id")


def _rooted(docs: DataFrame, shingle: int, distance: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, fp, root, component_id`` of every row; ``root`` is the component's own name."""
    marked = cut(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    firsts = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    found = components(near_links(firsts.select("fp"), distance))
    rooted = firsts.join(found, firsts["fp"] == found["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(classes, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 4, distance: int = 4, seed: int = 42, id_col: str = "doc_id",
                     text_col: str = "text", unique_ids: bool = True) -> DataFrame:
    """One row of each component, one of its smallest id, with all columns of ``docs``.

    The row is known by its id and text, so rows without an id and different
    texts of one id are told apart.  ``unique_ids``: of components with the
    same smallest id only one gives its row, so that no id (null aside) comes
    twice; otherwise every component does.
    """
    groups = cut(_rooted(docs, shingle, distance, seed, id_col, text_col), "near-groups")
    heads = groups.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).groupBy("root", "doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("copies"))
    by = F.when(F.col("doc_id").isNull(), F.col("root")) if unique_ids else F.col("root")
    stay = heads.groupBy("doc_id", by.alias("by")).agg(F.min(F.struct("text_key", "copies")).alias("head")).select(
        F.col("doc_id").alias("stay_id"), F.col("head.text_key").alias("stay_key"),
        F.col("head.copies").alias("stay_copies"))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(id_col).alias("row_id"),
                       text_key(text_col).alias("row_key"))
    rows = rows.join(stay, F.col("row_id").eqNullSafe(F.col("stay_id")) & (F.col("row_key") == F.col("stay_key")))
    repeated = F.col("stay_copies") > 1
    return (rows.where(~repeated).select("row.*")
            .unionByName(rows.where(repeated).dropDuplicates(["row_id", "row_key"]).select("row.*")))

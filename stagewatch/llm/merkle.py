"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a group, in id order, are the bottom of the
group's tree, and the groups' roots are the bottom of the tree above them.  A
node's label is the place of its last leaf and its level, so children come
before their parent.  Digests are messages in a priority queue ordered by
label: a node takes the messages addressed to it and sends its own digest to
its parent.  The reversed sweep goes through the labels from the end: a node
takes the proof of itself (the siblings from its parent up to the root) and
sends each child that proof with the child's siblings in front.

The queue is external in two parts.  Messages inside a subtree of ``HEIGHT``
levels stay in a heap; messages to nodes beyond it are rows of a table, which
Spark's sorted shuffle delivers by label to the task that holds the next
subtree.  A task meets one subtree (``FAN ** HEIGHT`` nodes at most) at a time,
so a group of any size is spread over tasks, and the number of rounds grows
with the logarithm of the largest group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, quoted

FAN, HEIGHT = 3, 5
BLOCK = FAN ** HEIGHT
#: Characters of a proof that are handed to the JVM at a time.
BATCH_CHARS = 8_000_000


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the fields: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    def one(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(one, fields)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and ``proof`` lead to."""
    levels = F.filter(F.split(proof, "/"), lambda level: level != "")
    return F.aggregate(levels, leaf, lambda digest, level: F.sha2(
        F.concat(F.substring_index(level, ".", 1), digest, F.substring_index(level, ".", -1)), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 (lowercase hex) of all siblings of ``proof``, level by level, left to right."""
    return F.sha2(F.replace(F.replace(proof, F.lit("/"), F.lit("")), F.lit("."), F.lit("")), 256)


def height(size: int) -> int:
    """Levels above ``size`` leaves."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


class Subtree:
    """The nodes above at most ``BLOCK`` neighbours of one level, ``levels`` levels of them."""

    def __init__(self, digests: list[str], levels: int):
        self.levels = levels
        self.digests = [digests]
        for _ in range(levels):
            self.digests.append([""] * -(-len(self.digests[-1]) // FAN))
        self.leaves = len(digests)
        self._climb()

    def _label(self, level: int, node: int) -> tuple[int, int, int]:
        """Labels order nodes by their last leaf, then by level."""
        return min((node + 1) * FAN ** level, self.leaves) - 1, level, node

    def _climb(self) -> None:
        if not self.levels:
            return
        queue: list = []
        for place, digest in enumerate(self.digests[0]):
            heapq.heappush(queue, (*self._label(1, place // FAN), place, digest))
            while queue and queue[0][0] <= place:                 # all children have sent their digests
                label, parts = queue[0][:3], []
                while queue and queue[0][:3] == label:
                    parts.append(heapq.heappop(queue)[4])
                _, level, node = label
                found = sha256("".join(parts).encode()).hexdigest()
                self.digests[level][node] = found
                if level < self.levels:
                    heapq.heappush(queue, (*self._label(level + 1, node // FAN), node, found))

    def proofs(self, above: str) -> Iterator[tuple[int, str]]:
        """Every leaf's place and proof, from the last to the first, when ``above`` is the proof of the top."""
        end, level, node = self._label(self.levels, 0)
        queue = [(-end, -level, node, above)]
        while queue:
            _, level, node, proof = heapq.heappop(queue)
            level = -level
            if level == 0:
                yield node, proof
                continue
            below = self.digests[level - 1]
            first, last = node * FAN, min((node + 1) * FAN, len(below))
            for child in range(first, last):
                own = "".join(below[first:child]) + "." + "".join(below[child + 1:last])
                end, _, _ = self._label(level - 1, child)
                heapq.heappush(queue, (-end, 1 - level, child, own + "/" + proof if proof else own))


def _subtrees(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, pa.Array]]:
    """The rows of each block, in order: lists per column; a block may begin in one batch and end in a later one."""
    held: dict[str, list] = {c: [] for c in columns}
    at = None
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            if begin == end:
                continue
            if at is not None and keys[begin] != at:
                yield {c: pa.concat_arrays(parts) for c, parts in held.items()}
                held = {c: [] for c in columns}
            at = keys[begin]
            for c in columns:
                held[c].append(batch.column(c).slice(begin, end - begin))
    if at is not None:
        yield {c: pa.concat_arrays(parts) for c, parts in held.items()}


def _levels(size: int, base: int) -> int:
    return max(0, min(HEIGHT, height(size) - base))


def _dealt(nodes: DataFrame, *then: str) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", *then)


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (``tree, size, place, digest`` and others) and the nodes every ``HEIGHT`` levels above, to the roots."""
    levels = [nodes]
    highest = height(nodes.agg(F.max("size")).first()[0] or 0)
    for base in range(0, highest, HEIGHT):
        def run(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            found: list[tuple] = []
            for rows in _subtrees(batches, ["tree", "size", "block", "digest"]):
                size = rows["size"][0].as_py()
                top = Subtree(rows["digest"].to_pylist(), _levels(size, base)).digests[-1][0]
                found.append((rows["tree"][0].as_py(), size, rows["block"][0].as_py(), top))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                    ["tree", "size", "place", "digest"])

        below = levels[-1].select("tree", "size", "place", F.floor(F.col("place") / BLOCK).alias("block"), "digest")
        levels.append(cut(_dealt(below, "place").mapInArrow(run, "tree long, size long, place long, digest string"),
                          "merkle-nodes"))
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``carry, digest, subroot, root, proof`` of every node of ``levels[0]``; ``tops`` (``tree, place, proof, subroot,
    root``) are the messages to the last level."""
    for number in reversed(range(len(levels) - 1)):
        last = number == 0
        carry_type = levels[0].schema["carry"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch], base: int = number * HEIGHT) -> Iterator[pa.RecordBatch]:
            columns = ["tree", "size", "place", "digest", "subroot", "root", "proof", "carry"]
            for rows in _subtrees(batches, columns):
                message = {c: rows[c][0].as_py() for c in ("tree", "subroot", "root", "proof")}
                nodes = {c: rows[c].slice(1) for c in columns}                 # the message comes first
                tree = Subtree(nodes["digest"].to_pylist(), _levels(nodes["size"][0].as_py(), base))
                most = max(1, BATCH_CHARS // (len(message["proof"]) + 1000))
                got = []

                def batch() -> pa.RecordBatch:
                    at = pa.array([g[0] for g in got])
                    n = len(got)
                    return pa.RecordBatch.from_arrays(
                        [pa.array([message["tree"]] * n, pa.int64()), nodes["place"].take(at), nodes["digest"].take(at),
                         pa.array([message["subroot"]] * n), pa.array([message["root"]] * n),
                         pa.array([g[1] for g in got]), nodes["carry"].take(at)],
                        ["tree", "place", "digest", "subroot", "root", "proof", "carry"])

                for one in tree.proofs(message["proof"]):
                    got.append(one)
                    if len(got) >= most:
                        yield batch()
                        got = []
                if got:
                    yield batch()

        nothing = F.lit(None).cast("string")
        nodes = levels[number].select(
            "tree", "size", "place", F.floor(F.col("place") / BLOCK).alias("block"), "digest", nothing.alias("subroot"),
            nothing.alias("root"), nothing.alias("proof"), (F.col("carry") if last else F.lit(None)).cast(
                carry_type).alias("carry"), F.lit(1).alias("kind"))
        messages = tops.select(
            "tree", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("place"),
            F.col("place").alias("block"), nothing.alias("digest"), "subroot", "root", "proof",
            F.lit(None).cast(carry_type).alias("carry"), F.lit(0).alias("kind"))
        found = _dealt(messages.unionByName(nodes), "kind", "place").drop("kind").mapInArrow(
            run, f"tree long, place long, digest string, subroot string, root string, proof string, carry {carry_type}")
        tops = found if last else cut(found.drop("carry", "digest"), "merkle-proofs")
    if len(levels) > 1:
        return tops
    return levels[0].join(tops.drop("place"), "tree")             # every tree is one node: its message is its proof


def merkle_manifest(docs: DataFrame, fields: list[str], group_col: str = "source", id_col: str = "doc_id",
                    keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, ``leaf``, ``subroot``, ``root`` and ``proof``, and the columns ``keep``.

    ``leaf`` is the digest of ``fields``.  The leaves of a group, by id (a null
    id first, equal ids by digest), are joined three by three, level by level,
    to the group's ``subroot``; the subroots, by group (a null group first,
    else by UTF-8 bytes), likewise to ``root``.  ``proof`` lists the levels
    from the leaf to the root, split by ``/``: the digests to the left, ``.``,
    the digests to the right; ``fold`` leads from the leaf to the root.

    Null values differ from empty ones; repeated rows are leaves of their own;
    texts of any length are hashed whole; an empty table gives no rows; other
    columns are ignored.  ``keep`` are expressions over ``docs`` that are
    handed through (such as the digest of another version of the row).
    """
    kept = [c.alias(n) for n, c in (keep or {}).items()]
    rows = cut(docs.select(quoted(group_col).cast("string").alias("grouped"), quoted(id_col).alias("row_id"),
                           leaf_digest([quoted(c) for c in fields]).alias("digest"), F.struct(
                               quoted(id_col).alias("doc_id"), *kept).alias("carry")), "merkle-leaves")

    def nodes(table: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
        return cut(numbered(table, group, order, name).select(
            F.col("group_no").alias("tree"), F.col("group_size").alias("size"), "place", "digest", "carry"), name)

    levels = _climb(nodes(rows, "grouped", ["row_id", "digest"], "merkle-order"))
    subroots = levels[-1].where("place = 0").select(
        F.lit(0).alias("one"), F.col("tree").alias("number"), "digest", F.struct(F.col("tree").alias("sub")).alias("carry"))
    above = _climb(nodes(subroots, "one", ["number"], "merkle-subroots"))
    tops = above[-1].select("tree", "place", F.col("digest").alias("subroot"), F.col("digest").alias("root"),
                            F.lit("").alias("proof"))
    groups = _descend(above, tops)
    tops = cut(groups.select(F.col("carry.sub").alias("tree"), F.lit(0).cast("long").alias("place"),
                             F.col("digest").alias("subroot"), "root", "proof"), "merkle-groups")
    return _descend(levels, tops).select("carry.*", F.col("digest").alias("leaf"), "subroot", "root", "proof")

"""Large CSV files and JSON arrays in parallel: records are found from what each byte range reports about itself.

A record of a CSV file may span lines (line feeds inside quotes), and the
objects of a JSON array need not stand on lines at all, so no range of a file
can tell by itself where its first record begins.  Two scans answer that
without moving a text:

1. Spark's text source cuts files into ranges and ranges into segments, at line
   feeds (CSV) or closing braces (JSON).  Each range reports whether it turns
   "inside a string" around (the parity of its quotes) and by how much it
   changes the bracket depth, if it begins outside and if it begins inside.
   A prefix XOR and then a prefix sum over a file's ranges give the state in
   which each range begins.
2. With that state, every range cuts its own records.  What hangs over its
   edges (at most two pieces a range) is joined to the range where the record
   begins; records inside ranges are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: More ranges than this are not broadcast: the segments are sorted to their range's state instead.
MOST_BROADCAST_RANGES = 200_000


@dataclass(frozen=True)
class Format:
    """How a format's segments end, and what a record must be back at (outside of strings, at its base depth)."""
    separator: str
    nested: bool


CSV = Format("\n", nested=False)
JSON = Format("}", nested=True)


def _escaped(data: np.ndarray, quotes: np.ndarray) -> np.ndarray:
    """Which of the quotes follow an odd number of backslashes."""
    out = np.zeros(len(quotes), bool)
    for i in np.flatnonzero((quotes > 0) & (data[np.maximum(quotes - 1, 0)] == 0x5C)).tolist():
        at = int(quotes[i]) - 1
        while at >= 0 and data[at] == 0x5C:
            at -= 1
        out[i] = (quotes[i] - 1 - at) % 2 == 1
    return out


def _effects(segments: pa.Array, kind: Format) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment with its separator: does it turn inside and outside around; its depth change from either side."""
    n = len(segments)
    if not kind.nested:
        return pc.count_substring(segments, '"').to_numpy() % 2, np.zeros(n, np.int64), np.zeros(n, np.int64)
    closed = pc.binary_join_element_wise(segments, pa.array([kind.separator] * n), "")
    ends = np.frombuffer(closed.buffers()[1], np.int32, n + 1, closed.offset * 4).astype(np.int64)
    data = np.frombuffer(closed.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0])
    ends -= ends[0]
    quotes = np.flatnonzero(data == 0x22)
    quotes = quotes[~_escaped(data, quotes)]
    # every segment counted as if it began outside of strings
    begins = np.searchsorted(quotes, ends)
    turns = np.diff(begins) % 2
    brackets = np.flatnonzero((data | 0x20 == 0x7B) | (data | 0x20 == 0x7D))        # { [ and } ]
    change = np.where(data[brackets] | 0x20 == 0x7B, 1, -1)
    of = np.searchsorted(ends, brackets, "right") - 1
    inside = (np.searchsorted(quotes, brackets) - begins[of]) % 2 == 1
    return (turns, np.bincount(of, change * ~inside, n).astype(np.int64),
            np.bincount(of, change * inside, n).astype(np.int64))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """The ranges met in a batch: (file, first byte) and the rows that belong to it."""
    coded = batch.column("file").dictionary_encode()
    blocks, files = batch.column("block").to_numpy(), coded.indices.to_numpy()
    cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (files[1:] != files[:-1])) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if end > begin:
            yield (coded.dictionary[int(files[begin])].as_py(), int(blocks[begin])), begin, end


def _followed(turns: np.ndarray, outer: np.ndarray, inner: np.ndarray, inside: bool, depth: int):
    """State after each segment: inside a string or not, and the depth."""
    after = (np.cumsum(turns) + inside) % 2
    before = np.concatenate([[int(inside)], after[:-1]])
    return after, depth + np.cumsum(np.where(before == 1, inner, outer))


def segments(spark: SparkSession, path: str | list[str], kind: Format) -> DataFrame:
    """``file, block, value`` of every segment below ``path``, in file order within a range."""
    text = spark.read.option("lineSep", kind.separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"), "value")


def range_states(rows: DataFrame, kind: Format) -> DataFrame:
    """``file, block, inside, depth, base, head`` of every range: the state it begins in.

    ``base`` is the depth between records (1 in a JSON array); ``head`` is a
    file's first record, where its first range holds all of it (CSV).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, found = None, None, []

        def row() -> None:
            found.append((*at, int(state["turns"]), state["outer"], state["inner"], state["start"], "\n".join(state["head"])
                          if state["whole"] else None))

        for batch in batches:
            for key, begin, end in _runs(batch):
                own = batch.column("value").slice(begin, end - begin)
                if key != at:
                    if at is not None:
                        row()
                    at, state = key, {"turns": 0, "outer": 0, "inner": 0, "start": "", "head": [], "whole": False}
                turns, outer, inner = _effects(own, kind)
                after, depth = _followed(turns, outer, inner, state["turns"] == 1, 0)
                _, other = _followed(turns, outer, inner, state["turns"] == 0, 0)
                if key[1] == 0 and not state["start"]:
                    state["start"] = next((x for x in (v.as_py().lstrip("﻿ \t\r\n")[:1] for v in own) if x), "")
                if key[1] == 0 and not kind.nested and not state["whole"]:
                    ends = np.flatnonzero(after == 0)
                    state["whole"] = len(ends) > 0
                    state["head"] += own.slice(0, int(ends[0]) + 1 if len(ends) else None).to_pylist()
                state["turns"] = int(after[-1])
                state["outer"] += int(depth[-1])
                state["inner"] += int(other[-1])
        if at is not None:
            row()
        if found:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)],
                                             ["file", "block", "turns", "outer", "inner", "start", "head"])

    told = rows.mapInArrow(run, "file string, block long, turns long, outer long, inner long, start string, head string")
    # one row per range: a window holds a file's list of ranges, never its contents
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    inside = F.coalesce(F.sum("turns").over(before) % 2, F.lit(0)) == 1
    change = F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))
    base = (F.max(F.when(F.col("block") == 0, F.col("start"))).over(whole) == "[").cast("long")
    stated = told.withColumn("inside", inside).withColumn("change", change).select(
        "file", "block", "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"),
        F.coalesce(base, F.lit(0)).alias("base"), F.max("head").over(whole).alias("head"))
    return cut_lineage(stated)


def records(rows: DataFrame, states: DataFrame, kind: Format) -> DataFrame:
    """``file, first, value``: each record of ``rows`` once; ``first`` marks the first of its file.

    Separators inside a record are kept, the one that ends it too for JSON.
    A record that the file's end cuts short is a record as it stands.
    """
    known = states.select(F.col("file").alias("in_file"), F.col("block").alias("in_block"), "inside", "depth", "base")
    same = (F.col("file") == F.col("in_file")) & (F.col("block") == F.col("in_block"))
    if states.count() <= MOST_BROADCAST_RANGES:
        dealt = rows.join(F.broadcast(known), same)
    else:
        dealt = rows.withColumn("line", F.monotonically_increasing_id()).join(known, same).repartition(
            "file", "block").sortWithinPartitions("file", "block", "line")
    glue = "" if kind.nested else kind.separator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, depth, piece, part, parts = None, False, 0, [], 0, None

        def table(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)],
                                              ["file", "block", "part", "begins", "ends", "value"])

        for batch in batches:
            found: list[tuple] = []
            for key, begin, end in _runs(batch):
                own = batch.column("value").slice(begin, end - begin)
                if key != at:
                    if piece:                                        # the last record goes on in the next range
                        found.append((*at, part, parts, False, glue.join(piece) + glue))
                    at, piece, part = key, [], 0
                    inside, depth = batch.column("inside")[begin].as_py(), batch.column("depth")[begin].as_py()
                    base = batch.column("base")[begin].as_py()
                    parts = not inside and (depth == base or key[1] == 0)     # a record begins with the range
                turns, outer, inner = _effects(own, kind)
                after, deep = _followed(turns, outer, inner, inside, depth)
                texts = own.to_numpy(zero_copy_only=False).tolist()
                if kind.nested:
                    texts = [t + kind.separator for t in texts]
                low = 0
                for stop in np.flatnonzero((after == 0) & (deep == base)).tolist():
                    whole = texts[stop] if not piece and stop == low else glue.join([*piece, *texts[low:stop + 1]])
                    found.append((*key, part, parts, True, whole))
                    piece, low, part, parts = [], stop + 1, part + 1, True
                piece += texts[low:]
                inside, depth = bool(after[-1]), int(deep[-1])
            if found:
                yield table(found)
        if piece:
            yield table([(*at, part, parts, False, glue.join(piece) + glue)])

    cut = dealt.mapInArrow(run, "file string, block long, part int, begins boolean, ends boolean, value string")
    first = (F.col("block") == 0) & (F.col("part") == 0)
    inner = cut.where("begins and ends").select("file", first.alias("first"), "value")
    # what hangs over: every piece that begins a record opens a group, in the order of the file
    order = Window.partitionBy("file").orderBy("block", "part")
    loose = cut.where("not (begins and ends)").withColumn("first", first).withColumn(
        "group", F.sum(F.col("begins").cast("int")).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("block", "part", "value")))       # the pieces of one record
    joined = loose.groupBy("file", "group").agg(F.max("first").alias("first"), F.array_join(
        F.transform(pieces, lambda p: p["value"]), "").alias("value")).select("file", "first", "value")
    return inner.unionByName(joined)


def csv_records(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """``head, value`` (header and record) of every record of the CSV files but the headers, and all headers.

    Quotes stand around fields and are doubled inside them; a quote inside a
    field without quotes would break the count.  Lines end with a line feed,
    with or without a carriage return; blank lines are no records.
    """
    rows = segments(spark, path, CSV)
    states = range_states(rows, CSV)
    heads = states.where("block = 0").select("file", "head")
    if not heads.where("head is null").isEmpty():
        raise ValueError("a CSV file's header does not fit into its first range: raise spark.sql.files.maxPartitionBytes")
    found = records(rows, states, CSV).where("not first").select(
        F.col("file"), F.regexp_replace("value", r"[\r\n]+\z", "").alias("value"))
    named = heads.select(F.col("file").alias("in_file"), "head")
    out = found.where(F.trim("value") != "").join(named, F.col("file") == F.col("in_file")).select("head", "value")
    return out, sorted(h.head for h in heads.select("head").distinct().collect())       # as many as there are layouts


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value``: the objects of the JSON arrays below ``path`` (or of JSON Lines, or of objects one after the other)."""
    rows = segments(spark, path, JSON)
    found = records(rows, range_states(rows, JSON), JSON)
    bare = F.regexp_replace("value", "^[\\s,\\[﻿]+", "")
    # after the last object only the array's end is left, and the separator that was put after it
    return found.select(bare.alias("value")).where(~F.col("value").rlike(r"^[\s,\]]*\}?$"))

"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

An item leaks where a window of as many words as the item has reaches a
weighted Jaccard similarity of its word shingles (weights: occurrences) of at
least the threshold.  All steps are DataFrame operations.

1. Windows: one that reaches the threshold holds a known number of the item's
   shingles, and moving it to its first such shingle loses none.  So only
   windows at (or, near a text's end, clipped from) an item's shingle count,
   and of these only those with enough item shingles ahead.
2. Each window gets a SimHash; the items' fingerprints are indexed by their
   eight byte blocks with every value within ``distance // 8`` bits, so that
   every item within ``distance`` bits meets the window in some block.
3. Pairs within the distance are verified by exact similarity, and so are
   the pairs of step 1 that lie further apart: no leak is lost to a radius.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted, text_or_empty

BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits: punctuation and mark-up between words do not count."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(table: DataFrame, text: Column, *columns: Column) -> DataFrame:
    return table.select(*columns, F.transform(words(text), lambda w: F.xxhash64(w)).alias("h"))


def _shingles(h: str, size: Column | int) -> Column:
    """Hashes of all shingles of ``size`` word hashes, in order."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.size(h) >= size,
                  F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(F.slice(h, i, size)))
                  ).otherwise(F.array().cast("array<bigint>"))


def _small(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table``, broadcast if it is proven to be small; else Spark joins it by shuffling."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def _fingerprint(h: Column) -> list[Column]:
    """SimHash of the hashes in a group, as eight bytes."""
    def bit(k: int) -> Column:
        return F.sum(F.shiftrightunsigned(h, k).bitwiseAND(1)) * 2 > F.count(F.lit(1))

    return [sum((F.when(bit(8 * b + k), 1 << k).otherwise(0) for k in range(8)), F.lit(0)).cast("int").alias(f"b{b}")
            for b in range(8)]


def _blocks(prefix: str = "") -> Column:
    return F.array(*[F.struct(F.lit(b).alias("block"), F.col(f"{prefix}b{b}").alias("value")) for b in range(8)])


def find_leaks(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, distance: int = 23,
               id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start_word, distance, similarity``: the best window of each document and leaked item.

    Best: highest similarity, then fewest differing bits, then first.  A text
    shorter than the item is one window.  An item with fewer words than the
    shingle is a shingle of its own; one without words never leaks, and null
    or empty texts hold no leak.  Repeated rows give one result row, a null id
    counts as an id; equal items each give a row; empty tables give no rows.
    """
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("distance").alias("d"), F.col("start").alias("w")))
    return _leaking_windows(docs, items, shingle, threshold, distance, id_col, text_col, item_id_col, item_text_col).groupBy(
        "doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", F.col("best.w").alias("start_word"), F.col("best.d").alias("distance"),
        (-F.col("best.s")).alias("similarity"))


def _text_key(text: Column) -> Column:
    """Tells the texts of one id apart; ``text`` has no nulls."""
    return F.xxhash64(text)


def _leaking_windows(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, distance: int = 23,
                     id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                     item_text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, item_id, start, distance, similarity`` of every window that reaches the threshold."""
    item = cut(_hashes(items, quoted(item_text_col), quoted(item_id_col).alias("item_id"))
               .where(F.size("h") > 0)
               .withColumn("k", F.least(F.size("h"), F.lit(shingle)))
               .withColumn("s", _shingles("h", F.col("k")))
               .select("item_id", F.size("h").alias("item_words"), "k", "s"), "items")
    lengths = [r.k for r in item.select("k").distinct().collect()]           # at most `shingle` numbers
    per_item = item.select("item_id", "item_words", "k", F.explode("s").alias("sh")).groupBy(
        "item_id", "item_words", "k", "sh").agg(F.count(F.lit(1)).alias("in_item"))

    # 1. the items' shingles in the documents
    text = text_or_empty(text_col)
    hashed = _hashes(docs, text, quoted(id_col).alias("doc_id"), _text_key(text).alias("text_key"))
    wanted = _small(per_item.select("k", "sh").distinct(), 32)
    met = None
    for k in lengths:
        each = (hashed.where(F.size("h") >= k)
                .select("doc_id", "text_key", "h", F.explode(F.sequence(F.lit(0), F.size("h") - k)).alias("pos"))
                .select("doc_id", "text_key", F.size("h").alias("n_words"), "pos", F.lit(k).alias("k"),
                        _at(k).alias("sh")).join(wanted, ["k", "sh"], "left_semi"))
        met = each if met is None else met.unionByName(each)
    if met is None:
        id_type = docs.select(quoted(id_col)).schema[0].dataType.simpleString()
        item_type = items.select(quoted(item_id_col)).schema[0].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {id_type}, text_key long, item_id {item_type}, start int, distance int, similarity double")
    met = cut(met.distinct(), "met-shingles")
    hits = met.join(_small(per_item.select("item_id", "item_words", "k", "sh"), 64), ["k", "sh"]).select(
        "doc_id", "text_key", "n_words", "item_id", "item_words", "k", "pos")

    # 2. windows with enough of an item's shingles ahead
    window_shingles = F.least("item_words", "n_words") - F.col("k") + 1
    need = F.ceil((window_shingles + F.col("item_words") - F.col("k") + 1) * (threshold / (1 + threshold)) - 1e-9)
    order = Window.partitionBy("doc_id", "text_key", "item_id").orderBy("pos")
    placed = hits.withColumn("rank", F.row_number().over(order)).withColumn("need", need)
    ahead = placed.select(F.col("doc_id").alias("d2"), F.col("text_key").alias("t2"), F.col("item_id").alias("i2"),
                          F.col("rank").alias("r2"), F.col("pos").alias("p2"))
    enough = placed.join(ahead, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_key") == F.col("t2"))
                         & F.col("item_id").eqNullSafe(F.col("i2")) & (F.col("rank") + F.col("need") - 1 == F.col("r2")),
                         "left")
    clipped = F.greatest(F.lit(0), F.col("n_words") - F.col("item_words"))
    known = (enough.where((F.col("p2") - F.col("pos") < window_shingles) | (F.col("pos") > clipped))
             .select("doc_id", "text_key", F.least("pos", clipped).alias("start"), "item_words", "k", "item_id").distinct())
    known = cut(known, "windows")
    starts = known.drop("item_id").distinct()

    # 3. their words, shingles and fingerprints
    some = _small(starts.select(F.col("doc_id").alias("d2"), F.col("text_key").alias("t2")).distinct(), 64)
    again = (hashed.join(some, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_key") == F.col("t2")), "left_semi")
             .select(F.col("doc_id").alias("d2"), F.col("text_key").alias("t2"), "h").dropDuplicates(["d2", "t2"]))
    windows = (starts.join(again, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_key") == F.col("t2")))
               .select("doc_id", "text_key", "start", "item_words", "k",
                       F.slice("h", F.col("start") + 1, F.col("item_words")).alias("h"))
               .withColumn("window", F.xxhash64("doc_id", "text_key", "start", "item_words"))
               .withColumn("s", _shingles("h", F.col("k"))).drop("h"))
    windows = cut(windows, "window-shingles")
    key = ["doc_id", "text_key", "start", "item_words", "k", "window"]
    marked = cut(windows.select(*key, F.explode("s").alias("sh")).groupBy(*key).agg(*_fingerprint(F.col("sh"))), "marked")
    item_marked = item.select("item_id", "item_words", F.explode("s").alias("sh")).groupBy(
        "item_id", "item_words").agg(*_fingerprint(F.col("sh")))

    # 4. items within the distance, through any of the eight blocks
    ball = [x for x in range(256) if x.bit_count() <= distance // 8]
    index = item_marked.select("*", F.explode(_blocks()).alias("b")).select(
        F.col("item_id"), "item_words", F.col("b.block").alias("block"),
        F.explode(F.transform(F.array(*[F.lit(x) for x in ball]), lambda x: F.col("b.value").bitwiseXOR(x))).alias("value"),
        *[F.col(f"b{b}").alias(f"i{b}") for b in range(8)])
    near = (marked.select("*", F.explode(_blocks()).alias("b")).withColumn("block", F.col("b.block"))
            .withColumn("value", F.col("b.value")).join(_small(index, 128), ["item_words", "block", "value"]))
    differ = sum((F.bit_count(F.col(f"b{b}").bitwiseXOR(F.col(f"i{b}"))) for b in range(8)), F.lit(0))
    near = near.select(*key, "item_id", differ.cast("int").alias("distance")).where(F.col("distance") <= distance).distinct()
    # a window may reach the threshold from further away (repeated shingles weigh heavily in a fingerprint):
    # where step 2 knows the item already, the pair is verified whatever its distance
    sought = known.select(F.xxhash64("doc_id", "text_key", "start", "item_words").alias("known_window"),
                          F.col("item_id").alias("known_item")).distinct()
    own = item_marked.select("item_id", *[F.col(f"b{b}").alias(f"i{b}") for b in range(8)])
    far = (marked.join(sought, F.col("window") == F.col("known_window"))
           .join(_small(own, 96), F.col("item_id").eqNullSafe(F.col("known_item")))
           .select(*key, "item_id", differ.cast("int").alias("distance")).where(F.col("distance") > distance))
    pairs = cut(near.unionByName(far), "near-windows")

    # 5. exact similarity
    counts = windows.select("window", "doc_id", "text_key", "start", "item_words",
                            F.explode("s").alias("sh"), F.size("s").alias("n_s")).groupBy(
        "window", "doc_id", "text_key", "start", "item_words", "n_s", "sh").agg(F.count(F.lit(1)).alias("in_window"))
    both = (pairs.select("window", F.col("doc_id").alias("d2"), F.col("text_key").alias("t2"),
                         F.col("start").alias("s2"), F.col("item_words").alias("w2"), "item_id", "distance")
            .join(counts, "window").where(F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_key") == F.col("t2"))
                                          & (F.col("start") == F.col("s2")) & (F.col("item_words") == F.col("w2")))
            .join(per_item.select(F.col("item_id").alias("i2"), "sh", "in_item"),
                  ["sh"]).where(F.col("item_id").eqNullSafe(F.col("i2"))))
    shared = both.groupBy("doc_id", "text_key", "item_id", "start", "item_words", "n_s", "distance").agg(
        F.sum(F.least("in_window", "in_item")).alias("common"))
    total = F.col("n_s") + F.col("item_words") - F.least("item_words", F.lit(shingle)) + 1
    return shared.withColumn("similarity", F.col("common") / (total - F.col("common"))).where(
        F.col("similarity") >= threshold - 1e-12).select("doc_id", "text_key", "item_id", "start", "distance", "similarity")


def _at(k: int) -> Column:
    """Hash of the shingle of ``k`` words at ``pos``, the same as that of ``_shingles``."""
    return F.xxhash64(*[F.get("h", F.col("pos") + j) for j in range(k)])


def drop_leaks(docs: DataFrame, items: DataFrame, whole_ids: bool = True, **options) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, with all their columns.

    ``whole_ids``: the rows of one id are one document and go together if an
    item leaks in any of them; otherwise each row goes or stays by its own
    text.  A null is no id: rows without one are always taken by their text.
    """
    def key(doc_id: Column, text_key: Column) -> Column:
        return F.when(doc_id.isNull(), text_key) if whole_ids else text_key

    row_id, text = quoted(options.get("id_col", "doc_id")), text_or_empty(options.get("text_col", "text"))
    leaked = cut(_leaking_windows(docs, items, **options).select(
        F.col("doc_id").alias("leaked_id"), key(F.col("doc_id"), F.col("text_key")).alias("leaked_key")).distinct(),
        "leaked")
    # the row as one struct: its columns may have any names
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), row_id.alias("row_id"),
                       key(row_id, _text_key(text)).alias("row_key"))
    return rows.join(_small(leaked, 32), F.col("row_id").eqNullSafe(F.col("leaked_id"))
                     & F.col("row_key").eqNullSafe(F.col("leaked_key")), "left_anti").select("row.*")

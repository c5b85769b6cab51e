"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked, one text per chosen path.

Pointers to ancestors are doubled by joining a table of them with itself, so a
path of any length takes a logarithmic number of rounds, and no round gathers
a tree: rows are joined by unique node ids.  Leaves climb the pointers to get
their path's score; the chosen paths are then spelled out by the same
pointers.  Only ids and scores move until the chosen paths' texts are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted

# The template's control strings.  A conversation is BEGIN, then for each turn
# ROLE_OPEN role ROLE_CLOSE text END.
BEGIN, END, ROLE_OPEN, ROLE_CLOSE = "<s>", "</s>", "[INST]", "[/INST]"


def _broken(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(text: Column) -> Column:
    r"""Text without control strings: ``\`` doubled, then a ``\`` after the first character of each of them."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (BEGIN, END, ROLE_OPEN, ROLE_CLOSE):
        text = F.replace(text, F.lit(control), F.lit(_broken(control)))
    return text


def unescape(text: Column) -> Column:
    r"""Inverse of ``escape``: only there does an odd run of ``\`` follow a control string's first character."""
    for control in (BEGIN, END, ROLE_OPEN, ROLE_CLOSE):
        text = F.replace(text, F.lit(_broken(control)), F.lit(control))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def chain_replies(turns: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Linear conversations as reply trees: ``turns`` with ``node_id`` and ``parent_id`` (the turn before).

    Turns follow ``order`` within ``key``; ties follow each other, repeated
    rows are turns of their own, a null key is a key; columns of ``turns`` that
    are called ``node_id`` or ``parent_id`` give way to the new ones.  Sorted by
    range, so a conversation of any length is spread over tasks.
    """
    names = [c for c in turns.columns if c not in ("node_id", "parent_id")]
    # the row as one struct: its columns may have any names
    packed = turns.select(F.struct(*[quoted(c) for c in names]).alias("row"), quoted(key).alias("key"),
                          *[quoted(c).alias(f"by{i}") for i, c in enumerate(order)])
    sort = [F.col("key"), *[F.col(f"by{i}") for i in range(len(order))]]
    rows = cut(packed.repartitionByRange(*sort).sortWithinPartitions(*sort).select("row", "key")
               .withColumn("node_id", F.monotonically_increasing_id()), "turns")
    # one row per partition: the turn before a partition's first is the last of the partition before
    edges = rows.groupBy(F.shiftright("node_id", 33).alias("p")).agg(F.min("node_id").alias("first"),
                                                                     F.max("node_id").alias("last"))
    edges = edges.select(F.col("first"), F.lag("last").over(Window.orderBy("p")).alias("before"))
    placed = rows.join(F.broadcast(edges), F.col("node_id") == F.col("first"), "left").withColumn(
        "guess", F.when(F.col("first").isNotNull(), F.col("before")).otherwise(F.col("node_id") - 1)).drop(
        "first", "before")
    other = rows.select(F.col("node_id").alias("parent_id"), F.col("key").alias("other_key"))
    return placed.join(other, (F.col("guess") == F.col("parent_id")) & F.col("key").eqNullSafe(F.col("other_key")),
                       "left").select("row.*", "node_id", "parent_id")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Format the best ``branches`` root-to-leaf paths (all: None) of each reply tree.

    ``messages``: ``tree_id, node_id, parent_id, role, text, score``; other
    columns are ignored.  A path's score is the sum of its nodes' scores (null:
    0); ties go to the smaller leaf id.  A node without a parent in its tree is
    a root.  Null roles and texts are empty; null ids are ids; of rows that
    repeat a node id the first by parent, role, text and score stands for it;
    nodes on or below a cycle of parents have no root and no path.

    Returns ``tree_id, leaf_id, score, rank, n_turns, formatted, loss_spans``:
    the spans (start, end, in code points of ``formatted``) of the assistant's
    texts, as escaped there.  An empty table gives no rows.
    """
    rows = messages.groupBy("tree_id", "node_id").agg(F.min(F.struct(
        "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m"))
    rows = cut(rows.select("tree_id", "node_id", "m.*"), "messages")
    nodes = rows.select("tree_id", "node_id", "parent_id", "score")
    parents = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("up"))
    up = cut(nodes.join(parents, _same("tree_id", "t") & (F.col("parent_id") == F.col("up")))
             .select("tree_id", "node_id", "up", F.col("score").alias("total")), "pointers")

    # pointers to ancestors 1, 2, 4 ... nodes above, with the scores on the way
    levels, most = [], nodes.count()
    while not up.isEmpty() and (1 << len(levels)) <= most:
        levels.append(up)
        above = up.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("up").alias("up2"),
                          F.col("total").alias("total2"))
        up = cut(up.join(above, _same("tree_id", "t") & (F.col("up") == F.col("n")))
                 .select("tree_id", "node_id", F.col("up2").alias("up"),
                         (F.col("total") + F.col("total2")).alias("total")), "pointers")

    def pointers(level: DataFrame) -> DataFrame:
        return level.toDF("t", "n", "up", "total")

    # leaves climb to their roots
    first = levels[0] if levels else up
    inner = first.select(F.col("tree_id").alias("t"), F.col("up").alias("n")).distinct()
    path = nodes.join(inner, _same("tree_id", "t") & _same("node_id", "n"), "left_anti").select(
        "tree_id", F.col("node_id").alias("leaf_id"), F.col("node_id").alias("at"),
        F.lit(0.0).cast("double").alias("score"), F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(levels))):
        path = path.join(pointers(levels[k]), _same("tree_id", "t") & _same("at", "n"), "left").select(
            "tree_id", "leaf_id", F.when(F.col("t").isNull() & F.col("n").isNull() & F.col("up").isNull(), F.col("at"))
            .otherwise(F.col("up")).alias("at"), (F.col("score") + F.coalesce("total", F.lit(0.0))).alias("score"),
            (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth"))
    tops = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("score").alias("own"))
    path = path.join(tops, _same("tree_id", "t") & _same("at", "n")).select(
        "tree_id", "leaf_id", "at", "depth", (F.col("score") + F.col("own")).alias("score"))
    rooted = path.join(first.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n")),
                       _same("tree_id", "t") & _same("at", "n"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id"))
    chosen = rooted.withColumn("rank", rank)
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= branches)
    chosen = cut(chosen.select("tree_id", "leaf_id", "score", "rank", "depth"), "paths")

    # the chosen paths' nodes: each ancestor is met once, by the binary digits of its distance
    spelled = chosen.select("tree_id", "leaf_id", F.col("leaf_id").alias("at"), F.col("depth").alias("place"))
    for k in reversed(range(len(levels))):
        spelled = spelled.unionByName(
            spelled.join(pointers(levels[k]), _same("tree_id", "t") & _same("at", "n"))
            .select("tree_id", "leaf_id", F.col("up").alias("at"), (F.col("place") - (1 << k)).alias("place")))
        spelled = cut(spelled, "path-nodes")

    said = rows.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "role",
                       F.concat(F.lit(ROLE_OPEN), escape(F.col("role")), F.lit(ROLE_CLOSE)).alias("head"),
                       escape(F.col("text")).alias("body"))
    turns = spelled.join(said, _same("tree_id", "t") & _same("at", "n"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.sum(size).over(Window.partitionBy("tree_id", "leaf_id").orderBy("place")) - size
    start = before + len(BEGIN) + F.length("head")
    turns = turns.select("tree_id", "leaf_id", "place", F.concat("head", "body", F.lit(END)).alias("turn"),
                         F.when(F.col("role") == "assistant",
                                F.struct(start.alias("start"), (start + F.length("body")).alias("end"))).alias("span"))
    texts = turns.groupBy("tree_id", "leaf_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "turn", "span"))).alias("parts"))
    texts = texts.select(
        F.col("tree_id").alias("t"), F.col("leaf_id").alias("n"), F.size("parts").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join(F.col("parts.turn"), "")).alias("formatted"),
        F.filter(F.col("parts.span"), lambda s: s.isNotNull()).alias("loss_spans"))
    return chosen.join(texts, _same("tree_id", "t") & _same("leaf_id", "n")).select(
        "tree_id", "leaf_id", "score", "rank", "n_turns", "formatted", "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text), unescaped."""
    body = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    turns = F.filter(F.split(body, rf"\Q{END}\E"), lambda t: t != "")
    mark = F.lit(ROLE_CLOSE)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring(F.split_part(t, mark, F.lit(1)), len(ROLE_OPEN) + 1, 2**31 - 1)).alias("role"),
        unescape(F.split_part(t, mark, F.lit(2))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1,
                                                                          s["end"] - s["start"]))), "")

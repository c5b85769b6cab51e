"""Conversation structure repair by a suffix-shared automaton over role and fault signatures.

A turn's symbol says what its role begins with and what is wrong with it, so a
conversation is a short string, whatever its texts hold.  Distinct signatures
are sorted from their ends: neighbours share suffixes, and a suffix is one
automaton node, whose cheapest way to go on and best script are found once per
grammar state for all conversations that end like this.  Only the path to the
last signature is held, so memory does not grow with the corpus.

Long conversations are cut into blocks of ``BLOCK`` turns, counted from the
end.  What follows a block enters as the cost of going on from each grammar
state at the block's end; these costs come from the blocks' matrices (cost from
state to state), multiplied from the last block to the first.  So a
conversation of any length is spread over tasks; only its blocks' matrices,
and its repaired text on the way to its one digest, pass through one task in
order, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

BLOCK = 1024
# Costs of the edits, the white space, what ends a sentence.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\v\f\r"
ENDS = (".", "!", "?")
# The grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: From each state the one of user and assistant that may follow, as a role's initial.
NEXT = "uuau"
#: Cost of inserts after the last turn, and those inserts, in the letters of a script.
END_COST, END_SCRIPT = (0, 2 * INSERT, INSERT, 0), ("", "ij", "j", "")
#: Letters of a script: Delete, Keep, insert user (i) or assistant (j), rerole to user (r) or assistant (s).
INSERTED, REROLED = {"u": "i", "a": "j"}, {"u": "r", "a": "s"}
NO_WAY = 1 << 40

Node = tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]


def audit(script: Column) -> Column:
    """The edits' initials of a script."""
    return F.translate(script, "ijrs", "IIRR")


def end_node(costs: tuple[int, ...]) -> Node:
    """The node of the empty suffix: ``costs`` of going on from each state."""
    return tuple(costs), ("",) * 4, (0, 1, 2, 3)


def node_before(symbol: str, after: Node) -> Node:
    """The node of ``symbol`` followed by the suffix of ``after``: per grammar state cost, best script and end state.

    A symbol is ``D`` (must go) or the initial of a role (``o``: any other), in
    capitals if the text is truncated.  Of scripts with equal cost the least
    wins; each way to begin has an initial of its own, so the first decides.
    """
    costs, scripts, ends = after
    extra = TRUNCATED if symbol.isupper() else 0
    ways: list[list[tuple[int, str, str, int]]] = []       # per state: cost, initial, letter, state after it
    for state in range(4):
        found = [(DELETE + costs[state], "D", "D", state)]
        if symbol != "D":
            kept = STEPS.get((state, symbol.lower()))
            if kept is not None:
                found.append((extra + costs[kept], "K", "K", kept))
            turned = STEPS[state, NEXT[state]]
            found.append((REROLE + extra + costs[turned], "R", REROLED[NEXT[state]], turned))
        ways.append(found)
    least = [min(w)[0] for w in ways]
    for _ in range(3):                                        # an insert leads to another state before this symbol
        least = [min(c, INSERT + least[STEPS[s, NEXT[s]]]) for s, c in enumerate(least)]
    chosen = [min([w[:3] + (w[3], False) for w in ways[s]]
                  + [(INSERT + least[STEPS[s, NEXT[s]]], "I", INSERTED[NEXT[s]], STEPS[s, NEXT[s]], True)])
              for s in range(4)]
    script, end = [""] * 4, [0] * 4
    open_states = [0, 1, 2, 3]
    while open_states:                                         # inserts need the state that they lead to first
        for s in list(open_states):
            _, _, letter, to, inserts = chosen[s]
            if inserts and to in open_states:
                continue
            script[s] = letter + (script[to] if inserts else scripts[to])
            end[s] = end[to] if inserts else ends[to]
            open_states.remove(s)
    return tuple(least), tuple(script), tuple(end)


def solve(signatures: DataFrame) -> DataFrame:
    """``costs, scripts, ends`` (one entry per state) of each distinct row of ``signatures`` (``signature, after``).

    Sorted by the reversed signature: the nodes of the suffix that a signature
    shares with the one before it are still there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[Node] = []
        before, at = "", None
        for batch in batches:
            out = []
            for back, after in zip(batch.column("back").to_pylist(), batch.column("after").to_pylist()):
                if after != at:
                    path, before, at = [end_node(tuple(after))], "", after
                shared = next((i for i, (a, b) in enumerate(zip(back, before)) if a != b), min(len(back), len(before)))
                del path[shared + 1:]
                for symbol in back[shared:]:
                    path.append(node_before(symbol, path[-1]))
                before = back
                out.append(path[-1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("signature", "after")), pa.array([x[0] for x in out], pa.list_(pa.int64())),
                 pa.array([x[1] for x in out], pa.list_(pa.string())), pa.array([x[2] for x in out], pa.list_(pa.int32()))],
                ["signature", "after", "costs", "scripts", "ends"])

    distinct = signatures.distinct().withColumn("back", F.reverse("signature"))
    return distinct.repartitionByRange("after", "back").sortWithinPartitions("after", "back").mapInArrow(
        run, "signature string, after array<bigint>, costs array<bigint>, scripts array<string>, ends array<int>")


def check_turns(turns: DataFrame) -> DataFrame:
    """``conv, conv_id, size, place, turn, role, text, fault, symbol, letter`` of ``turns`` (``conv_id, turn, role, text``).

    Turns follow ``turn`` (nulls first), ties by role and text.  ``fault`` is
    the first of blank, duplicate (role and text seen earlier), truncated.
    """
    rows = cut(turns.select("conv_id", "turn", "role", "text", F.substring("text", 1, 200).alias("text_start"), F.sha2(
        F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("print")), "turns")
    placed = cut(numbered(rows, "conv_id", ["turn", "role", "text_start", "print"], "turn-order")
                 .withColumnsRenamed({"group_no": "conv", "group_size": "size"}).drop("text_start"), "turns")
    seen = placed.groupBy("conv", "print").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").select(F.col("conv").alias("c"), F.col("print").alias("p"), "first")
    marked = placed.join(seen, (F.col("conv") == F.col("c")) & (F.col("print") == F.col("p")), "left")
    stripped = F.rtrim("text", F.lit(SPACE))
    fault = (F.when(stripped == "", "blank").when(F.col("place") > F.col("first"), "duplicate")
             .when(~F.right(stripped, F.lit(1)).isin(*ENDS), "truncated"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return marked.select("conv", "conv_id", "size", "place", "turn", "role", "text", fault.alias("fault"),
                         letter.alias("letter")).withColumn(
        "symbol", F.when(F.col("fault").isin("blank", "duplicate"), "D").when(
            F.col("fault") == "truncated", F.upper("letter")).otherwise(F.col("letter")))


def _blocks(checked: DataFrame, block: int) -> DataFrame:
    """``conv, block, last, signature, letters``: blocks are counted from a conversation's end, 0 to ``last``."""
    number = F.expr(f"(size - 1 - place) div {block}")
    parts = F.sort_array(F.collect_list(F.struct("place", "symbol", "letter")))           # at most a block's letters
    return checked.groupBy("conv", "size", number.alias("block")).agg(parts.alias("parts")).select(
        "conv", "size", "block", F.expr(f"(size - 1) div {block}").alias("last"),
        F.array_join("parts.symbol", "").alias("signature"), F.array_join("parts.letter", "").alias("letters"))


def _costs_after(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``after``: the least costs of going on from each state at the block's end (the least of them 0)."""
    end = F.array(*[F.lit(c).cast("long") for c in END_COST])
    single = blocks.where("last = 0").withColumn("after", end)
    many = blocks.where("last > 0")
    units = [F.array(*[F.lit(0 if s == t else NO_WAY).cast("long") for s in range(4)]) for t in range(4)]
    ways = solve(many.select("signature", F.explode(F.array(*units)).alias("after")))
    matrix = ways.groupBy("signature").agg(F.sort_array(F.collect_list(F.struct(
        (-F.array_position("after", 0)).alias("unit"), "costs")), asc=False).alias("columns")).select(
        "signature", F.col("columns.costs").alias("ways"))          # four of them, by end state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, costs = None, END_COST
        for batch in batches:
            out = []
            for conv, ways in zip(batch.column("conv").to_pylist(), batch.column("ways").to_pylist()):
                if conv != at:
                    at, costs = conv, END_COST
                low = min(costs)
                costs = [c - low for c in costs]
                out.append(costs)
                costs = [min(way[s] + c for way, c in zip(ways, costs)) for s in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("block"), pa.array(out, pa.list_(pa.int64()))],
                ["conv", "block", "after"])

    chained = many.join(matrix, "signature").select("conv", "block", "ways").repartition("conv").sortWithinPartitions(
        "conv", "block").mapInArrow(run, "conv long, block long, after array<bigint>")
    return single.unionByName(many.join(chained, ["conv", "block"]))


def _choose(solved: DataFrame) -> DataFrame:
    """``conv, size, block, script, cost, illegal``: the blocks' scripts from a conversation's first turn on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, letter = None, 0, ""
        names = ["conv", "block", "after", "costs", "scripts", "ends", "letters"]
        for batch in batches:
            out = []
            for conv, block, after, costs, scripts, ends, letters in zip(*(batch.column(c).to_pylist() for c in names)):
                if conv != at:
                    at, state, letter = conv, 0, ""
                pairs = letter + letters
                illegal = sum(pairs[i:i + 2] not in ("su", "ua", "au") for i in range(len(pairs) - 1))
                script, to = scripts[state], ends[state]
                cost = costs[state] - after[to]
                if block == 0:
                    script, cost = script + " " + END_SCRIPT[to], cost + END_COST[to]
                out.append((script, cost, illegal))
                state, letter = to, letters[-1]
            if out:
                script, cost, illegal = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv"), batch.column("size"), batch.column("block"), pa.array(script),
                     pa.array(cost, pa.int64()), pa.array(illegal, pa.int64())],
                    ["conv", "size", "block", "script", "cost", "illegal"])

    return solved.repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(
        run, "conv long, size long, block long, script string, cost long, illegal long")


def plan_repairs(checked: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv, size, block, script, cost, illegal`` of every block of ``checked`` (from ``check_turns``).

    A script holds a letter per edit; in block 0 a space parts the inserts after the last turn.
    """
    blocks = cut(_costs_after(cut(_blocks(checked, block), "blocks")), "blocks")
    solved = blocks.join(solve(blocks.select("signature", "after")), ["signature", "after"])
    return cut(_choose(solved), "scripts")


def repaired_turns(checked: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv, place, step, edit, role, text``: the turns after the edits, in the order of ``place, step``."""
    own, tail = F.split_part("script", F.lit(" "), F.lit(1)), F.split_part("script", F.lit(" "), F.lit(2))
    per_turn = F.concat(F.regexp_extract_all(own, F.lit("[ij]*[DKrs]"), 0), F.when(tail != "", F.array(tail)).otherwise(
        F.array().cast("array<string>")))
    first = F.greatest(F.lit(0), F.col("size") - (F.col("block") + 1) * block)
    edits = plan.select("conv", first.alias("first"), F.posexplode(per_turn).alias("i", "edits")).select(
        "conv", (F.col("first") + F.col("i")).alias("place"), "edits")
    turns = edits.join(checked.select("conv", "place", "role", "text"), ["conv", "place"], "left")

    def turn(letter: Column) -> Column:
        role = (F.when(letter.isin("i", "r"), "user").when(letter.isin("j", "s"), "assistant").otherwise(F.col("role")))
        text = F.when(letter.isin("i", "j"), "").otherwise(F.col("text"))
        return F.struct(audit(letter).alias("edit"), role.alias("role"), text.alias("text"))

    said = F.transform(F.filter(F.split("edits", ""), lambda x: ~x.isin("", "D")), turn)
    return turns.select("conv", "place", F.posexplode(said).alias("step", "said")).select(
        "conv", "place", "step", "said.*")


def _digests(repaired: DataFrame) -> DataFrame:
    """``conv, digest``: SHA-256 of the turns as ``role:text``, joined by line feeds; texts pass by, none is gathered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])],
                                              ["conv", "digest"])

        for batch in batches:
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line")):
                if conv != at:
                    if digest is not None:
                        yield row()
                    at, digest = conv, sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.as_buffer())
        if digest is not None:
            yield row()

    lines = repaired.select("conv", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "place", "step").select("conv", "line").mapInArrow(
        run, "conv long, digest string")


def repair_conversations(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation of ``turns`` (``conv_id, turn, role, text``), and its repaired turns.

    First table: ``conv_id, conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit, digest``, a row per conversation; second table: ``conv, place,
    step, edit, role, text``.  A null id is a conversation; a null role or text
    counts as empty; null turns come first and leave no gap; repeated rows are
    duplicates; a conversation whose turns all go has the digest of the empty
    string; an empty table gives no rows; other columns are ignored.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    checked = cut(check_turns(rows), "checked")
    plan = plan_repairs(checked, block)
    repaired = cut(repaired_turns(checked, plan, block), "repaired")

    def number(fault: str) -> Column:
        return F.count_if(F.col("fault") == fault).alias(fault)

    # counted twice, so that no conversation's turns meet before they are told apart
    counted = checked.groupBy("conv", "turn").agg(F.first("conv_id").alias("conv_id"), *[
        number(f) for f in ("blank", "duplicate", "truncated")])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    faults = counted.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.coalesce(gaps, F.lit(0)).alias("gaps"), *[
        F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    scripts = plan.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.sort_array(F.collect_list(F.struct((-F.col("block")).alias("b"), "script"))).alias("scripts")).select(
        "conv", "illegal", "cost", audit(F.replace(F.array_join("scripts.script", ""), F.lit(" "), F.lit(""))).alias(
            "audit"))
    out = faults.join(scripts, "conv").join(_digests(repaired), "conv", "left")
    return out.withColumn("digest", F.coalesce("digest", F.sha2(F.lit(""), 256))), repaired

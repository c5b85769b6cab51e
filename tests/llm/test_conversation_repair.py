"""Conversation repair: faults, cheapest edits and digests against a plain search over whole conversations."""

import heapq
import itertools
import re
import zlib
from hashlib import sha256

import pytest

from stagewatch.llm import conversation_repair, queries
from stagewatch.llm.conversation_repair import END_COST, END_SCRIPT, end_node, node_before

SPACE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else
                   "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def search(rows, found):
    """Cheapest edits by uniform-cost search over (rows read, role initials so far collapsed to the last one)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, out = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in done:
            continue
        done.add((i, last))
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for letter, role in (("u", "user"), ("a", "assistant")):
            if letter in nexts:
                heapq.heappush(queue, (cost + 5, audit + "I", i, letter, (*out, (role, ""))))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, last, out))
        if found[i] in ("blank", "duplicate"):
            continue
        extra = 5 if found[i] == "truncated" else 0
        if role[:1] and role[:1] in nexts:
            heapq.heappush(queue, (cost + extra, audit + "K", i + 1, role[:1], (*out, (role, text))))
        for letter, other in (("u", "user"), ("a", "assistant")):
            if letter in nexts:
                heapq.heappush(queue, (cost + 1 + extra, audit + "R", i + 1, letter, (*out, (other, text))))


def digest(turns):
    return sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def brute(rows, ids=None):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    out = []
    for conv in set(groups) | set(ids or ()):
        own = sorted(groups.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, repaired = search(own, found)
        assert GOOD.fullmatch("".join(r[:1] for r, _ in repaired))
        out.append((conv, gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, digest(repaired)))
    return sorted(out, key=str)


def collected(frame):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    last = "repaired_sha256" if "repaired_sha256" in frame.columns else "digest"
    return sorted((tuple(r) for r in frame.select(*names, last).collect()), key=str)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = collected(queries.op11_conversation_repair(spark, sf_dir))
    assert got == brute(damage(rows), {r[0] for r in rows}) and len(got) == len({r[0] for r in rows})


def varied():
    """Conversations of all kinds of turns; null ids, turns, roles and texts; repeated rows; one long conversation."""
    roles = ["user", "assistant", "system", "tool", "", None, "s", "Ass"]
    texts = ["Fine.", "Cut", "", " \t", None, "Ends! \n", "No end ?x", "é…", "Fine."]
    rows = [(c, t, roles[(c * 7 + t * t) % len(roles)], texts[(c + t * 5 + c * t) % len(texts)] if t % 3 else f"Own {t}.")
            for c in range(40) for t in range(c % 9)]
    rows += [(100, t, "user" if t % 2 else "assistant", f"Long {t}" + "." * (t % 5 > 0)) for t in range(70)]
    rows += [(101, None, "user", "a."), (101, None, "assistant", "b."), (101, 5, "user", "c."), (101, 2**40, "assistant", "d.")]
    rows += [(None, 1, "user", "Null id."), (None, None, None, None), (102, None, "user", "x."), (102, None, "user", "x.")]
    rows += [(103, 1, "user", "same turn."), (103, 1, "assistant", "same turn."), (103, 1, "user", "same turn.")]
    rows += [(104, t, "user", "word " * 20_000 + f"{t}.") for t in range(2)]
    return rows


@pytest.mark.parametrize("block", [1024, 4, 1])
def test_blocks_agree(spark, block):
    rows = varied()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", place long, `size` string").repartition(5)
    found, repaired = conversation_repair.repair_conversations(frame, block)
    assert collected(found) == brute(rows)
    by_id = {r.conv: r.conv_id for r in found.collect()}
    turns = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.conv, r.place, r.step)):
        turns.setdefault(by_id[r.conv], []).append((r.role, r.text))
    assert {c: digest(t) for c, t in turns.items()} == {w[0]: w[-1] for w in brute(rows) if w[-1] != digest([])}


def test_null_and_dropped_rows_in_the_query(spark, tmp_path):
    rows = varied()
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone.")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = collected(queries.op11_conversation_repair(spark, str(tmp_path)))
    assert got == brute(damage(rows), {r[0] for r in rows})
    assert (dropped, 0, 0, 0, 0, 0, 0, "", digest([])) in got


def test_empty_table(spark):
    found, repaired = conversation_repair.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert not found.collect() and not repaired.collect()


@pytest.mark.parametrize("length", [0, 1, 2, 3, 4])
def test_every_short_signature(length):
    for signature in itertools.product("DsuaoSUAO", repeat=length):
        if length == 4 and signature[0] not in "DsU":
            continue
        node = end_node(END_COST)
        for symbol in reversed(signature):
            node = node_before(symbol, node)
        rows = [(i, {"o": "tool", "d": "user"}.get(x.lower(), x.lower()), "") for i, x in enumerate(signature)]
        found = ["blank" if x == "D" else "truncated" if x.isupper() else None for x in signature]
        cost, audit, _ = search(rows, found)
        script = node[1][0] + END_SCRIPT[node[2][0]]
        assert (node[0][0], script.translate(str.maketrans("ijrs", "IIRR"))) == (cost, audit)

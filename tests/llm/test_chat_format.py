"""Chat formatting: reply trees against a plain walk, the template's round trip, the query against its SQL."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from stagewatch.llm import chat_format, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def walk(rows):
    """All root-to-leaf paths: {(tree, leaf): (score, [(role, text)])}."""
    nodes = {}
    for t, n, p, r, x, s in rows:
        m = ((p is not None, p or 0), r or "", x or "", s or 0.0, p)
        nodes[t, n] = min(nodes.get((t, n), m), m)
    inner = {(t, m[4]) for (t, n), m in nodes.items() if m[4] is not None and (t, m[4]) in nodes}
    out = {}
    for t, n in nodes:
        if (t, n) in inner:
            continue
        path, at, seen = [], n, set()
        while (t, at) not in seen:
            seen.add((t, at))
            m = nodes[t, at]
            path.append(m)
            if m[4] is None or (t, m[4]) not in nodes:
                out[t, n] = (sum(m[3] for m in path), [(m[1], m[2]) for m in reversed(path)])
                break
            at = m[4]
    return out


ROWS = [(1, 1, None, "user", "root", 1.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0),
        (1, 4, 2, "user", "more", 0.0), (1, 5, 4, "assistant", "end", 1.0), (1, 6, 4, "assistant", "end 2", 1.0),
        (2, 1, 99, "user", "orphan", None), (2, 2, 1, None, None, None), (3, 1, 2, "user", "cycle", 1.0),
        (3, 2, 1, "user", "cycle", 1.0), (3, 3, 2, "user", "below", 1.0), (None, 1, None, "user", "no tree", 1.0),
        (None, 2, 1, "assistant", "x", 1.0), (4, None, None, "assistant", "</s>\\<s>\\\\[INST][\\INST]", 1.0),
        (1, 2, 1, "assistant", "good", 5.0), (5, 1, None, "a[/INST]</s>", "", 1.0)]
ROWS += [(6, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"turn {i}", 0.5) for i in range(37)]


@pytest.mark.parametrize("branches", [1, 2, None])
def test_paths(spark, branches):
    table = spark.createDataFrame(ROWS, SCHEMA).withColumn("up", F.lit(1)).withColumn("t", F.lit("x"))
    got = chat_format.format_trees(table, branches).withColumn("turns", chat_format.read_turns(F.col("formatted"))) \
        .withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    trees = {}
    for (t, n), found in walk(ROWS).items():
        trees.setdefault(t, []).append((-found[0], (n is not None, n or 0), n, found[1]))
    want = {}
    for t, paths in trees.items():
        for rank, (score, _, n, turns) in enumerate(sorted(paths, key=lambda p: p[:2]), 1):
            if branches is None or rank <= branches:
                want[t, n] = (rank, -score, turns)
    assert {(r.tree_id, r.leaf_id): (r["rank"], r.score, [tuple(x) for x in r.turns]) for r in got} == want
    for r in got:
        assert r.n_turns == len(r.turns)
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
        parts = [r.formatted[s.start:s.end] for s in r.loss_spans]
        assert not any(c in p for p in parts for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_escaping_is_reversible(spark):
    odd = ["", "\\", "\\\\", "<\\s>", "<\\\\s>", "<s></s>[INST][/INST]", "<<s>s>", "[[INST]INST]", "\\<s>\\", "<\\/s>",
           "[\\/INST]", "é\n</s>", "</s"]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select(
        "x", chat_format.escape(F.col("x")).alias("e")).select("x", "e", chat_format.unescape(F.col("e")).alias("u"))
    for r in rows.collect():
        assert r.u == r.x
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_chains(spark):
    rows = [(c, t, "user", f"{c}/{t}") for c in (1, 2, 3) for t in range(40)] + [(1, 5, "user", "tie"), (1, 5, "user", "tie"),
            (None, 0, "user", "none"), (None, 1, "assistant", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    linked = chat_format.chain_replies(table, "conv_id", ["turn", "role", "text"]).collect()
    assert len(linked) == len(rows) and len({r.node_id for r in linked}) == len(rows)
    by = {r.node_id: r for r in linked}
    assert sum(r.parent_id is None for r in linked) == 4
    for r in linked:
        if r.parent_id is not None:
            assert by[r.parent_id].conv_id == r.conv_id and by[r.parent_id].turn <= r.turn
    assert len({r.parent_id for r in linked if r.parent_id is not None}) == len(rows) - 4


def test_empty(spark):
    assert chat_format.format_trees(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    got = queries.op1_chat_format(spark, SF)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = c.execute(queries.ORACLE_SQL["op1_chat_format"])
    names = [d[0] for d in want.description]
    rows = {r.conv_id: tuple(r[n] for n in names) for r in got.collect()}
    assert rows == {r[0]: r for r in want.fetchall()}
    text = "</s>[INST] ok [/INST]"
    minus7 = dict(zip(names, rows[-7]))
    assert minus7["loss_chars"] == len(text) and minus7["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert minus7["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_chain_keeps_clashing_columns(spark):
    names = ["first", "before", "guess", "other_key", "key", "row", "by0", "p"]
    turns = spark.createDataFrame([(c, t, f"{c} {t}") for c in range(5) for t in range(7)], "c long, t long, text string")
    wide = turns.select("c", "t", "text", *[F.col("t").alias(n) for n in names], F.lit(9).alias("node_id")).repartition(3)
    got = chat_format.chain_replies(wide, "c", ["t", "text"])
    assert got.columns == [*wide.columns[:-1], "node_id", "parent_id"]
    rows = {r.node_id: r for r in got.collect()}
    assert len(rows) == 35
    for r in rows.values():
        assert all(r[n] == r.t for n in names)
        above = rows.get(r.parent_id)
        assert (above is None) == (r.t == 0) and (above is None or (above.c, above.t) == (r.c, r.t - 1))

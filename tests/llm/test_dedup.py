"""Exact dedup, SimHash dedup, components and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stagewatch.llm import components, decontaminate, exact_dedup, queries, simhash_dedup

SF = "/root/testdata/sf0.001"


def null_last(i):
    return (i is None, i if i is not None else 0)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), null_last(i), i))
    out = []
    for members in groups.values():
        members.sort(key=lambda m: m[:2])
        out += [(m[2], members[0][2], len(members), n == 0) for n, m in enumerate(members)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("prefix", [1, 256])
def test_exact_groups(spark, odd_documents, prefix):
    more = spark.createDataFrame([(100, "a  b"), (101, "ab"), (102, "a\tb\n"), (103, "abc"), (104, "abd"),
                                  (105, "x" * 300 + "y"), (106, "x" * 300 + "z"), (None, "abd"), (None, "abd")],
                                 "doc_id long, text string")
    docs = odd_documents.unionByName(more, allowMissingColumns=True)
    got = exact_dedup.exact_groups(docs, prefix=prefix).select("doc_id", "keep_id", "group_size", "kept").collect()
    want = brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, got), key=repr) == want
    kept = exact_dedup.drop_copies(docs, prefix=prefix)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=null_last) == sorted(
        (w[0] for w in want if w[3]), key=null_last)


def test_refinement_reads_only_what_is_left(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "ccc"), (4, "ddd"), (5, "d dd")], "doc_id long, text string")
    got = {r.doc_id: r.full_hash for r in exact_dedup.exact_groups(docs).collect()}
    assert got[1] is None and got[2] is None and got[4] == got[5] == hashlib.sha256(b"ddd").hexdigest()


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids_and_fps):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    fps = sorted({f for _, f in ids_and_fps})
    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            parent[find(a)] = find(b)
    least = {}
    for i, f in ids_and_fps:
        r = find(f)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, f, least[find(f)]) for i, f in ids_and_fps), key=repr)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_near_groups(odd_documents):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in odd_documents.collect()]
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash_dedup.near_groups(odd_documents).collect()]
    assert sorted(got, key=repr) == brute_components(rows)
    kept = simhash_dedup.drop_near_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=null_last) == sorted({c for _, _, c in brute_components(rows)}, key=null_last)
    assert simhash_dedup.near_groups(odd_documents.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    copy = "one two three four five six seven eight"
    rows = [(4, "a", 1), (4, "a", 1), (4, "same id", 1), (5, " a", 1), (None, "null id", 1), (None, "null  id", 1),
            (1, copy, 1), (2, copy.upper(), 1), (2, "alone", 1), (None, None, 1), (None, "", 1), (None, copy, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int").repartition(3)
    near = [brute_fingerprint(t) for _, t, _ in rows]
    parts = {f: {f} for f in near}
    for a, b in combinations(sorted(set(near)), 2):
        if (a ^ b).bit_count() <= 4:
            parts[a] |= parts[b]
            for f in parts[a]:
                parts[f] = parts[a]
    want = [min((i for (i, _, _), f in zip(rows, near) if f in part), key=null_last)
            for part in {id(p): p for p in parts.values()}.values()]
    kept = simhash_dedup.drop_near_copies(docs, unique_ids=False)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.doc_id for r in got), key=null_last) == sorted(want, key=null_last) and want.count(4) == 2
    assert len({id(parts[brute_fingerprint(r.text)]) for r in got}) == len(got)
    assert {tuple(r) for r in got} <= set(rows)


def test_near_query(spark):
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op9_simhash_dedup(spark, SF).collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(got, key=repr) == brute_components([(d.doc_id, brute_fingerprint(d.text)) for d in docs])


def test_position_sets_cover():
    for shared, size in ((4, 3), (4, 4), (6, 3), (8, 3), (1, 1)):
        sets = [set(t) for t in simhash_dedup.position_sets(shared, size)]
        for four in combinations(range(8), shared):
            assert any(t <= set(four) for t in sets)
    assert len(simhash_dedup.position_sets(4, 3)) == 20


@pytest.mark.parametrize("index_bytes,block", [(3, 4096), (4, 4096), (3, 8)])
def test_links_connect_every_near_pair(spark, monkeypatch, index_bytes, block):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rnd = random.Random(3)
    fps = {0}
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in
             simhash_dedup.near_links(table, 4, index_bytes).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[find(a)] = find(b)
    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            assert find(a) == find(b)
    assert len(links) < 20 * len(fps)


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 3), (3, 7), (3, 9)]
    links += [(500, i) for i in range(501, 560)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    rnd.shuffle(links)
    parent = {x: x for l in links for x in l}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def brute_leaks(docs, items, threshold=0.8):
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v or not w:
                continue
            k = min(5, len(v))
            if len(w) < k:
                continue
            want = Counter(tuple(v[j:j + k]) for j in range(len(v) - k + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                part = w[s:s + len(v)]
                have = Counter(tuple(part[j:j + k]) for j in range(len(part) - k + 1))
                common = sum((want & have).values())
                sim = common / (sum(want.values()) + sum(have.values()) - common)
                if sim >= threshold - 1e-12 and sim > out.get((d, i), (-1, 0))[0]:
                    out[d, i] = (sim, s)
    return out


def leak_tables(spark):
    rnd = random.Random(7)
    vocabulary = ["w%d" % i for i in range(400)] + ["é", "x1"]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(1, say(30) + "."), (2, say(15)), (3, "Two words"), (4, ""), (5, None), (6, say(60)), (None, say(20)),
             (8, "a b a b a b a b a b a b a b"), (9, say(12))]
    items.append((10, items[0][1]))
    t = {i: (x or "") for i, x in items}
    docs = [(1, say(50) + " " + t[1] + "%%% " + say(20)), (2, t[2].upper() + "!!"), (3, say(10) + "\n" + t[6]),
            (4, " ".join(t[6].split()[:-1]) + " zz " + say(30)), (5, " ".join(t[6].split()[:40])), (6, say(300)),
            (7, ""), (8, None), (9, t[1].split()[0]), (None, t[1]), (11, "x a b a b a b a b a b a b y"),
            (12, "see two, words here"), (13, t[9] + " " + t[9]), (14, " ".join(t[6].split()[4:])), (15, t[None]),
            (16, " ".join(t[1].split()[:27])), (1, "another row of one")]
    docs += [docs[0], docs[1]]
    return (spark.createDataFrame([(d, x, 1) for d, x in docs], "doc_id long, text string, h int"),
            spark.createDataFrame(items, "item_id long, text string"), docs, items)


def test_leaks(spark):
    table, benchmark, docs, items = leak_tables(spark)
    got = decontaminate.find_leaks(table, benchmark).collect()
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v[0], 9) for k, v in want.items()}
    assert len(got) == len(want) > 8
    clean = decontaminate.drop_leaks(table, benchmark)
    assert clean.columns == table.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in {k[0] for k in want})


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, -1])
def test_only_leaking_rows_go(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast_bytes)
    _, benchmark, docs, items = leak_tables(spark)
    docs = docs + [(None, "clean row without an id"), (None, "another one"), (None, None), (2, None), (2, "clean")]
    table = spark.createDataFrame([(d, x, 1) for d, x in docs], "doc_id long, text string, h int")
    leaking = {(d, x) for d, x in docs if brute_leaks([(d, x)], items)}
    got = decontaminate.drop_leaks(table, benchmark, whole_ids=False)
    assert got.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(d for d in docs if d not in leaking)
    # by whole ids, rows without an id are still taken one by one
    ids = {d for d, _ in leaking} - {None}
    got = decontaminate.drop_leaks(table, benchmark)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(
        d for d in docs if d not in leaking and d[0] not in ids)


def test_leaks_with_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    table, benchmark, docs, items = leak_tables(spark)
    got = decontaminate.find_leaks(table, benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == set(brute_leaks(docs, items))


def test_leaks_beyond_the_radius(spark):
    """Few distinct shingles: a window of similarity 0.8 differs in more bits than the index looks through."""
    rnd = random.Random(3)
    items = [(1, "a b a b a b a b a b a b a"), (2, "c c c c c c d d d d d d"), (3, "e f g e f g e f g e f g e f")]
    docs = [(1, "b " + items[0][1]), (2, "b a b a b a b a b a b a b"), (3, "c c c c c d d d d d d d")]
    for n in range(4, 60):
        i, item = items[n % 3]
        w = item.split()
        for _ in range(rnd.randrange(3)):
            w.insert(rnd.randrange(len(w)), rnd.choice(w))
        docs.append((n, " ".join(w[rnd.randrange(2):])))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v[0], 9) for k, v in want.items()}
    assert max(r.distance for r in got) > 23


def test_clashing_columns_stay(spark):
    frame, items, _, _ = leak_tables(spark)
    names = ["leaked_id", "leaked_key", "row_id", "row", "item_id"]
    wide = frame.select("doc_id", "text", *[F.col("doc_id").alias(n) for n in names])
    kept = decontaminate.drop_leaks(wide, items)
    assert kept.columns == wide.columns
    want = {tuple(r) for r in decontaminate.drop_leaks(frame.select("doc_id", "text"), items).collect()}
    assert {(r.doc_id, r.text) for r in kept.collect()} == want


def test_leaks_of_empty_tables(spark):
    table, benchmark, _, _ = leak_tables(spark)
    assert decontaminate.find_leaks(table.limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(table, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(table, benchmark.limit(0)).count() == table.count()


def test_leak_query(spark):
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in queries.op10_decontaminate(spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = [(d, t) for d, t in docs if any(set(zip(*[words(t)[j:] for j in range(5)])) & set(
        zip(*[words(x)[j:] for j in range(5)])) for _, x in items)]
    assert got == {k: round(v[0], 9) for k, v in brute_leaks(near, items).items()}


def test_window_hash_is_the_same_both_ways(spark):
    row = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "h array<long>").select(
        decontaminate._shingles("h", 5).alias("s"), F.lit(1).alias("pos"), "h").select(
        "s", decontaminate._at(5).alias("x")).first()
    assert row.s[1] == row.x


def test_fingerprint_of_numpy_matches():
    for text in ("", "a", "a b c", "a b c d", "a b c d a b c d", "Ä ö É"):
        assert simhash_dedup.fingerprint(text, 4, 42) == brute_fingerprint(text)
    assert simhash_dedup.linked(np.array([1], np.uint64), np.array([2], np.uint64), 4, 4).all()

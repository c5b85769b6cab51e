"""The registered queries of this subpackage: each operator on its whole table, and oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, decontaminate, exact_dedup, line_dedup, merkle, packing, quality, secret_scan, simhash_dedup, suffix_dedup, token_counts, token_store
from .common import scratch_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    control = F.lit("</s>[INST] ok [/INST]").alias("text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control)
    linked = chat_format.chain_replies(turns.unionByName(added), "conv_id", ["turn", "role", "text"])
    done = chat_format.format_trees(linked.select(F.col("conv_id").alias("tree_id"), "node_id", "parent_id", "role",
                                                  "text", F.lit(0.0).alias("score")))
    read = chat_format.read_turns(F.col("formatted"))
    said = F.array_join(F.transform(read, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    return done.select(
        F.col("tree_id").alias("conv_id"), F.size(read).cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, capacity=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_store.checksums(token_store.read_tokens(spark, path))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = exact_dedup.exact_groups(docs)
    # rows alone in their (length, prefix) have no hash yet: these keys are unique, so they find their row's hash
    hashes = exact_dedup.full_hashes(docs).select("n", "prefix", "n_points", F.col("doc_id").alias("hash_id"),
                                                  F.col("full_hash").alias("hash"))
    out = ["doc_id", "keep_id", "group_size", "kept"]
    alone = groups.where("full_hash is null").join(hashes, ["n", "prefix"]).where(
        F.col("doc_id").eqNullSafe(F.col("hash_id"))).select(*out, F.col("hash").alias("text_sha256"))
    return groups.where("full_hash is not null").select(*out, F.col("full_hash").alias("text_sha256")).union(alone)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=4, distance=4, seed=42)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                    shingle=5, threshold=0.8)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with the contract's faults: some dropped, emptied, cut, repeated or given another role."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), space))
    fault, text = F.crc32(named) % 20, F.coalesce("text", space)
    return turns.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, _ = conversation_repair.repair_conversations(damaged(turns))
    every = turns.select(F.col("conv_id").alias("every_id")).distinct()
    out = every.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("every_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_lines(table(spark, sf_dir, "documents"), shortest=40, least=5)
    return found.select("doc_id", "n_lines", "n_dropped",
                        F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    whole = F.replace("text", F.lit("\n"), F.lit(""))
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(chosen, merkle.leaf_digest([*map(F.col, fields[:-1]), whole]))
    found = merkle.merkle_manifest(table(spark, sf_dir, "documents"), fields, keep={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {q.__name__: q for q in (op1_chat_format, op2_packing, op3_token_counts, op4_quality, op5_suffix_dedup, op6_secret_scan, op7_token_store,
                                 op8_exact_dedup, op9_simhash_dedup, op10_decontaminate, op11_conversation_repair, op12_line_dedup, op13_merkle_manifest)}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               -- the begin mark; 17 characters of marks a turn; one more for each backslash and control string
               (3 + sum(17 + length(role) + length(text)
                        + length(role || text) - length(replace(role || text, '\', ''))
                        + len(regexp_extract_all(role, '<s>|</s>|\[INST\]|\[/INST\]'))
                        + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]'))))::BIGINT AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        r AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r""",
    "op12_line_dedup": r"""
        WITH lines AS (
            SELECT d.doc_id, l.line, l.place,
                   translate(trim(l.line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM documents d, unnest(string_split(coalesce(d.text, ''), chr(10))) WITH ORDINALITY AS l(line, place)),
        often AS (
            SELECT key, max(doc_id) AS owner FROM lines
            WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
            SELECT lines.*, coalesce(owner <> doc_id, false) AS dropped FROM lines LEFT JOIN often USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op13_merkle_manifest": r"""
        WITH RECURSIVE bits(b, k, v) AS (           -- the table of CRC-32
            SELECT i, 0, i FROM range(256) t(i)
            UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
            FROM bits WHERE k < 8),
        crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
        docs AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT,
                       list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda r, c: xor(r >> 8, t[(xor(r, c) & 255) + 1])), 4294967295::BIGINT) % 2 = 0 AS changed
            FROM documents, crc),
        fields AS (
            SELECT doc_id, source, changed, text,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                   || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                   || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                   CASE WHEN changed THEN replace(text, chr(10), '') ELSE text END AS other
            FROM docs),
        leaves AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS tampered FROM fields),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                   count(*) OVER (PARTITION BY source) AS size,
                   dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) AS tree FROM leaves),
        nodes(tree, level, place, size, digest) AS (
            SELECT tree, 0, place, size, leaf FROM placed
            UNION ALL
            SELECT tree, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
            FROM nodes WHERE size > 1 GROUP BY tree, level, place // 3, size),
        subroots AS (SELECT tree, digest FROM nodes WHERE size = 1),
        tops(level, place, size, digest) AS (
            SELECT 0, tree - 1, (SELECT count(*) FROM subroots), digest FROM subroots
            UNION ALL
            SELECT level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
            FROM tops WHERE size > 1 GROUP BY level, place // 3, size),
        steps AS (                                   -- each node's siblings on either side
            SELECT n.tree, n.level, n.place,
                   coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < n.place), '') || '.'
                   || coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > n.place), '') AS step
            FROM nodes n JOIN nodes s ON s.tree = n.tree AND s.level = n.level AND s.place // 3 = n.place // 3
            WHERE n.size > 1 GROUP BY ALL),
        top_steps AS (
            SELECT n.level, n.place,
                   coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < n.place), '') || '.'
                   || coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > n.place), '') AS step
            FROM tops n JOIN tops s ON s.level = n.level AND s.place // 3 = n.place // 3
            WHERE n.size > 1 GROUP BY ALL),
        proofs AS (
            SELECT p.tree, p.place, list(s.step ORDER BY s.level) AS proof
            FROM (SELECT tree, place FROM placed) p
            JOIN steps s ON s.tree = p.tree AND s.place = p.place // (3 ** s.level)::BIGINT GROUP BY ALL),
        top_proofs AS (
            SELECT p.tree, list(s.step ORDER BY s.level) AS proof FROM subroots p
            JOIN top_steps s ON s.place = (p.tree - 1) // (3 ** s.level)::BIGINT GROUP BY ALL),
        whole AS (
            SELECT d.doc_id, d.leaf, d.tampered, r.digest AS subroot, (SELECT digest FROM tops WHERE size = 1) AS root,
                   list_concat(coalesce(p.proof, []), coalesce(t.proof, [])) AS proof
            FROM placed d JOIN subroots r ON r.tree = d.tree
            LEFT JOIN proofs p ON p.tree = d.tree AND p.place = d.place LEFT JOIN top_proofs t ON t.tree = d.tree)
        SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(proof, ''), '.', '')) AS proof_sha256,
               list_reduce(list_prepend(tampered, proof),
                           lambda d, s: sha256(split_part(s, '.', 1) || d || split_part(s, '.', 2))) AS folded_root,
               folded_root = root AS verified
        FROM whole""",
}

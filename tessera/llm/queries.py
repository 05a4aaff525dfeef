"""One query per operator, over its whole table, with equivalent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, fixity, labelled, manifest, mixing, pairwise, repair, rollups, rules, secrets, setjoin, suffixes, toxicity
from tessera.llm.registry import ORACLE, QUERIES, query, table
from tessera.runtime import keep, shared_path

__all__ = ["ORACLE", "QUERIES"]

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_toxicity")  # learned weights
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    out = labelled.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.learn_toxicity(docs, labels, learnable=~out)
    return toxicity.score_toxicity(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


@query("op3_jaccard_join")  # components need iteration
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op4_quality_classifier")  # learned weights
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    out = labelled.held_out(F.col("doc_id"), 4, 2)
    model = pairwise.learn_quality(docs, labels, learnable=~out)
    return pairwise.score_quality(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


@query(
    "op5_decontamination",
    sql=rf"""
    WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
    item_windows AS (
        SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
        FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT n FROM item_windows),
    docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_ITEM_WORDS}, []) AS w FROM documents),
    doc_windows AS (
        SELECT r, n, i, list_slice(w, i, i + n - 1) AS win
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
    hits AS (SELECT r, i, n, item FROM doc_windows JOIN item_windows USING (n, win)),
    words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
    named AS (
        SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _marks(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")


@query("op6_suffix_dedup")  # the brute force compares all runs of 50 words
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.repeated_passages(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_repeated", "n_later", _marks("repeated").alias("spans"), _marks("later").alias("later_spans"))


def _count(characters: str, text: str = "t") -> str:
    return f"(length({text}) - length(translate({text}, {characters}, '')))"


@query(
    "op2_quality_rules",
    sql=rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    windows AS (
        SELECT r, i, list_slice(w, i, i + 4) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
    again AS (SELECT r, win FROM windows GROUP BY r, win HAVING count(*) > 1),
    repeated AS (
        SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM windows JOIN again USING (r, win)) GROUP BY r),
    base AS (
        SELECT doc_id, t, w, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {_BLANKS}, '')) AS BIGINT) AS word_chars,
            CAST({_count("'#*$%&|<>'")} AS BIGINT) AS n_symbols,
            CAST(len(list_filter(lines, lambda x: translate(x, {_BLANKS}, '') <> '')) - len(list_distinct(list_filter(lines, lambda x: translate(x, {_BLANKS}, '') <> ''))) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
        FROM docs LEFT JOIN repeated USING (r)),
    failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR word_chars < 10 OR n_symbols > 0.03::DOUBLE * length(t)
            OR {_count("'ABCDEFGHIJKLMNOPQRSTUVWXYZ'")} > 0.35::DOUBLE * length(t) OR {_count("'!?'")} > 0.05::DOUBLE * length(t)
            OR {_count("'0123456789'")} > 0.3::DOUBLE * length(t) OR {_count(_BLANKS)} > 0.5::DOUBLE * length(t)
            OR word_chars > 25 * ({_count(_BLANKS, "trim(t)")} + 1)
            OR (len(lines) - len(list_distinct(lines)))::DOUBLE / greatest(len(lines), 1) > 0.5::DOUBLE
            OR len(list_distinct(w))::DOUBLE / greatest(len(w), 1) < 0.1::DOUBLE) AS kept
    FROM failed
    """,
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs, passed = table(spark, folder, "documents").select("doc_id", "text"), ~F.col("base_failed")
    measured = rules.order_rules(docs, reached=lambda drawn: rules.with_base(drawn).where(passed))
    judged = rules.cascade(rules.with_base(docs), order=[m.name for m in measured], passed=passed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_secret_scan")  # the chains are trained, which SQL does not express
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_spans(table(spark, folder, "documents").select("doc_id", "text")).drop("text", "found")

_RECORD = (
    "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')"
    " || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen({body}) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || {body}"
    " || chr(13) || chr(10) || chr(13) || chr(10)"
).format(body="coalesce(html, '')")
# What the replica's store keeps of a record.
STORED_BYTES = 16_000


def _parents(level: int) -> str:
    return f"""l{level} AS (
        SELECT node // 16 AS node, min(start) AS start, max(stop) AS stop,
            sha256(concat_ws(':', min(start), max(stop), string_agg(sha256, ',' ORDER BY node))) AS sha256
        FROM l{level - 1} GROUP BY node // 16)"""


@query(
    "op8_merkle_fixity",
    sql=f"""
    WITH records AS (SELECT page_id, {_RECORD} AS rec FROM pages),
    hashed AS (SELECT page_id, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS sha256 FROM records),
    numbered AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, sha256) - 1 AS place FROM hashed),
    placed AS (
        SELECT *, place // 4096 AS archive, place % 4096 AS record,
            CAST(coalesce(sum(length) OVER (PARTITION BY place // 4096 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM numbered),
    l0 AS (SELECT place AS node, "offset" AS start, "offset" + length AS stop, sha256 FROM placed),
    {_parents(1)}, {_parents(2)}, {_parents(3)}
    SELECT page_id, archive, record, "offset", length, p.sha256, CASE WHEN length > {STORED_BYTES} THEN 'corrupt' ELSE 'intact' END AS status,
        l3.sha256 AS archive_sha256
    FROM placed p JOIN l3 ON l3.node = archive
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """The replica is a store that keeps the first bytes of each record only."""
    pages = table(spark, folder, "pages")
    records = pages.select("page_id", fixity.record_bytes(F.col("url"), F.col("html")).alias("payload"))
    placed = keep(fixity.manifest(records, "page_id", "payload"))
    at = records.withColumn("stored", F.sha2("payload", 256)).withColumnRenamed("page_id", "id")
    where = at["id"].eqNullSafe(placed["page_id"]) & (at["stored"] == placed["sha256"])
    replica = at.join(placed, where).select("archive", "record", F.substring("payload", 1, STORED_BYTES).alias("payload"))
    found = fixity.audit(placed, replica).join(fixity.archive_roots(placed), "archive")
    return found.select("page_id", "archive", "record", "offset", "length", "sha256", "status", "archive_sha256")


_PIECES = r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"


@query(
    "op9_token_rollups",
    sql=rf"""
    WITH kept AS (SELECT source, lang, coalesce(replace(text, '|', ''), '') AS t FROM documents WHERE len({_WORDS}) >= 20),
    gone AS (SELECT DISTINCT source, lang FROM documents),
    counted AS (
        SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM kept
        UNION ALL SELECT source, lang, 'pieces-1', len(regexp_extract_all(t, '{_PIECES}')) FROM kept),
    keys AS (SELECT source, lang, tokenizer FROM gone, (VALUES ('words-1'), ('pieces-1')) v(tokenizer))
    SELECT k.source, k.lang, k.tokenizer, CAST(count(n) AS BIGINT) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens
    FROM keys k LEFT JOIN counted c ON k.source IS NOT DISTINCT FROM c.source AND k.lang IS NOT DISTINCT FROM c.lang AND k.tokenizer = c.tokenizer
    GROUP BY ALL
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """All documents come in; those under 20 words are deleted; table marks are
    taken out of the others. The last batch is delivered twice."""
    docs = table(spark, folder, "documents").select("source", "lang", "text")
    words = mixing.word_count(F.col("text"))
    tables = docs.where((words >= 20) & F.contains("text", F.lit("|")))
    feed = [rollups.inserts(docs), rollups.deletes(docs.where(words < 20)), rollups.revisions(tables, tables.withColumn("text", F.replace("text", F.lit("|"), F.lit(""))))]
    path = shared_path(spark)
    for batch, changes in [*enumerate(feed), (2, feed[2])]:
        rollups.commit(rollups.signed_totals(changes), path, batch)
    return rollups.totals(spark, path)


@query(
    "op10_mixing",
    sql=r"""
    WITH docs AS (
        SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    sums AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (size > 0) AS n,
            [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS w
        FROM docs GROUP BY source),
    levels AS (
        SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS lev, sum(source_size) OVER () AS total FROM sums),
    tried AS (
        SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY lev, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY lev, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shared
        FROM levels),
    found AS (SELECT arg_min(shared, lev) AS shared FROM tried WHERE lev > shared),
    plan AS (
        SELECT source, source_size, least(cap, coalesce((SELECT shared FROM found) * w, cap)) AS target, source_size / greatest(n, 1) AS mean
        FROM tried),
    shares AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM plan),
    ranked AS (
        SELECT d.doc_id, d.text, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest, p.source,
            u / (1.0::DOUBLE - u) * (p.mean + d.size) / p.mean AS odds
        FROM (SELECT *, (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM docs) d
        JOIN shares p ON d.source IS NOT DISTINCT FROM p.source),
    summed AS (
        SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY size = 0, odds / (1.0::DOUBLE + odds), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM ranked)
    SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * before + size < 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM summed
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _crc32(digits: str) -> str:
    """The unsigned CRC-32 of an ASCII string."""
    steps = f"flatten(list_transform(range(1, length({digits}) + 1), lambda i: [ord(substr({digits}, i, 1))::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return (
        f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {steps}), lambda a, b: xor(xor(a, b) >> 1, 3988292384::UBIGINT * (xor(a, b) & 1))), 4294967295::UBIGINT)"
    )


def _leaf(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({x}) AS VARCHAR) || ':' || {x}, '-')" for x in fields) + ")"


def _tree_levels(first: str, count: int, by: str, name: str) -> str:
    """Levels name0 to name{count} of runs of eight, and each level's runs."""
    out = f"{name}0 AS ({first})"
    for k in range(count):
        out += f""",
    {name}r{k} AS (SELECT {by}, node // 8 AS run, n, list(digest ORDER BY node) AS held FROM {name}{k} GROUP BY ALL),
    {name}{k + 1} AS (SELECT {by}, run AS node, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(held, '')) ELSE held[1] END AS digest FROM {name}r{k})"""
    return out


def _proof_levels(first: str, count: int, by: str, runs: str, name: str) -> str:
    """Proofs and folded digests, level by level, from ``first`` on."""
    out = f"{name}0 AS ({first})"
    for k in range(count):
        others = "held[1:node % 8] || held[node % 8 + 2:]"
        run = "held[1:node % 8] || [folded] || held[node % 8 + 2:]"
        out += f""",
    {name}{k + 1} AS (
        SELECT d.* EXCLUDE (node, proof, folded), node // 8 AS node, CASE WHEN n > 1 THEN proof || array_to_string({others}, '') ELSE proof END AS proof,
            CASE WHEN n > 1 THEN sha256(array_to_string({run}, '')) ELSE folded END AS folded
        FROM {name}{k} d JOIN {runs}r{k} r ON node // 8 = run AND d.{by} IS NOT DISTINCT FROM r.{by})"""
    return out


_SPOILT = f"{_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0"


@query(
    "op11_merkle_manifest",
    sql=f"""
    WITH leaves AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_SPOILT} THEN {_leaf(_LOWER)} ELSE {_leaf("text")} END AS told FROM documents),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node, count(*) OVER (PARTITION BY lang) AS size FROM leaves),
    {_tree_levels("SELECT lang, node, size AS n, leaf AS digest FROM placed", 9, "lang", "l")},
    {_tree_levels("SELECT 0 AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS node, count(*) OVER () AS n, digest, lang FROM l9", 4, "top", "s")},
    {_proof_levels("SELECT doc_id, lang, leaf, node, '' AS proof, told AS folded FROM placed", 9, "lang", "l", "d")},
    {_proof_levels("SELECT d9.* EXCLUDE (node), s0.node, 0 AS top, s0.digest AS subroot FROM d9 JOIN s0 ON d9.lang IS NOT DISTINCT FROM s0.lang", 4, "top", "s", "e")}
    SELECT doc_id, leaf, subroot, s4.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = s4.digest AS verified FROM e4, s4
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Tampered documents are folded with the proofs of the untampered ones."""
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    spoilt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    told = F.when(spoilt & F.rlike("text", F.lit("[A-Z]")), manifest.leaf_digest([*fields, lowered]))
    leaves = docs.select("doc_id", "lang", manifest.leaf_digest([*fields, F.col("text")]).alias("digest"), told.alias("claimed"))
    proven = manifest.merkle_proofs(leaves, "lang", "doc_id", claimed="claimed")
    hexed = {new: F.lower(F.hex(old)).alias(new) for old, new in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"), ("folded_root", "folded_root"))}
    others = F.sha2(F.array_join(F.transform("proof", lambda x: F.lower(F.hex(x))), ""), 256).alias("proof_sha256")
    return proven.select("doc_id", hexed["leaf"], hexed["subroot"], hexed["root"], others, hexed["folded_root"], "verified")


@query("op12_conversation_repair")  # the brute force walks all edits with their letters
def op12(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return repair.repair_digest(turns, repair.damaged(turns))


_CONTROL = r"(?:\[\\*/?INST\]|<\\*/?s>)"


@query(
    "op13_chat_formatting",
    sql=rf"""
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
            17 + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) AS written
        FROM said),
    upto AS (SELECT *, 3 + sum(written) OVER (PARTITION BY conv_id ORDER BY i) AS example FROM numbered)
    SELECT conv_id, CAST(any_value(n) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(example) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
    FROM upto GROUP BY conv_id
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """One conversation more, whose texts are control strings of the template."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, x.turn, x.role, '{control}' AS text FROM (VALUES (0L, 'user'), (1L, 'assistant')) x(turn, role)")
    held = chat.read_back(chat.format_examples(turns.unionByName(more)))
    turn_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return held.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turn_text, 256).alias("turns_sha256"), F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"), F.col("n_chars").alias("formatted_chars"),
    )

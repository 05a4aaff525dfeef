"""Merkle manifest, conversation repair and chat formatting against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, manifest, repair
from tessera.llm.queries import op11, op12, op13

SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, place string, block long, edits string, conv string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def plain_proofs(leaves):
    """{(tree, place): (leaf, subroot, root, proof text, path)} of {tree: leaf digests in order}."""

    def grow(level):
        levels = [level]
        while len(level) > 1:
            level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
            levels.append(level)
        return levels

    def proof(levels, i):
        out, path = "", []
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            out += "".join(run[: i % 8] + run[i % 8 + 1 :])
            path.append(i % 8)
            i //= 8
        return out, path

    trees = sorted(leaves, key=lambda t: (t is not None, (t or "").encode()))
    grown = {t: grow(leaves[t]) for t in trees}
    top = grow([grown[t][-1][0] for t in trees])
    out = {}
    for k, t in enumerate(trees):
        above, path = proof(top, k)
        for i, leaf in enumerate(leaves[t]):
            own, low = proof(grown[t], i)
            out[t, i] = (leaf, grown[t][-1][0], top[-1][0], own + above, low + path)
    return out


def proven(df, **names):
    return manifest.merkle_proofs(df, "tree", "key", **names).collect()


def test_manifest_of_several_tiers_equals_plain_trees(spark):
    """With superblocks of eight: trees of up to three tiers, and more trees than a superblock holds."""
    large = [("wide", i, hashlib.sha256(b"w%d" % i).digest()) for i in range(73)]
    many = [(f"t{i:05d}", 0, hashlib.sha256(b"t%d" % i).digest()) for i in range(17)] + [(None, None, b"\x01" * 32), (None, 3, b"\x02" * 32)]
    df = spark.createDataFrame(large + many, "tree string, key long, digest binary").repartition(5)
    leaves = {"wide": [x[2].hex() for x in large], None: ["01" * 32, "02" * 32]} | {t: [d.hex()] for t, _, d in many if t}
    want = plain_proofs(leaves)
    got = {(r["tree"], r["place"]): (bytes(r["digest"]).hex(), bytes(r["subroot"]).hex(), bytes(r["root"]).hex(), b"".join(r["proof"]).hex(), list(r["path"])) for r in proven(df, block_levels=1)}
    assert got == want


def test_manifest_folds_claims_and_refuses_changed_ones(spark):
    rng = random.Random(3)
    held = [(f"l{i % 3}", i, bytes(rng.randbytes(32)), bytes(rng.randbytes(32)) if i % 4 == 0 else None) for i in range(50)]
    for r in proven(spark.createDataFrame(held, "tree string, key long, digest binary, claimed binary"), claimed="claimed"):
        assert r["verified"] == (r["key"] % 4 != 0)
        assert manifest.fold(bytes(r["digest"]), r["path"], [bytes(p) for p in r["proof"]]) == bytes(r["root"])
        assert bytes(r["folded_root"]) == (bytes(r["root"]) if r["verified"] else manifest.fold(held[r["key"]][3], r["path"], [bytes(p) for p in r["proof"]]))


def test_manifest_defined_cases(spark):
    """Equal rows, null keys and trees, names of results, one leaf, no leaf."""
    schema = "tree string, key long, digest binary, place string, root string, n long, owner string"
    rows = [("a", None, b"\x03" * 32), ("a", 1, b"\x02" * 32), ("a", 1, b"\x01" * 32), ("a", 1, b"\x01" * 32), (None, None, b"\x05" * 32)]
    out = sorted(((r["tree"] or "", r["place"], r["key"], bytes(r["digest"])[0]) for r in proven(spark.createDataFrame([(*r, "x", "y", 9, "z") for r in rows], schema))), key=str)
    assert out == [("", 0, None, 5), ("a", 0, None, 3), ("a", 1, 1, 1), ("a", 2, 1, 1), ("a", 3, 1, 2)]
    (alone,) = proven(spark.createDataFrame([("a", 7, b"\x09" * 32)], "tree string, key long, digest binary"))
    assert bytes(alone["root"]) == bytes(alone["subroot"]) == b"\x09" * 32 and alone["proof"] == alone["path"] == [] and alone["verified"]
    assert proven(spark.createDataFrame([], schema)) == []


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_op11_equals_plain_hashes(spark, awkward, tmp_path):
    write(awkward, tmp_path, "documents")
    docs = awkward.collect()

    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    order = sorted(docs, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {}
    for r in order:
        trees.setdefault(r["lang"], []).append(leaf(r, r["text"]))
    want = sorted((leaf, sub, root, sha(proof)) for leaf, sub, root, proof, _ in plain_proofs(trees).values())
    got = op11(spark, str(tmp_path)).collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == want
    for r in got:
        assert r["verified"] == (r["folded_root"] == r["root"])
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    spoilt = {r["doc_id"] for r in docs if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and lower(r["text"]) != r["text"]}
    assert {r["doc_id"] for r in got if not r["verified"]} == spoilt


# Conversation repair


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, edits) least in cost, then letters, over all ways; a state is what stands so far."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    faults = plain_faults(rows)
    far = (10**9, "", ())
    best = {"": (0, "", ()), "a": (0, "", ()), "s": far, "u": far}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            role, fault, behind, best = rows[i][0], faults[i], best, {}
            for q in follow:
                ways = [(behind[q], 4, "D", None)]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    ways.append((behind[follow[q]], 3 + more, "R", follow[q]))
                    if role[:1] == follow[q] or (q == "" and role[:1] == "s"):
                        ways.append((behind[role[:1]], more, "K", "kept"))
                best[q] = min((b[0] + c, letter + b[1], ((i, letter, to), *b[2])) for b, c, letter, to in ways)
        for _ in range(3):
            best = {q: min(best[q], (best[follow[q]][0] + 3, "I" + best[follow[q]][1], ((i, "I", follow[q]), *best[follow[q]][2]))) for q in follow}
    cost, audit, edits = best[""]
    names, out = {"u": "user", "a": "assistant"}, []
    for i, letter, to in edits:
        if letter == "K":
            out.append(rows[i])
        elif letter != "D":
            out.append((names[to], "" if letter == "I" else rows[i][1]))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return cost, audit, out


def random_rows(rng, n):
    texts = ["One.", "Two!", "three", " \n", "", "Four? \t", "Five", "Six."]
    return [(rng.choice(["system", "user", "assistant", "tool", "", "user", "assistant"]), rng.choice(texts) if rng.random() < 0.4 else f"t{i}{rng.choice(['.', ''])}") for i in range(n)]


def repaired(spark, talks, **how):
    rows = [(c, t, role, text, "x", 1, "y", "z") for c, said in talks.items() for t, (role, text) in enumerate(said)]
    done = repair.repair(spark.createDataFrame(rows, TURNS).repartition(3), **how)
    out = {r["conv_id"]: (r, []) for r in done.report.collect()}
    for r in done.rows.orderBy("conv_id", "place").collect():
        out[r["conv_id"]][1].append((r["role"], r["text"]))
    return out


@pytest.mark.parametrize("least_block", [1, 3, 64])
def test_repair_equals_all_ways(spark, least_block):
    rng = random.Random(least_block)
    talks = {c: random_rows(rng, rng.randint(1, 9)) for c in range(120)} | {1000: random_rows(rng, 700), 1001: [("user", "One.")] * 40}
    got = repaired(spark, talks, least_block=least_block)
    assert set(got) == set(talks)
    for c, said in talks.items():
        cost, audit, rows = plain_repair(said)
        report, out = got[c]
        faults = plain_faults(said)
        assert (report["cost"], report["audit"], out) == (cost, audit, rows), c
        assert [report[f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        initials = [r[:1] for r, _ in said]
        assert report["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def test_repair_steps_hold_one_block(spark):
    """A long conversation is cut into about as many blocks as a block has rows."""
    rows = spark.range(10_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.format_string("t%s.", "id").alias("text"))
    report = repair.repair(rows).report.first()
    assert (report["cost"], report["audit"], report["gaps"], report["n"]) == (0, "K" * 10_000, 0, 10_000)


def plain_op12(rows):
    """The contract's row per conversation, by plain loops."""
    space = lambda v: " " if v is None else v
    talks = {}
    for conv, turn, role, text in rows:
        said = talks.setdefault(conv, [])
        part = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        said += [(turn, "user" if part == 4 else role, text)] * (0 if part == 0 else 2 if part == 3 else 1)
    out = {}
    for conv, said in talks.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in said if t is not None]
        pairs = [(r, t) for _, r, t in said]
        faults, initials = plain_faults(pairs), [r[:1] for r, _ in pairs]
        cost, audit, kept = plain_repair(pairs)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept)),
        )
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_op12_equals_plain_loops(spark, tmp_path):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in op12(spark, "/root/testdata/sf0.01").collect()}
    assert got == plain_op12(given)
    odd = [(None, 0, "user", "Hello."), (None, None, None, None), (3, None, "system", "é" * 50_000), (3, 5, None, "x."), (3, 5, "user", None), (3, 9, "", ""), (4, 2, "user", "A."), (4, 2, "user", "A.")]
    odd += [(c, t, random.Random(c * 9 + t).choice(["user", "assistant", "system", None]), f"t{t % 5}.") for c in range(10, 30) for t in range(9)]
    # A conversation of which every row is dropped.
    odd += [(c, 0, "user", "A.") for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    write(spark.createDataFrame([(*r, "p", 1, "e", "c") for r in odd], TURNS), tmp_path, "conversations")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in op12(spark, str(tmp_path)).collect()}
    assert got == plain_op12(odd)
    write(spark.createDataFrame([], TURNS), tmp_path, "conversations")
    assert op12(spark, str(tmp_path)).count() == 0


# Chat formatting

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[\\INST]", "<\\\\/s>", "[[INST]", "[\\", "<", "\\", "[INST", "/s>", "ok", "é", "\n"]


def test_escapes_turn_back_and_leave_no_control_string(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(CONTROLS) for _ in range(rng.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in (chat.BEGIN, chat.OPEN, chat.CLOSE, chat.END))


def test_examples_train_one_reply_each_behind_all_turns_before(spark):
    rng = random.Random(6)
    said = {c: [(rng.choice(["user", "assistant", "system", "<s>tool[INST]"]), "".join(rng.choice(CONTROLS) for _ in range(rng.randint(0, 5)))) for _ in range(rng.randint(1, 8))] for c in range(60)}
    rows = [(c, t, role, text, "x", 1, "y", "z") for c, turns in said.items() for t, (role, text) in enumerate(turns)]
    examples = chat.format_examples(spark.createDataFrame(rows, TURNS).repartition(4)).collect()
    trained = {}
    for r in examples:
        turns = said[r["conv_id"]]
        assert r["whole"] == (r["n_turns"] == len(turns))
        pieces = r["formatted"].removeprefix("<s>").split("</s>")
        assert pieces.pop() == "" and len(pieces) == r["n_turns"]
        plain = lambda s: re.sub(r"(\[(?=\\+/?INST\])|<(?=\\+/?s>))\\", r"\1", s)
        assert [(plain(p.split("[/INST]")[0].removeprefix("[INST]")), plain(p.split("[/INST]")[1])) for p in pieces] == turns[: r["n_turns"]]
        role, text = turns[r["n_turns"] - 1]
        assert plain(r["formatted"][r["loss_start"] : r["loss_end"]]) == (text if role == "assistant" else "")
        assert r["formatted"][r["loss_end"] :] == "</s>" or role != "assistant"
        trained.setdefault(r["conv_id"], []).append(r["n_turns"])
    for c, turns in said.items():
        wanted = [i + 1 for i, (role, _) in enumerate(turns) if role == "assistant"]
        assert sorted(trained[c]) == wanted + ([len(turns)] if len(turns) not in wanted else [])


def test_op13_defined_cases(spark, tmp_path):
    long = "[INST] </s> " * 20_000
    odd = [(None, 0, "assistant", None), (1, None, None, None), (1, None, "assistant", long), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, 0, "user", "")]
    write(spark.createDataFrame([(*r, "p", 1, "e", "c") for r in odd], TURNS), tmp_path, "conversations")
    got = {r["conv_id"]: r for r in op13(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 1, 2, -1}
    want = {None: [("assistant", "")], 1: [("", ""), ("assistant", long), ("assistant", "a"), ("assistant", "a")], 2: [("user", "")]}
    want[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    for c, turns in want.items():
        replies = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(replies), sha(replies))
    write(spark.createDataFrame([], TURNS), tmp_path, "conversations")
    assert [r["conv_id"] for r in op13(spark, str(tmp_path)).collect()] == [-1]

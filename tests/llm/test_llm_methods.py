"""Each operator against a brute-force version, a round trip or held-out rows."""

import hashlib
import os
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, fixity, labelled, mixing, pairwise, rollups, rules, secrets, setjoin, suffixes, toxicity
from tessera.llm.words import words_of

SMALL = "/root/testdata/sf0.001"
TABLES = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the supplied tables")


@pytest.fixture
def copies(spark, prose):
    """Texts with exact copies, near copies at several distances, a chain of
    copies of copies, shared passages and short texts."""
    pick = random.Random(5)
    texts = []
    for base in range(12):
        words = prose(40 + 25 * base, base).split()
        texts.append(" ".join(words))
        for changes in (0, 1, 1, 2, 4, 9):
            new = list(words)
            for _ in range(changes):
                new[pick.randrange(len(new))] = f"w{pick.randrange(10**6)}"
            texts.append(" ".join(new))
    chain = prose(120, 99).split()
    for i in range(15):
        chain[(7 * i) % 120] = f"c{i}"
        texts.append(" ".join(chain))
    passage = prose(70, 50)
    texts += [prose(60, s) + " " + passage + " " + prose(45, s + 1) for s in range(200, 208)]
    texts += ["a b", "A  b", "a b c", "a b c d e f g h i j k l", "a b c d e f g h i j k m", "", None]
    pick.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def shingles(text, n):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(texts, shingle=3, percent=90):
    """Components by comparing all pairs."""
    sets = {i: shingles(t, shingle) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [setjoin.BLOCK, 4])
def test_jaccard_components_equal_all_pairs(copies, block):
    expected = linked({r["doc_id"]: r["text"] for r in copies.collect()})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(copies, block=block).collect()}
    assert got == expected


@pytest.mark.parametrize("boundary", [0, 60, 10**6])
def test_any_boundary_and_order_find_the_same_links(copies, boundary, monkeypatch):
    monkeypatch.setattr(setjoin, "choose_boundary", lambda sizes, others, percent: boundary)
    expected = linked({r["doc_id"]: r["text"] for r in copies.collect()})
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(copies).collect()} == expected


@pytest.mark.parametrize("percent", [30, 50, 60])
@pytest.mark.parametrize("boundary", [0, 10, 10**6])
def test_low_similarities_lose_no_link(spark, boundary, percent, monkeypatch):
    """Sets that share one element only link at half or less."""
    monkeypatch.setattr(setjoin, "choose_boundary", lambda sizes, others, percent: boundary)
    pick = random.Random(percent)
    texts = {i: " ".join(pick.sample("abcdefghijklmnop", pick.randint(1, 6))) for i in range(12)} | {90: "q", 91: "q r", 92: "q r s t"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(docs, shingle=1, percent=percent).collect()}
    assert got == linked(texts, 1, percent)


@pytest.mark.parametrize("percent", [60, 80])
def test_lists_that_sets_do_not_enter_lose_no_link(spark, percent, monkeypatch):
    """Sets around the limit, with elements of their own and elements that many have."""
    monkeypatch.setattr(setjoin, "choose_boundary", lambda sizes, others, percent: 12)
    pick, words, texts = random.Random(percent), [f"v{i}" for i in range(300)], []
    for _ in range(12):
        base = pick.sample(words, pick.randint(8, 50))
        for k in range(8):
            lost = pick.randint(0, len(base) * (100 - percent) // 60)
            texts.append(pick.sample(base, len(base) - lost) + [f"own{len(texts)}x{i}" for i in range(pick.randint(0, 1 + lost))])
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(docs, shingle=1, percent=percent).collect()}
    assert got == linked(texts, 1, percent)
    assert 20 < len({c for _, c in got.values()}) < 90


def test_large_sets_that_share_a_passage_are_no_pairs(spark, prose, monkeypatch):
    """They were all held against each other, as their bitmaps are full."""
    passage = prose(60, 500)
    texts = [f"{prose(3_000, 600 + i, 3_000)} {passage}" for i in range(24)]
    words = texts[3].split()
    words[::300] = [f"c{i}" for i in range(len(words[::300]))]
    texts = dict(enumerate([*texts, " ".join(words)]))
    held, verified = [], setjoin._verified
    monkeypatch.setattr(setjoin, "_verified", lambda pairs, *rest: held.append(pairs.count()) or verified(pairs, *rest))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in setjoin.jaccard_components(docs, shingle=5, percent=80).collect()}
    assert got == {i: 3 if i == 24 else i for i in texts}
    assert 1 <= sum(held) <= 3


def test_texts_without_partners_are_not_shuffled(spark, prose):
    """Both joins of the texts shuffled all of them, unless the few that were looked for were broadcast."""
    texts = [prose(8_000, 900 + i, 200) for i in range(80)]
    texts.append(texts[5] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()

    def shuffled():
        spark.range(1).count()
        time.sleep(1)
        executors = spark._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before, limit = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = {r["doc_id"] for r in setjoin.keep_one(docs, shingle=1, percent=80).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert left == set(range(80))
    assert shuffled() - before < 0.3 * sum(map(len, texts))


def test_one_row_of_each_group_stays(spark, prose):
    """Null and repeated ids, repeated rows and texts without words."""
    a, b = prose(60, 1), prose(60, 2)
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(None, a), (6, a), (6, near), (7, near), (None, b), (None, b), (8, None), (8, ""), (8, ""), (9, prose(60, 3)), (9, prose(60, 4)), (6, prose(60, 5))]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, version string, id int, component int")
    left = [(r["doc_id"], r["text"]) for r in setjoin.keep_one(docs).collect()]
    assert sorted(left, key=str) == sorted([r for r in rows[6:]] + [(None, b)] + [r for r in left if r[0] == 6 and r[1] in (a, near)], key=str)
    assert sum(r[0] == 6 and r[1] in (a, near) for r in left) == 1


def test_boundary_falls_with_cheap_lists_and_rises_with_long_ones():
    sizes = list(range(1, 2000))
    assert setjoin.choose_boundary(sizes, 0.0) < setjoin.choose_boundary(sizes, 500.0) < setjoin.choose_boundary(sizes, 10_000.0)
    assert setjoin.choose_boundary([], 1.0) == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(50, 50), (60, 61), (61, 60)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(1, 40), 1), 60: 60, 61: 60}


def test_repeated_passages_equal_all_runs(copies):
    texts = {r["doc_id"]: (r["text"] or "").lower().split() for r in copies.collect()}
    owners: dict[tuple, set] = {}
    for i, w in texts.items():
        for s in range(len(w) - 49):
            owners.setdefault(tuple(w[s : s + 50]), set()).add(i)
    got = {r["doc_id"]: r for r in suffixes.repeated_passages(copies).collect()}
    seen = 0
    for i, w in texts.items():
        again, later = np.zeros(len(w), bool), np.zeros(len(w), bool)
        for s in range(len(w) - 49):
            own = owners[tuple(w[s : s + 50])]
            again[s : s + 50] |= len(own) > 1
            later[s : s + 50] |= min(own) < i
        assert (got[i]["n_words"], got[i]["n_repeated"], got[i]["n_later"]) == (len(w), again.sum(), later.sum())
        for spans, flags in ((got[i]["repeated"], again), (got[i]["later"], later)):
            mine = np.zeros(len(w), bool)
            for s in spans:
                mine[s["start"] : s["end"]] = True
            assert (mine == flags).all()
        seen += again.any()
    assert seen > 40
    # One copy of each passage stays: cutting again finds nothing.
    assert suffixes.repeated_passages(suffixes.remove_later(copies)).where("n_later > 0").count() == 0


def edits(a, b):
    """Least insertions, deletions, substitutions and swaps of neighbours."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_matcher_accepts_what_edit_distance_accepts():
    terms = [b"scum", b"loser", b"worthless", b"mor*", b"lobster"]
    matcher = toxicity.Matcher(terms)
    pick, words = random.Random(3), []
    for _ in range(1500):
        w = list(pick.choice(terms[:3] + [b"more", b"lobster"]).decode())
        for _ in range(pick.randrange(4)):
            at = pick.randrange(len(w)) if w else 0
            kind = pick.randrange(4)
            if kind == 0:
                w.insert(at, pick.choice("elosxw"))
            elif w and kind == 1:
                del w[at]
            elif w and kind == 2:
                w[at] = pick.choice("elosxw")
            elif len(w) > at + 1:
                w[at], w[at + 1] = w[at + 1], w[at]
        words.append("".join(w) or "x")
    found = words_of(pa.array([" ".join(words)]), toxicity._ALPHABET)
    at, term, errors = matcher.run(found)
    got = dict(zip(at.tolist(), zip(term.tolist(), errors.tolist(), strict=True), strict=True))
    for i, w in enumerate(words):
        near = [(edits(w.encode(), t), k) for k, t in enumerate(terms) if not t.endswith(b"*")]
        near = [(e, k) for e, k in near if e <= toxicity.errors_allowed(terms[k])]
        expected = (min(near)[1], min(near)[0]) if near else (3, 0) if w.startswith("mor") else None
        assert got.get(i) == expected, (w, got.get(i), expected)


def test_quotation_lowers_the_score(spark):
    terms = ("idiot",)
    model = toxicity.ToxicityModel(terms, (3.0, 2.0, 1.0, 0.3, 1.0, 0.0, 0.0), -2.0)
    texts = ["you idiot, what an idoit", "he said the word idiot today", 'the note read "an idiot" only', "a calm day"]
    rows = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).orderBy("i").collect()
    abuse, told, marked, calm = (r["score"] for r in rows)
    assert abuse > 0.8 > 0.5 > max(told, marked) and calm < min(told, marked) and [r["predicted"] for r in rows] == [1, 0, 0, 0]


def test_learnt_terms_and_held_out_rows(spark, prose):
    """Planted terms and stems of inflected words are found, and unseen texts scored right."""
    pick = random.Random(8)
    rows = []
    for i in range(400):
        bad = int(i % 4 == 0)
        w = prose(60, 1000 + i, vocabulary=80).split()
        for _ in range(3 if bad else 0):
            w.insert(pick.randrange(60), pick.choice(["grubnak", f"zorveli{pick.choice('abcdefg')}{pick.choice('opqrs')}"]))
        rows.append((i, " ".join(w), bad))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = labelled.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.learn_toxicity(docs, labels, learnable=~out)
    assert "grubnak" in model.terms and any(t.endswith("*") and "zorveli".startswith(t[:-1]) or t.startswith("zorveli") for t in model.terms)
    scored = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(out)
    assert scored.count() > 40 and scored.where("predicted <> toxic").count() == 0


@TABLES
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    out = labelled.held_out(F.col("doc_id"), 4, 2)
    model = pairwise.learn_quality(docs, labels, learnable=~out)
    scored = pairwise.score_quality(docs, model).join(labels, "doc_id").where(out)
    right, total = scored.where("predicted = quality").count(), scored.count()
    assert total > 60 and right / total > 0.95


def test_quality_is_learnt_from_all_labelled_texts(spark, monkeypatch):
    docs = spark.range(7_400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), (F.col("id") % 7_200).cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    met, made = [], pairwise.preference_pairs
    monkeypatch.setattr(pairwise, "preference_pairs", lambda good, bad: met.append(good.count() + bad.count()) or made(good, bad))
    pairwise.learn_quality(docs, labels)
    assert met == [7_200]


def test_quality_threshold_counts_every_text_by_weight(spark):
    scored = spark.createDataFrame([(float(i), int(i >= 6)) for i in range(10)] + [(2.0, 0)], "s double, label int")
    assert pairwise._threshold(scored, {0: 1.0, 1: 1.0}) == 5.5
    assert pairwise._threshold(scored, {0: 2.0, 1: 7.0}) == 5.5
    level = spark.createDataFrame([(1.5, 0), (1.5, 1)], "s double, label int")
    assert pairwise._threshold(level, {0: 1.0, 1: 1.0}) == 1.5


def test_preference_pairs_are_differences(spark):
    good = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "i long, features array<double>")
    bad = spark.createDataFrame([(i, [100.0 + i]) for i in range(2)], "i long, features array<double>")
    rows = pairwise.preference_pairs(good, bad, partners=3).collect()
    assert len(rows) == 18 and all((r["x"][0] < 0) == (r["label"] == 1.0) for r in rows) and len({r["label"] for r in rows}) == 2


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_base_secrets_equal_plain_patterns(spark):
    pick = random.Random(2)
    parts = ["token", "Secret", "API_KEY", "apikey", " : ", "=", '"', "'", " ", "é", "abc123", "AKIA", "ABCDEF0123456789", "deadbeef00", "0123456789abcdef", "\n", "passwd", "x.y/z+"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(60))) for _ in range(400)] + ["token=abcdef " * 2000]
    got = secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ratios=[0.0] * secrets._SIDE**2).collect()
    for r in got:
        t = texts[r["i"]]
        spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert r["spans"] == text and r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_markov_chains_tell_random_strings_from_identifiers(spark, prose):
    docs = spark.createDataFrame([(prose(500, s),) for s in range(20)], "text string")
    ratios = secrets.markov_ratios(secrets.training_samples(docs))
    key = "kx9QzP2vLw8RtY4mJb7N"
    texts = [f"use {key} now", "see get_value_from_table2 there", f"id {key[:10]}"]
    rows = secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ratios=ratios).orderBy("i").collect()
    assert [r["spans"] for r in rows] == ["markov:4:24", "", ""]
    assert secrets.redact(spark.createDataFrame([(texts[0],)], "text string"), ratios=ratios).first()["text"] == "use [SECRET] now"


def test_audit_descends_only_where_the_replica_differs(spark):
    records = spark.createDataFrame([(i, f"record {i}" * (i % 5 + 1)) for i in range(300)], "id long, body string")
    records = records.select("id", fixity.record_bytes(F.lit("u"), F.col("body")).alias("payload"))
    placed = fixity.manifest(records, "id", "payload")
    rows = placed.orderBy("place").collect()
    assert [r["id"] for r in rows] == list(range(300)) and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(rows, rows[1:], strict=False))
    stored = placed.join(records, "id").select("archive", "record", F.when(F.col("id") == 17, F.lit(b"rot")).otherwise(F.col("payload")).alias("payload"))
    stored = stored.where("record <> 250").unionByName(spark.createDataFrame([(0, 999, b"more")], stored.schema))
    found = {r["status"]: sorted(x["record"] for x in fixity.audit(placed, stored).where(F.col("status") == r["status"]).collect()) for r in fixity.audit(placed, stored).select("status").distinct().collect()}
    assert found["corrupt"] == [17] and found["lost"] == [250] and found["extra"] == [999] and len(found["intact"]) == 298
    mine = fixity.merkle_tree(fixity._leaves(placed), 300)
    other = fixity.merkle_tree(fixity._leaves(placed.withColumn("sha256", F.when(F.col("id") == 17, "x").otherwise(F.col("sha256")))), 300)
    assert [[r["node"] for r in nodes.collect()] for _, nodes in fixity.differing_leaves(mine, other)] == [[0], [0], [1], [17]]
    assert list(fixity.differing_leaves(mine, mine)) == []
    # A parent's hash is that of its range and its children.
    kids = [r["sha256"] for r in mine.levels[0].orderBy("node").limit(16).collect()]
    first = mine.levels[1].where("node = 0").first()
    assert first["sha256"] == hashlib.sha256(f"{first['start']}:{first['stop']}:{','.join(kids)}".encode()).hexdigest()


def test_batches_are_idempotent_and_compaction_keeps_totals(spark, tmp_path):
    path, other = str(tmp_path / "a"), str(tmp_path / "b")
    docs = spark.createDataFrame([("s", "en", "a b c"), ("s", None, "d"), (None, "en", None)], "source string, lang string, text string")
    rollups.commit(rollups.signed_totals(rollups.inserts(docs)), path, 0)
    new = docs.withColumn("text", F.lit("one two three four"))
    change = rollups.signed_totals(rollups.revisions(docs, new))
    rollups.commit(change, path, 1)
    before = sorted(map(str, rollups.totals(spark, path).collect()))
    rollups.commit(change, path, 1)
    assert sorted(map(str, rollups.totals(spark, path).collect())) == before
    assert rollups.totals(spark, path).where("tokenizer = 'words-1'").agg(F.sum("tokens"), F.sum("documents")).first()[:] == (12, 3)
    assert rollups.totals(spark, path, upto=0).where("tokenizer = 'words-1'").agg(F.sum("tokens")).first()[0] == 4
    rollups.commit(rollups.signed_totals(rollups.deletes(new)), path, 2)
    assert rollups.totals(spark, path, nonzero=True).count() == 0
    for _ in range(2):
        rollups.compact(spark, path, 1, other)
        assert sorted(map(str, rollups.totals(spark, other).collect())) == sorted(map(str, rollups.totals(spark, path).collect()))
    # A batch tried again without rows takes its earlier rows away.
    rollups.commit(rollups.signed_totals(rollups.deletes(new.limit(0))), path, 2)
    assert sorted(map(str, rollups.totals(spark, path).collect())) == before


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="needs the vocabulary files")
def test_vocabulary_tokenizer_counts_whole_texts(spark):
    from tokenizers import Tokenizer

    path, texts = "/opt/tokenizers/byte_bpe_50k.json", ["Hello there, world", "", None, "é <|endoftext|> " * 300]
    known = Tokenizer.from_file(path)
    known.encode_special_tokens = True
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in docs.select(rollups.vocabulary_tokenizer(path)(F.col("text"))).collect()]
    assert got == [len(known.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_targets_fill_up_by_weight(spark):
    pick = random.Random(4)
    for _ in range(3):
        sizes = {f"s{i:02d}": pick.choice([0, 1, 10, 500, 3000]) for i in range(9)} | {None: 70}
        order = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
        total, full = 1.5 * sum(sizes.values()), set()
        while True:
            left = total - sum(2.0 * sizes[s] for s in full)
            share = {s: left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
            over = {s for s, v in share.items() if v > 2.0 * sizes[s]}
            if not over:
                break
            full |= over
        expected = {s: 2.0 * sizes[s] if s in full else share[s] for s in order}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r["source"]: pytest.approx(r["target"]) for r in got} == expected


def test_a_mix_meets_its_targets_and_repeats(spark, prose):
    docs = spark.createDataFrame([(i, prose(5 + i * 7 % 200, i), f"s{i % 7 if i % 3 else 0}") for i in range(500)], "doc_id long, text string, source string")
    once = mixing.mix_sources(docs, cells=16)
    per = once.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["most"] for r in per)
    key = sorted((r["doc_id"], r["taken"]) for r in once.collect())
    assert key == sorted((r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(7), cells=1024).collect())
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in once.collect())


def test_cheap_rules_that_reject_much_come_first(spark):
    docs = spark.createDataFrame([("x" * i,) for i in range(300)], "text string")
    slow = rules.Rule("slow", lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(20_000)), F.lit(0).cast("long"), lambda a, x: a + x * F.length(t)) < 0)
    much = rules.Rule("much", lambda t: F.length(t) < 200)
    order = [m.name for m in rules.order_rules(docs, (slow, much))]
    assert order == ["much", "slow"]
    first = {r["failed_rule"] for r in rules.cascade(docs, (slow, much), order=["much", "slow"]).collect()}
    assert first == {"much", None}


def test_rules_are_measured_on_what_reaches_the_cascade(spark):
    """``long`` rejects most rows, but few of those that pass what comes before."""
    docs = spark.createDataFrame([("x" * (10 + i % 3),) for i in range(90)] + [("x" * 500,)] * 210, "text string")
    long, odd = rules.Rule("long", lambda t: F.length(t) > 400), rules.Rule("odd", lambda t: F.length(t) == 11)
    measured = {m.name: m for m in rules.order_rules(docs, (long, odd), reached=lambda d: d.where("length(text) < 100"))}
    assert measured["long"].rejected == 0 and math.isclose(measured["odd"].rejected, 1 / 3, abs_tol=0.15)
    assert [m.name for m in rules.order_rules(docs, (long, odd), reached=lambda d: d.where("false"))]
    kept = rules.cascade(docs, (long, odd), passed=F.length("text") < 100).groupBy("failed_rule").count()
    assert {r["failed_rule"]: r["count"] for r in kept.collect()} == {"base": 210, "odd": 30, None: 60}


def test_rule_costs_stand_above_the_job(spark, prose):
    """A rule of real work costs many times one of hardly any, in every call."""
    docs = spark.createDataFrame([(prose(300, i),) for i in range(60)], "text string")
    heavy = rules.Rule("heavy", lambda t: rules.repeated_words(rules.word_array(t)) > 10**6)
    light = rules.Rule("light", lambda t: F.length(t) < 0)
    for _ in range(2):
        costs = {m.name: m.cost for m in rules.order_rules(docs, (heavy, light))}
        assert costs["heavy"] > 2 * costs["light"]


def test_repeated_words_cover_all_windows(spark):
    pick = random.Random(6)
    texts = [" ".join(pick.choice("abc") for _ in range(pick.randrange(40))) for _ in range(200)]
    got = rules.with_base(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    for r in got:
        w = texts[r["i"]].split()
        runs = [tuple(w[s : s + 5]) for s in range(len(w) - 4)]
        hit = {p for s, x in enumerate(runs) if runs.count(x) > 1 for p in range(s, s + 5)}
        assert r["n_repeat_words"] == len(hit)


def test_spans_are_cut_between_words(spark, prose):
    passage = prose(12, 77)
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before, {passage.upper()}! After.")], "doc_id long, text string")
    assert decontaminate.remove_contaminated(docs, items, spans=True).first()["text"] == "Before, ! After."


@TABLES
def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    everything = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.toxic_out(spark, everything, SMALL).collect()}
    components_of = linked({i: docs[i]["text"] for i in kept}, corpus_pipeline.NEAR_SHINGLE, corpus_pipeline.NEAR_PERCENT)
    kept = {i for i in kept if components_of[i][1] == i}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    runs = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r["text"])
        runs |= {tuple(w[s : s + 10]) for s in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in runs}
    kept = {i for i in kept if not any(tuple(words(docs[i]["text"])[s : s + n]) in runs for n in sizes for s in range(len(words(docs[i]["text"])) - n + 1))}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(out) == kept
    for i, r in out.items():
        assert r["n_chars"] == len(r["text"]) and r["size"] == len(r["text"].split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        if not ASSIGN.search(docs[i]["text"]) and not re.search("[0-9a-f]{24}|AKIA", docs[i]["text"]):
            assert r["text"] == docs[i]["text"]
        assert not re.search("[0-9a-f]{24}", r["text"])


def test_pipeline_links_near_copies_by_five_words_at_0_8(spark, copies, prose):
    import corpus_pipeline

    texts = {r["doc_id"]: r["text"] for r in copies.collect()}
    words = prose(100, 77, 4_000).split()
    texts[900], words[30], words[70] = " ".join(words), "changed", "words"
    texts[901] = " ".join(words)
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:  # the smallest id goes along the links
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates_out(spark, docs, "").collect()}
    assert left == {i for i in sets if group[i] == i} and 900 in left and 901 not in left

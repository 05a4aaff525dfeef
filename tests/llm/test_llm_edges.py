"""Every operator over nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, fixity, mixing, pairwise, rollups, rules, secrets, setjoin, suffixes, toxicity

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_toxicity(spark, awkward, nothing, labels):
    model = toxicity.learn_toxicity(awkward, labels)
    out = toxicity.score_toxicity(awkward, model)
    assert out.columns == [c for c in awkward.columns if c != "score"] + ["score", "predicted"]
    rows = out.collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if not (r["text"] or "").strip()}
    assert len(blank) == 1  # the score of a text without hits
    assert toxicity.score_toxicity(nothing, model).count() == 0
    unlearnt = toxicity.learn_toxicity(nothing, labels)
    assert by_id(toxicity.score_toxicity(awkward, unlearnt))[1]["predicted"] == 0


def test_rules(spark, awkward, nothing):
    out = by_id(rules.cascade(rules.with_base(awkward), passed=~F.col("base_failed")))
    assert (out[0]["n_words"], out[0]["base_failed"], out[0]["kept"]) == (0, True, False)
    assert out[4]["n_words"] == 30_000 and out[6]["kept"] and out[8]["n_words"] == 1
    assert rules.cascade(rules.with_base(nothing)).count() == 0
    alone = by_id(rules.cascade(awkward))
    assert alone[1]["failed_rule"] is not None and alone[6]["failed_rule"] is None


def test_setjoin(spark, awkward, nothing):
    rows = setjoin.jaccard_components(awkward).collect()
    assert len(rows) == awkward.count()
    got = {(r["doc_id"], r["n_shingles"] > 1): r["component_id"] for r in rows}
    assert got[0, False] == 0 and got[1, False] == 1 and got[4, True] == got[5, True] == 4
    assert got[6, True] == got[7, True] == got[None, True] == 6  # a null id takes part
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (3, 8)} == {1}
    assert setjoin.jaccard_components(nothing).count() == 0 and setjoin.keep_one(nothing).columns == nothing.columns
    left = sorted((r["doc_id"] for r in setjoin.keep_one(awkward).where("doc_id IS NOT NULL").collect()))
    assert left == [0, 1, 2, 3, 4, 6, 8, 9]


def test_pairwise(spark, awkward, nothing, labels):
    model = pairwise.learn_quality(awkward, labels)
    rows = pairwise.score_quality(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert pairwise.score_quality(nothing, model).count() == 0
    level = pairwise.learn_quality(nothing, labels)
    assert {round(r["score"], 9) for r in pairwise.score_quality(awkward, level).collect()} == {0.7}


@pytest.mark.parametrize("most", [decontaminate.MAX_WINDOWS, 0])
def test_decontaminate(spark, awkward, nothing, prose, most):
    passage = " ".join(prose(80, 2).split()[20:45])
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "One!"), (4, "one"), (None, passage.upper())], "item_id long, text string")
    out = decontaminate.benchmark_hits(awkward, items, max_windows=most)
    rows = {(r["doc_id"], r["n_words"]): r for r in out.collect()}
    assert rows[0, 0]["items_sha256"] == EMPTY_SHA and not rows[0, 0]["contaminated"]
    assert (rows[3, 1]["n_hit"], rows[3, 1]["n_items"]) == (1, 1) and rows[6, 80]["n_hit"] == 25
    assert rows[6, 80]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and rows[8, 1]["n_hit"] == 0
    left = decontaminate.remove_contaminated(awkward, items, max_windows=most)
    assert left.columns == awkward.columns
    assert sorted(r["doc_id"] for r in left.where("doc_id IS NOT NULL").collect()) == [0, 1, 2, 4, 5, 8, 9]
    none = spark.createDataFrame([], items.schema)
    assert decontaminate.benchmark_hits(nothing, items, max_windows=most).count() == 0
    assert decontaminate.benchmark_hits(awkward, none, max_windows=most).where("contaminated").count() == 0


def test_suffixes(spark, awkward, nothing):
    rows = suffixes.repeated_passages(awkward).collect()
    got = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert got[0, 0]["n_repeated"] == 0 and got[4, 30_000]["n_repeated"] == 30_000
    assert (got[4, 30_000]["n_later"], got[5, 30_000]["n_later"]) == (0, 30_000)
    # The null id comes before all others, so its copy is the one that stays.
    assert got[None, 80]["n_later"] == 0 and got[6, 80]["n_later"] == 80
    assert suffixes.repeated_passages(nothing).count() == 0
    cut = suffixes.remove_later(awkward)
    assert cut.columns == awkward.columns and cut.count() == awkward.count()


def test_secrets(spark, awkward, nothing):
    out = by_id(secrets.secret_spans(awkward))
    assert out[0]["spans"] == "" and out[0]["base_sha256"] == EMPTY_SHA
    assert out[9]["spans"] == "assign:51:75" and out[9]["n_assign"] == 1
    clean = secrets.redact(awkward)
    assert clean.columns == awkward.columns and by_id(clean)[9]["text"] == "é" * 50 + ' [SECRET]"'
    assert by_id(clean)[0]["text"] is None and by_id(clean)[4]["text"] == by_id(awkward)[4]["text"] and by_id(clean)[9]["spans"] == "c"
    assert secrets.secret_spans(nothing).count() == 0


def test_fixity(spark, awkward, nothing):
    def audited(docs):
        records = docs.select("doc_id", fixity.record_bytes(F.col("source"), F.col("text")).alias("payload"), F.lit("x").alias("place"))
        placed = fixity.manifest(records, "doc_id", "payload")
        stored = records.join(placed.select("doc_id", "archive", "record").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "doc_id")
        return fixity.audit(placed, stored)

    found = audited(awkward).collect()
    # The rows without an id have no stored copy; the repeated row has one of two.
    assert sorted(r["status"] for r in found) == ["intact"] * 10 + ["lost"] * 3
    assert audited(nothing).count() == 0


def test_rollups(spark, awkward, nothing, tmp_path):
    path = str(tmp_path / "rollup")
    rollups.commit(rollups.signed_totals(rollups.inserts(awkward)), path, 0)
    rows = {(r["source"], r["lang"]): r for r in rollups.totals(spark, path).where("tokenizer = 'words-1'").collect()}
    assert rows[None, "en"]["documents"] == 3 and rows[None, None]["documents"] == 2 and rows["s0", "en"]["tokens"] == 3
    rollups.commit(rollups.signed_totals(rollups.inserts(nothing)), path, 1)
    assert rollups.totals(spark, path).count() == 12


def test_mixing(spark, awkward, nothing):
    out = mixing.mix_sources(awkward)
    assert set(out.columns) == set(awkward.columns) | {"source_size", "target", "copies", "taken"}
    rows = out.collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and {r["taken"] for r in rows if not (r["text"] or "").strip()} == {0}
    assert mixing.mix_sources(nothing).count() == 0


def test_stages(spark, awkward, nothing, labels, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars", "score"]
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing.select(names), str(tmp_path)).columns == names
        out = stage(spark, awkward.select(names), str(tmp_path))
        assert out.columns == names and out.where("doc_id = 0").count() == 1
    assert corpus_pipeline.mixed(spark, nothing, "").count() == 0

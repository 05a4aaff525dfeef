import math
import random

import pytest

from conftest import rows
from pyspark.sql import functions as F
from tessera.operators import admin, charts, findings, metrics, models, profile, splits


def test_admin_summary(spark):
    columns = (
        "cell_id string, city string, country_iso string, admin2_name string, admin2_id string, admin2_iso string,"
        " score double, population double, local_moran_cluster string, dominant_dimension string, priority_quadrant string"
    )
    units = {"Alpha": (90.0, "high_high", "services"), "Beta": (10.0, "low_low", "access"),
             "Gamma": (30.0, "not_significant", "access"), "Delta": (20.0, None, None)}
    data = []
    for name, (score, cluster, dimension) in units.items():
        for i, people in enumerate((100.0, 80.0)):
            data.append((f"{name}{i}", "A", "KEN", name, name[0], None, score + i, people, cluster, dimension, "joint"))
    df = spark.createDataFrame(data, columns)
    out = admin.summarize_units(
        df, "city", "country_iso", "admin2_name", "admin2_id", "score", "population", "admin2_iso",
        "local_moran_cluster", "high_high", "dominant_dimension", "priority_quadrant", 0.25, 0.25, 2, 0.0,
    )
    by = {r["admin2_name"]: r for r in rows(out)}
    alpha = by["Alpha"]
    assert alpha["population_total"] == 180.0 and alpha["hotspot_population_share"] == 1.0
    assert alpha["hotspot_dominant_dimension"] == "services" and alpha["district_priority_class"] == "high_priority"
    assert alpha["district_priority_rank"] == 1 and by["Beta"]["district_priority_class"] == "lower_priority"
    assert by["Beta"]["hotspot_dominant_dimension"] == "missing"
    assert sorted(r["district_priority_rank"] for r in by.values()) == [1, 2, 3, 4]
    small = admin.summarize_units(df, "city", "country_iso", "admin2_name", "admin2_id", "score", "population")
    assert {(r["district_priority_class"], r["district_priority_rank"]) for r in rows(small)} == {("small_footprint", None)}


def test_metrics_against_direct_formulas(spark):
    data = [("p", "m", float(y), s, int(y > 2), q) for y, s, q in [
        (1, 1.5, 0.1), (2, 1.0, 0.8), (3, 2.0, 0.8), (4, 5.0, 0.9), (5, 4.0, 0.4)]]
    df = spark.createDataFrame(data, "protocol string, model string, rwi_true double, rwi_pred double, low_wealth_true int, low_wealth_prob double")
    reg = rows(metrics.regression_metrics(df))[0]
    errors = [r[2] - r[3] for r in data]
    assert math.isclose(reg["mae"], sum(map(abs, errors)) / 5) and math.isclose(reg["rmse"], math.sqrt(sum(e * e for e in errors) / 5))
    assert math.isclose(reg["r2"], 1 - sum(e * e for e in errors) / 10) and math.isclose(reg["spearman_corr"], 0.8)
    cls = rows(metrics.classification_metrics(df))[0]
    pairs = [(a[5], b[5]) for a in data if a[4] for b in data if not b[4]]
    assert math.isclose(cls["roc_auc"], sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    # Precision at each score that holds a positive: 1/1, 2/3, 3/4.
    assert math.isclose(cls["average_precision"], (1 + 2 / 3 + 3 / 4) / 3)
    assert math.isclose(cls["f1"], 2 * 2 / (3 + 3)) and math.isclose(cls["balanced_accuracy"], (2 / 3 + 1 / 2) / 2)
    one = rows(metrics.classification_metrics(df.where("low_wealth_true = 1")))[0]
    assert one["roc_auc"] is None and one["f1"] is None
    assert metrics.all_metrics(df).count() == 9


def labelled(spark, cities, n=40):
    data = [(f"{c}{i}", c, int(i % 4 == 0), True) for c in cities for i in range(n)]
    return spark.createDataFrame(data + [("x", "Zed", 0, False)], "cell_id string, city string, cls int, label_mask boolean")


def test_protocols(spark):
    three = rows(splits.protocol_splits(labelled(spark, ["Accra", "Dar es Salaam", "Kigali"]), cls="cls"))
    assert {r["protocol"] for r in three} == {"pooled_random", "holdout_accra", "holdout_dar_es_salaam", "holdout_kigali"}
    assert sum(r["protocol"] == "pooled_random" and r["role"] == "test" for r in three) == 24
    assert all(r["cell_id"] != "x" for r in three)
    held = [r for r in three if r["protocol"] == "holdout_accra"]
    assert all((r["role"] == "test") == r["cell_id"].startswith("Accra") for r in held) and len(held) == 120
    two = {r["protocol"] for r in rows(splits.protocol_splits(labelled(spark, ["A", "B"]), cls="cls"))}
    assert two == {"pooled_random", "a_to_b", "b_to_a"}
    one_pair = rows(splits.protocol_splits(labelled(spark, ["A", "B", "C"]), cls="cls", strategy="pairwise"))
    assert {r["protocol"] for r in one_pair} == {"pooled_random", "a_to_b"}
    with pytest.raises(ValueError):
        splits.protocol_splits(labelled(spark, ["A"]), cls="cls")
    with pytest.raises(ValueError):
        splits.protocol_splits(labelled(spark, ["A", "B"]), cls="cls", strategy="odd")


def test_splits_are_seeded_and_exact(spark):
    df = labelled(spark, ["A", "B"])
    pick = lambda d, seed: {r["cell_id"] for r in splits.seeded_share(d, ["city"], 0.2, "cell_id", seed, "t").where("t").collect()}
    assert pick(df, 1) == pick(df.repartition(7), 1) != pick(df, 2)
    train, held = splits.train_validation_split(df.where("label_mask"), "cls")
    assert (train.count(), held.count()) == (68, 12)
    tiny = df.limit(4)
    a, b = splits.train_validation_split(tiny, "cls")
    assert a.count() == b.count() == 4


def counted(spark, df):
    """The rows, and a count of how many of them were computed so far."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), made


def test_splits_compute_their_input_once(spark):
    for strategy in ("auto", "all_pairs"):
        df, made = counted(spark, labelled(spark, ["A", "B", "C"]))
        assert splits.protocol_splits(df, cls="cls", strategy=strategy).count() == 120 + (360 if strategy == "auto" else 480)
        assert made.value == 121
    df, made = counted(spark, labelled(spark, ["A", "B"]))
    train, held = splits.train_validation_split(df, "cls")
    assert train.count() + held.count() == made.value == 81


def test_kmeans_separates_groups(spark):
    data = [(i, float(i % 3) * 100 + i / 100, None if i == 0 else 1.0) for i in range(60)]
    df = spark.createDataFrame(data, "cell_id int, a double, b double")
    out, report = models.kmeans_groups(df, ["a", "b"], 3, restarts=3)
    groups = {r["cell_id"]: r["cluster_id"] for r in out.collect()}
    assert all(groups[i] == i % 3 for i in range(60))
    assert [r["cluster_size"] for r in rows(report, "cluster_id")] == [20, 20, 20]
    once, made = counted(spark, df)
    assert models.kmeans_groups(once, ["a", "b"], 3, restarts=3)[0].count() == made.value == 60
    with pytest.raises(ValueError):
        models.kmeans_groups(df, ["a"], 1)


def test_benchmark_runs_all_protocols(spark):
    data = [(i, f"C{i % 3}", float(i % 17), float(i % 17) * 2 + i % 2, int(i % 17 > 8), True) for i in range(120)]
    df = spark.createDataFrame(
        data, "cell_id int, city string, deprivation_index_0_100 double, rwi_mean double, rwi_bottom_quantile_flag int, rwi_label_available boolean"
    )
    scored, predictions = models.run_benchmark(df, ["deprivation_index_0_100"], trees=2, depth=2)
    out = {(r["protocol"], r["model"], r["metric"]): r["value"] for r in scored.collect()}
    assert len(out) == 4 * 2 * 9
    assert out["pooled_random", "linear_baseline", "r2"] > 0.9 and out["holdout_c0", "linear_baseline", "roc_auc"] == 1.0
    assert predictions.where("protocol = 'holdout_c1'").select("city").distinct().collect()[0][0] == "C1"


def test_logistic_curves_of_all_groups_at_once(spark):
    """At the optimum the gradient of the penalised loss is zero. Groups: noisy,
    far from the origin, separable, of one class, with a constant variable."""
    rng = random.Random(5)
    data = [("noisy", rng.gauss(0, 1), None) for _ in range(200)] + [("far", 1e5 + rng.gauss(0, 30), None) for _ in range(200)]
    data = [(g, x, int(rng.random() < 1 / (1 + math.exp(-(x if g == "noisy" else (x - 1e5) / 10))))) for g, x, _ in data]
    data += [("split", float(i), int(i > 50)) for i in range(100)] + [("one", float(i), 1) for i in range(5)] + [("flat", 3.0, i % 4 == 0) for i in range(40)]
    data += [("noisy", None, 1), ("noisy", 1.0, None)]
    df = spark.createDataFrame([(g, x, None if y is None else int(y)) for g, x, y in data], "g string, x double, y int")
    got = {r["g"]: (r["intercept"], r["slope"]) for r in models.logistic_curves(df, "x", "y", "g").collect()}
    assert got["one"] == (math.inf, 0.0) and set(got) == {"noisy", "far", "split", "one", "flat"}
    for g in ("noisy", "far", "split", "flat"):
        a, b = got[g]
        part = [(x, y, 1 / (1 + math.exp(-(a + b * x)))) for h, x, y in data if h == g and x is not None and y is not None]
        mean = sum(x for x, _, _ in part) / len(part)
        assert abs(sum(p - y for _, y, p in part)) < 1e-6 and abs(sum((p - y) * (x - mean) for x, y, p in part) + b) < 1e-4, g
    assert math.isclose(got["flat"][0] + 3 * got["flat"][1], math.log(1 / 3), rel_tol=1e-9)
    assert not models.logistic_curves(df.limit(0), "x", "y", "g").collect()


METRICS = [
    ("pooled_random", "tree", "rmse", 0.2), ("pooled_random", "graph", "rmse", 0.3),
    ("holdout_accra", "tree", "rmse", 0.9), ("holdout_accra", "graph", "rmse", 0.7),
    ("holdout_kigali", "tree", "rmse", 0.6), ("holdout_kigali", "graph", "rmse", 0.5),
    ("holdout_kigali", "tree", "average_precision", 0.4), ("holdout_kigali", "graph", "average_precision", 0.5),
    ("holdout_kigali", "graph", "mae", None), ("holdout_kigali", "tree", "f1", 0.5),
]


def test_benchmark_findings(spark):
    df = spark.createDataFrame(METRICS, "protocol string, model string, metric string, value double")
    ranks = {(r["scope"], r["metric"], r["model"]): r["mean_rank"] for r in findings.average_ranks(df).collect()}
    assert ranks["transfer_only", "rmse", "graph"] == 1.0 and ranks["pooled_only", "rmse", "tree"] == 1.0
    assert math.isclose(ranks["all_protocols", "rmse", "graph"], 4 / 3)
    found = rows(findings.benchmark_findings(df, "tree"))[0]
    assert found["hardest_holdouts"]["rmse"]["protocol"] == "holdout_accra"
    assert found["per_holdout_recommendations"]["holdout_kigali"]["screening_recommendation"]["winner_model"] == "graph"
    assert found["baseline_retained_value"]["n_metric_wins"] == 1 and found["n_models"] == 2
    assert found["pooled_random"]["rmse"]["winner_model"] == "tree"
    assert found["transfer_only_average_ranks"]["rmse"][0]["model"] == "graph"
    summary = rows(findings.benchmark_summary(df))[0]
    assert len(summary["leaders"]) == 4 and summary["by_protocol"]["holdout_accra"]["rmse"]["value"] == 0.7


def finding_inputs(spark, admin_rows=True):
    cities = [("A", 1.0), ("B", 2.0)]

    def scores(columns, scenarios=("base",)):
        data = [(s, c, *[v] * len(columns))
                for s in scenarios for c, v in cities]
        return spark.createDataFrame(data, "scenario string, city string, " + ", ".join(f"{c} double" for c in columns))

    def shares(category):
        data = [("base", c, k, w) for c, _ in cities for k, w in (("x", 0.5), ("y", 0.3), ("z", 0.2))]
        return spark.createDataFrame(data, f"scenario string, city string, {category} string, weight_share double")

    both = ("base", "fine")
    exposure = ["population_weighted_mean_score", "population_share_at_or_above_q90"]
    out = {
        "city_score_summary": scores(["mean"], both), "population_exposure": scores(exposure, both),
        "inequality_summary": scores(["score_gini_population_weighted"], both),
        "absolute_relative_alignment": scores(["pearson_corr", "top_overlap_share"]),
        "relative_shift_summary": scores(["mean_abs_percentile_shift", "p90_abs_percentile_shift"]),
        "hotspot_dominant_population_share": shares("dominant_dimension"),
        "hotspot_priority_population_share": shares("priority_quadrant"),
        "hotspot_typology_population_share": shares("hotspot_typology"),
        "grid_size_score_summary": scores(["mean"], both), "grid_size_population_exposure": scores(exposure, both),
        "grid_size_inequality_summary": scores(["score_gini_population_weighted"], both),
    }
    if admin_rows:
        data = [("A", "u1", 1, "high_priority", 3, 100.0, 0.5), ("A", "u2", 2, "lower_priority", 0, 300.0, 0.5),
                ("B", "u3", None, "small_footprint", 0, 10.0, 0.5)]
        frame = spark.createDataFrame(
            data, "city string, admin2_name string, district_priority_rank int, district_priority_class string,"
            " district_priority_metric_count int, population_total double, population_weighted_mean_score double")
        out["admin_summary"] = frame.withColumns({
            "citywide_q90_population_share": F.lit(0.1), "hotspot_population_share": F.lit(0.2),
            "hotspot_dominant_dimension": F.lit("x")})
    return out


def test_core_findings(spark):
    found = rows(findings.core_findings(finding_inputs(spark), "base", "fine"))[0]
    ranking = found["cross_city"]["mean_score"]
    assert [r["city"] for r in ranking["ranking"]] == ["B", "A"] and ranking["top_minus_bottom_gap"] == 1.0
    a = found["cities"]["A"]
    assert [c["category"] for c in a["hotspots"]["dominant_dimension_by_population"]] == ["x", "y"]
    assert len(a["hotspots"]["top_typologies_by_population"]) == 3
    assert a["districts"]["top_priority_units"][0]["admin_unit"] == "u1"
    assert a["districts"]["priority_class_population_share"] == {"high_priority": 0.25, "lower_priority": 0.75}
    assert a["sensitivity"]["mean_score"]["delta_fine_minus_base"] == 0.0
    assert found["sensitivity"]["order_stability"] == {
        "mean_score": True, "population_share_at_or_above_q90": True, "score_gini_population_weighted": True}
    ids = {c["claim_id"] for c in found["claims"]}
    assert {"primary_mean_score_order", "grid_size_order_stability", "top_priority_admin_unit__a",
            "high_priority_district_population_share__a", "absolute_relative_reranking__b"} <= ids


def test_core_findings_without_units_or_scenarios(spark):
    inputs = finding_inputs(spark, admin_rows=False)
    found = rows(findings.core_findings(inputs, "base"))[0]
    assert "districts" not in found["cities"]["A"] and "sensitivity" not in found
    assert not any(c["claim_id"].startswith("top_priority") for c in found["claims"])


def test_charts(spark):
    df = spark.createDataFrame([(i, "A", float(v)) for i, v in enumerate([0, 1, 2, 3, 100])], "cell_id int, city string, v double")
    bins = rows(charts.histogram(df, "v"), "bin")
    assert sum(b["count"] for b in bins) == 5 and len(bins) == 12
    assert max(bins, key=lambda b: b["bin"])["count"] == 1
    box = rows(charts.box_stats(df, "v", "city"))[0]
    assert (box["q1"], box["median"], box["q3"], box["whisker_high"], box["n_outliers"]) == (1.0, 2.0, 3.0, 3.0, 1)
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert rows(charts.color_range(flat, "v"))[0] == {"vmin": 1.0, "vmax": 1.0}
    assert sum(b["count"] for b in rows(charts.histogram(flat, "v"))) == 2
    legend = rows(charts.hotspot_legend(spark.createDataFrame([("high_high",), (None,)], "h string"), "h"), "position")
    assert {r["category"]: r["count"] for r in legend} == {
        "high_high": 1, "low_low": 0, "high_low": 0, "low_high": 0, "not_significant": 0, "unknown": 0, "missing": 1}
    tables = charts.quicklook(df, "v", id="cell_id", by="city", lon="absent", lat="v")
    assert set(tables) == {"histogram", "box_stats", "lowest_highest"}


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, [2]), (2, "b", None)], "i int, s string, l array<int>")
    out = {r["name"]: r for r in rows(profile.profile(df))}
    assert (out["s"]["non_null"], out["s"]["nulls"], out["s"]["n_unique"]) == (2, 1, 2)
    assert out["i"]["n_unique"] == 2 and sorted(out["i"]["examples"]) == ["1", "2", "2"] and out["l"]["rows"] == 3


def test_examples_without_copies(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a"), (1, "a"), (None, "a"), (10, None)], "i int, s string")
    assert [r["examples"] for r in rows(profile.examples(df, distinct=True), "position")] == [["1", "10", "2"], ["a", "b"]]


def test_profile_examples_query_counts_a_value_once(spark):
    from tessera.plans import ORACLE, QUERIES

    out = {r["position"]: r["examples"] for r in QUERIES["profile_examples"](spark, "/root/testdata/sf0.001").collect()}
    assert out[1] == "F,O,P" and ORACLE["profile_examples"].count("DISTINCT") == 2

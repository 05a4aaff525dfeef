import math

import numpy as np
import pandas as pd
import pytest

from conftest import rows
from tessera.functions import columns as C
from tessera.operators import compare, contrast, report, validate


def test_filter_and_summary(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"town": rng.choice(["p", "q"], 25), "state": rng.choice(["wet", "dry"], 25), "level": rng.normal(size=25)})
    df = spark.createDataFrame(frame).unionByName(spark.createDataFrame([(None, "wet", 9.0)], "town string, state string, level double"))
    assert C.filter_eq(df, "state", "dry").count() == (frame["state"] == "dry").sum()
    scores, features = report.summarize_index(df, "town", "level", ["level"], "base", ("state", "wet"))
    wet = frame[frame["state"] == "wet"].groupby("town")["level"]
    out = rows(scores, "town")
    assert [(r["scenario"], r["town"], r["count"]) for r in out] == [("base", t, n) for t, n in wet.size().items()]
    assert [r["mean"] for r in out] == pytest.approx(wet.mean().tolist())
    assert [r["level"] for r in rows(features, "town")] == pytest.approx(wet.median().tolist())
    with pytest.raises(ValueError):
        report.feature_medians(df, "town", ["absent"])


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame(
        [("A", "x", 1.0), ("A", "y", -5.0), ("A", None, 2.0), ("B", "x", 0.0)], "city string, kind string, w double"
    )
    shares = rows(report.category_shares(df, "city", "kind"), "city", "kind")
    assert [(r["kind"], r["share"]) for r in shares] == [("x", 0.5), ("y", 0.5), ("x", 1.0)]
    weighted = rows(report.weighted_category_shares(df, "city", "kind", "w"), "city", "kind")
    # A negative weight counts as zero, and a group without weight has no share.
    assert [(r["weight_sum"], r["weight_share"]) for r in weighted] == [(1.0, 1.0), (0.0, 0.0), (0.0, None)]


def test_exposure_counts_unscored_population(spark):
    df = spark.createDataFrame(
        [("A", 10.0, 1.0), ("A", 20.0, 1.0), ("A", None, 2.0), ("B", 1.0, 0.0)], "city string, s double, p double"
    )
    out = rows(report.exposure(df, "city", "s", "p", [0.5]), "city")
    assert out[0]["population_weighted_mean_score"] == 7.5
    assert out[0]["score_q50"] == 15.0 and out[0]["population_share_at_or_above_q50"] == 0.25
    assert out[1]["population_weighted_mean_score"] is None


def _gini(v, w):
    i = np.argsort(v)
    v, w = np.asarray(v)[i], np.asarray(w)[i]
    x = np.insert(np.cumsum(w) / w.sum(), 0, 0)
    y = np.insert(np.cumsum(v * w) / (v * w).sum(), 0, 0)
    return 1 - 2 * np.trapezoid(y, x)


def test_inequality_matches_trapezoid(spark):
    rng = np.random.default_rng(1)
    v, w = rng.integers(0, 40, 200).astype(float), rng.integers(0, 9, 200).astype(float)
    df = spark.createDataFrame([("A", float(a), float(b)) for a, b in zip(v, w)], "city string, s double, p double")
    out = rows(report.inequality(df, "city", "s", "p"))[0]
    assert math.isclose(out["score_gini_unweighted"], _gini(v, np.ones_like(v)), rel_tol=1e-9)
    assert math.isclose(out["score_gini_population_weighted"], _gini(v, w), rel_tol=1e-9)
    assert 0 <= out["score_gini_population_weighted"] <= 1
    assert out["score_p90"] == np.quantile(v, 0.9)
    order = np.argsort(v, kind="stable")
    cum = np.cumsum(w[order])
    assert out["score_wp50"] == v[order][np.searchsorted(cum, 0.5 * cum[-1])]


def test_inequality_without_weight_is_null(spark):
    df = spark.createDataFrame([("A", 1.0, 0.0), ("A", 2.0, 0.0)], "city string, s double, p double")
    out = rows(report.inequality(df, "city", "s", "p"))[0]
    assert out["score_gini_population_weighted"] is None and out["score_wp50"] is None
    assert out["score_gini_unweighted"] is not None


def test_compare_scores_equals_ranks_in_pandas(spark):
    rng = np.random.default_rng(12)
    n = 41
    base = pd.DataFrame({"plot": range(n), "valley": rng.choice(["u", "v"], n, p=[0.7, 0.3]), "level": rng.permutation(n) * 1.5})
    other = base.assign(level=base["level"] * 0.4 + rng.normal(0, 12, n)).iloc[:-4]  # four rows have no partner
    left, right = (spark.createDataFrame(x.rename(columns={"plot": "cell_id"})) for x in (base, other))
    summary, merged = compare.compare_scores(left, right, ["cell_id", "valley"], "valley", "level", "level", "old", "new", 0.25)
    got = merged.toPandas().sort_values("cell_id").reset_index(drop=True)
    both = base.merge(other, on=["plot", "valley"], suffixes=("_old", "_new"))
    by = both.groupby("valley")
    old, new = (by[f"level_{s}"].rank(ascending=False) for s in ("old", "new"))
    size = by["plot"].transform("size")
    np.testing.assert_allclose(got["new_minus_old"], both["level_new"] - both["level_old"], atol=1e-9)
    np.testing.assert_allclose(got["new_rank_minus_old_rank"], new - old)
    np.testing.assert_allclose(got["old_percentile"], 1 - (old - 1) / (size - 1))
    top = np.maximum(1, np.floor(0.25 * size))
    was, now = old <= top, new <= top
    named = np.select([was & now, now, was], ["stable_top_fraction", "entered_top_fraction", "exited_top_fraction"], "stable_non_top_fraction")
    assert got["top_fraction_status"].tolist() == named.tolist()
    share = {r["valley"]: r["top_overlap_share"] for r in rows(summary)}
    for valley, part in both.assign(was=was, now=now).groupby("valley"):
        assert share[valley] == pytest.approx((part["was"] & part["now"]).sum() / part["was"].sum())


def test_shift_summary_and_missing_scores(spark):
    df = spark.createDataFrame(
        [("a", "A", 1.0, 4.0), ("b", "A", 2.0, 3.0), ("c", "A", None, 9.0)],
        "cell_id string, city string, l_score double, r_score double",
    )
    merged = compare.comparison_columns(df, "city", "l", "r", 0.5)
    out = rows(merged, "cell_id")
    assert out[2]["l_rank_desc"] is None and out[2]["l_percentile"] is None and out[2]["abs_rank_shift"] is None
    assert out[2]["left_top_fraction_flag"] is False
    shift = rows(compare.comparison_shift(merged, "city", "l", "r", 0.5))[0]
    assert shift["n_rows"] == 2 and shift["mean_abs_rank_shift"] == 1.0
    assert shift["top_fraction_reclassification_share"] == shift["exited_top_fraction_share"] + shift["entered_top_fraction_share"]
    with pytest.raises(ValueError):
        compare.comparison_columns(df, "city", "l", "r", 0.0)


def test_alignment_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(i, "A", 1.0, float(i)) for i in range(4)], "cell_id int, city string, a double, b double")
    out = rows(compare.alignment(df, "city", "a", "b"))[0]
    assert out["pearson_corr"] is None and out["spearman_corr"] is None and out["n_rows"] == 4


def test_contrast_ranks_by_size_of_the_difference(spark):
    rng = np.random.default_rng(9)
    n = 90
    frame = pd.DataFrame({"town": rng.choice(["p", "q", "r"], n), "state": rng.choice(["wet", "dry"], n), "up": rng.normal(size=n), "down": rng.normal(size=n), "flat": rng.normal(size=n)})
    wet = frame["state"] == "wet"
    frame.loc[wet, "up"] += 4.0
    frame.loc[wet, "down"] -= 2.0
    frame.loc[frame["town"] == "r", "state"] = "wet"  # a town with nothing to compare with
    df = spark.createDataFrame(frame)
    out = rows(contrast.binary_contrast(df, "town", "state", "wet", ["up", "down", "flat", "unknown"]), "town", "contrast_rank")
    assert [(r["town"], r["feature"]) for r in out] == [(t, f) for t in "pq" for f in ("up", "down", "flat")]
    assert all(abs(a["standardized_mean_diff"]) >= abs(b["standardized_mean_diff"]) for a, b in zip(out, out[1:], strict=False) if a["town"] == b["town"])
    for r in out:
        part = frame[frame["town"] == r["town"]]
        assert r["reference_n"] == (part["state"] == "dry").sum() and r["target_share"] == pytest.approx((part["state"] == "wet").mean())
        gap = part[part["state"] == "wet"][r["feature"]].mean() - part[part["state"] == "dry"][r["feature"]].mean()
        assert np.sign(r["standardized_mean_diff"]) == np.sign(gap)
    with pytest.raises(ValueError):
        contrast.binary_contrast(df, "town", "state", "frozen", ["up"])


def test_profiles_name_missing_categories_and_rank_within_each(spark):
    frame = pd.DataFrame({"town": ["p"] * 30, "state": ["a", "b", None] * 10, "x": [float(i % 3) for i in range(30)], "y": [float(i % 7) for i in range(30)]})
    profiles = rows(contrast.category_profiles(spark.createDataFrame(frame), "town", "state", ["x", "y"]), "state", "profile_rank")
    assert {r["state"] for r in profiles} == {"a", "b", "missing"}
    # x is 0, 1 and 2 in the three categories and varies in none of them.
    first = {r["state"]: r for r in profiles if r["feature"] == "x"}
    assert first["a"]["standardized_profile_diff"] < 0 < first["missing"]["standardized_profile_diff"]
    assert sorted(r["profile_rank"] for r in profiles) == [1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("direction, sign", [("negative", -1.0), ("positive", 1.0)])
def test_external_validation_signs_the_rank_correlation(spark, direction, sign):
    rng = np.random.default_rng(17)
    n = 50
    frame = pd.DataFrame({"cell_id": range(n), "town": rng.choice(["p", "q"], n), "light": rng.permutation(n) * 1.0})
    frame["good"] = -frame["light"] + rng.normal(0, 3, n)
    frame["noise"] = rng.normal(size=n)
    df = spark.createDataFrame(frame)
    summary = validate.validate_external(df, "town", "light", ["good", "noise"], 0.2, direction)
    for r in rows(summary):
        part = frame[frame["town"] == r["town"]]
        expected = part[r["score_column"]].rank().corr(part["light"].rank())
        assert r["expected_signed_spearman"] == pytest.approx(sign * expected)
    found = rows(validate.validation_findings(summary))[0]
    assert set(found["strongest_by_score"]) == {"good", "noise"} and sorted(found["groups"]) == ["p", "q"]
    with pytest.raises(ValueError):
        validate.validate_external(df, "town", "light", [], 0.1)


def test_masks(spark):
    df = spark.createDataFrame(
        [("A", 1.0, "5"), ("A", None, "x"), ("B", float("nan"), "1"), (None, 3.0, "2")], "city string, a double, b string"
    )
    at_least = [{"column": "a", "op": ">=", "value": 1}]
    assert C.analysis_mask(df, at_least).count() == 2  # missing and NaN fail
    assert C.analysis_mask(df, [{"column": "a", "op": "!=", "value": 1}]).count() == 3  # but differ from 1
    both = at_least + [{"column": "b", "op": "<", "value": 5}]
    assert C.analysis_mask(df, both, "all").count() == 1
    report_rows = {r["city"]: r for r in rows(C.mask_report(df, at_least))}
    assert report_rows[None]["rows_before"] == 4 and report_rows[None]["rows_after"] == 2
    assert report_rows["B"]["rows_removed"] == 1 and report_rows["B"]["share_kept"] == 0.0
    for bad in ([], [{"column": "a", "op": "~", "value": 1}]):
        with pytest.raises(ValueError):
            C.analysis_mask(df, bad)


def test_tag_filters(spark):
    df = spark.createDataFrame(
        [(1, "School", None, 4), (2, "bench", "yes", 2), (3, None, None, None), (4, "cafe", "CENTRE", 3)],
        "id int, amenity string, healthcare string, street_count int",
    )
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(C.service_points(df)) == [1, 3, 4]
    assert ids(C.school_points(df)) == [1]
    assert ids(C.clinic_points(df)) == [2, 4]
    assert ids(C.clinic_points(df.drop("amenity"))) == [2, 4]
    assert ids(C.service_points(df.drop("amenity"))) == []
    assert ids(C.intersection_nodes(df)) == [1, 4]
    assert ids(C.intersection_nodes(df.drop("street_count"))) == [1, 2, 3, 4]


def test_top_n_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(i, "A", 1.0) for i in range(9)], "cell_id int, city string, score double")
    assert sorted(r["cell_id"] for r in report.top_n(df, "city", "score", 3).collect()) == [0, 1, 2]
    assert report.top_n(df, "city", "score", 3).columns == ["cell_id", "city", "score"]


def test_large_top_n_numbers_the_whole_group(spark, hot):
    df = spark.createDataFrame([(i, "A", float(i)) for i in range(1500)], "cell_id int, city string, score double")
    got = sorted(r["cell_id"] for r in report.top_n(df, "city", "score", 1200).collect())
    assert got == list(range(300, 1500))

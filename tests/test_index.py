import itertools

import numpy as np
import pandas as pd
import pytest

from conftest import rows
from tessera.operators.index import build_index
from tessera.operators.interpret import dominant_dimension, hotspot_typology, priority_quadrants
from tessera.operators.transform import winsorize, zscore
from tessera.runtime import MissingColumns

def measured(spark, n=48, seed=20):
    """Three regions of uneven size with two random features."""
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "zone_id": [f"z{i:03d}" for i in range(n)], "region": rng.choice(["north", "mid", "south"], n, p=[0.6, 0.3, 0.1]),
        "slope": rng.normal(4.0, 2.0, n).round(3), "shade": rng.gamma(2.0, 3.0, n).round(3),
    })
    return frame, spark.createDataFrame(frame)


def test_grouped_index_equals_the_same_steps_in_pandas(spark):
    frame, df = measured(spark)
    config = {
        "features": [
            {"name": "slope", "dimension": "terrain", "feature_weight": 3.0},
            {"name": "shade", "dimension": "cover", "higher_is_more_deprived": False},
        ],
        "dimension_weights": {"terrain": 1.0, "cover": 2.0},
        "winsorize_quantiles": [0.1, 0.9], "winsorize_group_col": "region", "feature_standardization_group_col": "region",
        "output_scaling": {"lower_quantile": 0.0, "upper_quantile": 1.0, "group_col": "region"},
    }
    result = build_index(df, config)
    got = result.table.toPandas().sort_values("zone_id").reset_index(drop=True)
    grouped = frame.groupby("region")
    standard = {}
    for name, sign in (("slope", 1.0), ("shade", -1.0)):
        cut = sign * frame[name].clip(grouped[name].transform(lambda v: v.quantile(0.1)), grouped[name].transform(lambda v: v.quantile(0.9)))
        by = cut.groupby(frame["region"])
        standard[name] = (cut - by.transform("mean")) / by.transform(lambda v: v.std(ddof=0))
        np.testing.assert_allclose(got[f"{name}__z"], standard[name], atol=1e-9)
    z = (standard["slope"] + 2.0 * standard["shade"]) / 3.0
    low, high = (z.groupby(frame["region"]).transform(f) for f in ("min", "max"))
    np.testing.assert_allclose(got["deprivation_index_0_100"], 100.0 * (z - low) / (high - low), atol=1e-7)
    assert got["deprivation_rank_desc"].tolist() == z.round(12).rank(method="dense", ascending=False).astype(int).tolist()
    used = {r["name"]: r["median_used"] for r in rows(result.features)}
    assert used == pytest.approx({"slope": frame["slope"].median(), "shade": frame["shade"].median()})


def test_index_without_debug_columns_and_missing_values(spark):
    df = spark.createDataFrame(
        [("a", "1", None), ("b", "x", None), ("c", "3", None)], "cell_id string, f string, g double"
    )
    config = {
        "features": [{"name": "f", "dimension": "d"}, {"name": "g", "dimension": "e", "higher_is_more_deprived": False}],
        "keep_debug_columns": False,
    }
    out = rows(build_index(df, config).table, "cell_id")
    assert not any(c.endswith(("__z", "__aligned")) for c in out[0])
    # The unreadable text takes the median 2, so it lies between its neighbours.
    assert [r["deprivation_index_0_100"] for r in out] == [0.0, 50.0, 100.0]
    assert {r["e__score"] for r in out} == {0.0}


def test_constant_index_scores_fifty(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "cell_id string, f double")
    out = rows(build_index(df, {"features": [{"name": "f", "dimension": "d"}]}).table)
    assert {r["deprivation_index_0_100"] for r in out} == {50.0}


def test_index_checks_columns_and_weights(spark):
    with pytest.raises(MissingColumns):
        build_index(measured(spark)[1], {"features": [{"name": "absent", "dimension": "d"}]})
    with pytest.raises(ValueError):
        build_index(measured(spark)[1], {"features": [{"name": "slope", "dimension": "d", "feature_weight": 0.0}]})


def test_pca_agrees_with_composite(spark):
    df = spark.createDataFrame(
        [(i, float(i), float(i * i), float(7 * i % 5)) for i in range(30)], "cell_id int, a double, b double, c double"
    )
    config = {
        "features": [{"name": n, "dimension": n} for n in "abc"],
        "pca": {"enabled": True, "n_components": 1},
    }
    result = build_index(df, config)
    out = result.table.toPandas()
    assert out["pca1_index_z"].corr(out["deprivation_index_z"]) > 0
    assert out["pca1_index_0_100"].min() == 0 and out["pca1_index_0_100"].max() == 100
    size = sum(r["pca_loading"] ** 2 for r in rows(result.features))
    assert abs(size - 1) < 1e-9


def test_z_scores_have_mean_zero_per_group_and_skip_null_groups(spark):
    df = spark.createDataFrame(
        [("A", 1.0), ("A", 2.0), ("A", 6.0), ("B", 3.0), (None, 9.0)], "city string, v double"
    )
    out = zscore(df, ["v"], "city").toPandas()
    assert abs(out[out.city == "A"]["v__z"].mean()) < 1e-12
    assert out[out.city == "B"]["v__z"].tolist() == [0.0]
    assert out[out.city.isna()]["v__z"].isna().all()
    assert rows(winsorize(df, ["v"], [0.0, 0.5], "city"), "city", "v")[-1]["v"] is None


def test_dominant_dimension_by_sorting_each_row(spark):
    """All combinations of a few values, missing and infinite ones too, against a sort of the row."""
    levels = [None, -0.7, 0.0, 0.35, 0.9, float("inf")]
    table = [(i, *v) for i, v in enumerate(itertools.product(levels, repeat=3))]
    names = ["water", "power", "waste"]
    df = spark.createDataFrame(table, "i int, water__score double, power__score double, waste__score double")
    out = {r["i"]: r for r in rows(dominant_dimension(df, [f"{n}__score" for n in names], (0.3, 1.0)))}
    for i, *values in table:
        known = sorted(((v, -k) for k, v in enumerate(values) if v is not None and np.isfinite(v)), reverse=True)
        got = out[i]
        if not known:
            assert (got["dominant_dimension"], got["dominant_dimension_strength"]) == ("missing", "missing")
            continue
        assert got["dominant_dimension"] == names[-known[0][1]]
        if len(known) == 1:
            assert got["dominant_dimension_margin"] is None and got["dominant_dimension_strength"] == "missing"
        else:
            margin = known[0][0] - known[1][0]
            assert got["dominant_dimension_margin"] == pytest.approx(margin)
            assert got["dominant_dimension_strength"] == ("mixed" if margin < 0.3 else "moderate" if margin < 1.0 else "strong")


def test_a_single_dimension_is_its_own_margin(spark):
    df = spark.createDataFrame([(2.5,), (None,)], "water__score double")
    assert sorted((r["dominant_dimension_margin"] is None, r["dominant_dimension_margin"]) for r in rows(dominant_dimension(df, ["water__score"]))) == [(False, 2.5), (True, None)]
    for bad in ((0.9, 0.2), (-0.1, 0.5), (0.5,)):
        with pytest.raises(ValueError):
            dominant_dimension(df, ["water__score"], bad)


@pytest.mark.parametrize("absolute_top, relative_top", [(0.2, 0.5), (0.75, 0.1)])
def test_quadrants_follow_the_two_thresholds(spark, absolute_top, relative_top):
    frame, df = measured(spark, n=60, seed=31)
    out = priority_quadrants(df, "slope", "shade", "region", absolute_top, relative_top).toPandas()
    merged = frame.merge(out[["zone_id", "priority_quadrant"]], on="zone_id")
    first = merged["slope"] >= merged["slope"].quantile(1 - absolute_top)
    second = merged["shade"] >= merged.groupby("region")["shade"].transform(lambda v: v.quantile(1 - relative_top))
    named = {(True, True): "joint_priority", (True, False): "absolute_only", (False, True): "relative_only", (False, False): "lower_priority"}
    assert merged["priority_quadrant"].tolist() == [named[bool(a), bool(b)] for a, b in zip(first, second, strict=True)]
    assert merged["priority_quadrant"].nunique() >= 3


def test_typology_joins_both_labels(spark):
    parts = [("relative_only", "cover"), ("lower_priority", None), (None, None)]
    named = spark.createDataFrame(parts, "priority_quadrant string, dominant_dimension string")
    assert {r["hotspot_typology"] for r in rows(hotspot_typology(named))} == {f"{a or 'missing'}__{b or 'missing'}" for a, b in parts}

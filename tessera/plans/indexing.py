"""Queries of the composite index, its explanations and administrative units."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import admin, compare, index, interpret, report
from tessera.plans import roles
from tessera.plans.registry import query

CONFIG = {
    "features": [
        {"name": "discount", "dimension": "access", "higher_is_more_deprived": True},
        {"name": "tax", "dimension": "access", "higher_is_more_deprived": False, "feature_weight": 2.0},
        {"name": "price", "dimension": "services"},
        {"name": "returned", "dimension": "services", "feature_weight": 0.5},
        {"name": "quantity", "dimension": "form", "higher_is_more_deprived": False},
    ],
    "dimension_weights": {"access": 2.0, "services": 1.0, "form": 1.5},
    "winsorize_quantiles": [0.02, 0.98],
    "winsorize_group_col": "city",
    "feature_standardization_group_col": "city",
    "feature_zscore_clip": 2.5,
    "output_scaling": {"lower_quantile": 0.01, "upper_quantile": 0.99, "group_col": None},
}
NAMES = [f["name"] for f in CONFIG["features"]]


def _imputed() -> str:
    return ", ".join(f"coalesce({n}, (SELECT quantile_cont({n}, 0.5) FROM cells), 0) AS {n}" for n in NAMES)


def _bounds() -> str:
    return ", ".join(f"quantile_cont({n}, 0.02) AS {n}_lo, quantile_cont({n}, 0.98) AS {n}_hi" for n in NAMES)


def _aligned() -> str:
    return ", ".join(
        f"{'' if f.get('higher_is_more_deprived', True) else '-'}least(greatest({f['name']}, {f['name']}_lo), {f['name']}_hi)"
        f" AS {f['name']}" for f in CONFIG["features"]
    )


def _z() -> str:
    return ", ".join(
        f"least(greatest(CASE WHEN stddev_pop({n}) OVER g > 0 THEN ({n} - avg({n}) OVER g) / stddev_pop({n}) OVER g"
        f" ELSE 0 END, -2.5), 2.5) AS {n}_z" for n in NAMES
    )


INDEX = f"""
imputed AS (SELECT cell_id, city, country_iso, unit, score, spend, population, hotspot, {_imputed()} FROM cells),
bounds AS (SELECT city, {_bounds()} FROM imputed GROUP BY 1),
aligned AS (SELECT cell_id, city, country_iso, unit, score, spend, population, hotspot, {_aligned()} FROM imputed JOIN bounds USING (city)),
zed AS (SELECT cell_id, city, country_iso, unit, score, spend, population, hotspot, {_z()} FROM aligned WINDOW g AS (PARTITION BY city)),
dims AS (SELECT *, (discount_z + 2 * tax_z) / 3 AS access__score, (price_z + 0.5 * returned_z) / 1.5 AS services__score,
    quantity_z AS form__score FROM zed),
comp AS (SELECT *, (2 * access__score + services__score + 1.5 * form__score) / 4.5 AS deprivation_index_z FROM dims),
indexed AS (SELECT comp.*, 100 * (least(greatest(deprivation_index_z, lo), hi) - lo) / (hi - lo) AS deprivation_index_0_100,
    dense_rank() OVER (ORDER BY deprivation_index_z DESC) AS deprivation_rank_desc FROM comp,
    (SELECT quantile_cont(deprivation_index_z, 0.01) AS lo, quantile_cont(deprivation_index_z, 0.99) AS hi FROM comp))"""
BASE = roles.CELLS + "," + INDEX
SCORES = ["access__score", "services__score", "form__score"]


def _indexed(spark, sf):
    cells = roles.keep(roles.cells(spark, sf))
    return index.build_index(cells, CONFIG)


@query("build_index", """
    SELECT cell_id, city, access__score, services__score, form__score, deprivation_index_z, deprivation_index_0_100,
    deprivation_rank_desc FROM indexed""", [*SCORES, "deprivation_index_z", "deprivation_index_0_100"], BASE)
def _(spark, sf):
    return _indexed(spark, sf).table.select(
        "cell_id", "city", *SCORES, "deprivation_index_z", "deprivation_index_0_100", "deprivation_rank_desc"
    )


@query("index_summary", """
    SELECT city, count(*) AS count, avg(deprivation_index_0_100) AS mean, quantile_cont(deprivation_index_0_100, 0.5) AS median,
    stddev_samp(deprivation_index_0_100) AS std, min(deprivation_index_0_100) AS min, max(deprivation_index_0_100) AS max
    FROM indexed GROUP BY 1""", ["mean", "median", "std", "min", "max"], BASE)
def _(spark, sf):
    return report.score_summary(_indexed(spark, sf).table, "city", "deprivation_index_0_100")


@query("index_feature_summary", """
    SELECT * FROM (SELECT 'discount' AS name, 'access' AS dimension, true AS higher_is_more_deprived, quantile_cont(discount, 0.5) AS median_used FROM cells
    UNION ALL SELECT 'tax', 'access', false, quantile_cont(tax, 0.5) FROM cells
    UNION ALL SELECT 'price', 'services', true, quantile_cont(price, 0.5) FROM cells
    UNION ALL SELECT 'returned', 'services', true, quantile_cont(returned, 0.5) FROM cells
    UNION ALL SELECT 'quantity', 'form', false, quantile_cont(quantity, 0.5) FROM cells)""", ["median_used:4"], roles.CELLS)
def _(spark, sf):
    return _indexed(spark, sf).features.drop("pca_loading")


@query("impute_medians", """
    SELECT cell_id, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM cells), 0) AS price,
    coalesce(spend, (SELECT quantile_cont(spend, 0.5) FROM cells), 0) AS spend FROM cells""", ["price:4", "spend:4"], roles.CELLS)
def _(spark, sf):
    filled, _ = index.impute_medians(roles.keep(roles.cells(spark, sf)), ["price", "spend"])
    return filled.select("cell_id", "price", "spend")


@query("dimension_scores", "SELECT cell_id, (2 * discount + tax) / 3 AS a__score, -quantity AS b__score FROM cells",
       ["a__score", "b__score"], roles.CELLS)
def _(spark, sf):
    rows = roles.cells(spark, sf)
    return rows.select("cell_id", C.weighted_average([("discount", 2.0), ("tax", 1.0)]).alias("a__score"),
                       (-F.col("quantity")).alias("b__score"))


# The first component of two standardised columns is their sum or difference
# over the root of two, which SQL can state.
PCA = {
    "features": [
        {"name": "quantity", "dimension": "a"},
        {"name": "spend", "dimension": "b", "higher_is_more_deprived": False},
    ],
    "pca": {"enabled": True, "n_components": 1},
}
PCA_SQL = """
filled AS (SELECT cell_id, city, coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM cells)) AS q,
    -coalesce(spend, (SELECT quantile_cont(spend, 0.5) FROM cells)) AS s FROM cells),
stand AS (SELECT cell_id, city, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS zq, (s - avg(s) OVER ()) / stddev_pop(s) OVER () AS zs FROM filled),
turned AS (SELECT *, (zq + zs) / 2 AS z, CASE WHEN (SELECT corr(zq, zs) FROM stand) >= 0 THEN (zq + zs) / sqrt(2) ELSE (zq - zs) / sqrt(2) END AS p FROM stand),
signed AS (SELECT cell_id, city, z, CASE WHEN (SELECT corr(p, z) FROM turned) < 0 THEN -p ELSE p END AS p FROM turned),
pca AS (SELECT cell_id, city, z, p AS pca1_index_z, 100 * (p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()) AS pca1_index_0_100 FROM signed)"""


def _pca(spark, sf):
    return index.build_index(roles.keep(roles.cells(spark, sf)), PCA)


@query("pca_index", "SELECT cell_id, abs(pca1_index_z) AS size, 100 - abs(pca1_index_0_100 - 50) AS scaled FROM pca",
       ["size", "scaled"], roles.CELLS + "," + PCA_SQL)
def _(spark, sf):
    rows = _pca(spark, sf).table
    # The composite and a difference component are uncorrelated in exact
    # arithmetic, so the sign is free; the sizes are compared.
    return rows.select("cell_id", F.abs("pca1_index_z").alias("size"),
                       (100 - F.abs(F.col("pca1_index_0_100") - 50)).alias("scaled"))


@query("pca_loadings", "SELECT name, sqrt(0.5) AS loading FROM (VALUES ('quantity'), ('spend')) AS t(name)", ["loading"])
def _(spark, sf):
    return _pca(spark, sf).features.select("name", F.abs("pca_loading").alias("loading"))


@query("pca_alignment", """
    SELECT city, count(*) AS n_rows, abs(corr(deprivation_index_z, score)) AS pearson FROM indexed GROUP BY 1""",
       ["pearson"], BASE)
def _(spark, sf):
    rows = roles.keep(_indexed(spark, sf).table)
    out = compare.pca_alignment(rows, "city", "deprivation_index_z", "score")
    return out.select("city", "n_rows", F.abs("pearson_corr").alias("pearson"))


DOMINANT = """
best AS (SELECT *, CASE WHEN access__score >= services__score AND access__score >= form__score THEN 'access'
    WHEN services__score >= form__score THEN 'services' ELSE 'form' END AS dominant_dimension,
    greatest(access__score, services__score, form__score) AS dominant_dimension_score,
    list_sort([access__score, services__score, form__score])[2] AS second FROM indexed),
explained AS (SELECT *, dominant_dimension_score - second AS dominant_dimension_margin,
    CASE WHEN dominant_dimension_score - second < 0.25 THEN 'mixed' WHEN dominant_dimension_score - second < 0.75 THEN 'moderate' ELSE 'strong' END
    AS dominant_dimension_strength FROM best),
quad AS (SELECT *, coalesce(deprivation_index_0_100 >= ath, false) AS absolute_priority_flag, coalesce(score >= rt, false) AS relative_priority_flag,
    ath AS absolute_priority_threshold, rt AS relative_priority_threshold FROM explained JOIN (SELECT city, quantile_cont(score, 0.9) AS rt FROM explained GROUP BY 1) USING (city),
    (SELECT quantile_cont(deprivation_index_0_100, 0.9) AS ath FROM explained)),
quadrants AS (SELECT *, CASE WHEN absolute_priority_flag AND relative_priority_flag THEN 'joint_priority' WHEN absolute_priority_flag THEN 'absolute_only'
    WHEN relative_priority_flag THEN 'relative_only' ELSE 'lower_priority' END AS priority_quadrant FROM quad)"""
BASE_DOMINANT = BASE + "," + DOMINANT


def _explained(spark, sf):
    rows = interpret.dominant_dimension(roles.keep(_indexed(spark, sf).table), SCORES)
    return interpret.priority_quadrants(rows, "deprivation_index_0_100", "score", "city")


@query("dominant_dimension", """
    SELECT cell_id, dominant_dimension, dominant_dimension_score, dominant_dimension_margin, dominant_dimension_strength FROM explained""",
       ["dominant_dimension_score", "dominant_dimension_margin"], BASE_DOMINANT)
def _(spark, sf):
    return interpret.dominant_dimension(_indexed(spark, sf).table, SCORES).select(
        "cell_id", "dominant_dimension", "dominant_dimension_score", "dominant_dimension_margin",
        "dominant_dimension_strength",
    )


@query("priority_quadrants", """
    SELECT cell_id, absolute_priority_threshold, relative_priority_threshold, absolute_priority_flag, relative_priority_flag, priority_quadrant
    FROM quadrants""", ["absolute_priority_threshold", "relative_priority_threshold:4"], BASE_DOMINANT)
def _(spark, sf):
    return _explained(spark, sf).select(
        "cell_id", "absolute_priority_threshold", "relative_priority_threshold", "absolute_priority_flag",
        "relative_priority_flag", "priority_quadrant",
    )


@query("hotspot_typology", """
    SELECT city, priority_quadrant || '__' || dominant_dimension AS hotspot_typology, count(*) AS n FROM quadrants GROUP BY 1, 2""",
       base=BASE_DOMINANT)
def _(spark, sf):
    rows = interpret.hotspot_typology(_explained(spark, sf))
    return rows.groupBy("city", "hotspot_typology").agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------------- units

UNIT = """
ucells AS (SELECT *, CASE WHEN cell_id % 3 = 0 THEN 'access' WHEN cell_id % 3 = 1 THEN 'services' END AS dom,
    CASE WHEN spend >= 2000000 THEN 'joint' ELSE 'lower' END AS quad FROM cells),
cut AS (SELECT city, quantile_cont(score, 0.9) AS t, sum(population) AS cp, count(*) AS cn FROM ucells GROUP BY 1),
flagged AS (SELECT *, coalesce(score >= t, false) AS top, coalesce(hotspot, 'missing') = 'high_high' AS hot FROM ucells JOIN cut USING (city)),
modes AS (SELECT city, unit, max(CASE WHEN k = 'd' THEN c END) AS hotspot_dominant_dimension, max(CASE WHEN k = 'd' THEN s END) AS hotspot_dominant_dimension_weight_share,
    max(CASE WHEN k = 'q' THEN c END) AS hotspot_priority_mode, max(CASE WHEN k = 'q' THEN s END) AS hotspot_priority_mode_weight_share FROM (
    SELECT *, w / nullif(sum(w) OVER (PARTITION BY city, unit, k), 0) AS s, row_number() OVER (PARTITION BY city, unit, k ORDER BY w DESC, c) AS r FROM (
    SELECT city, unit, 'd' AS k, coalesce(dom, 'missing') AS c, sum(population) AS w FROM flagged WHERE hot GROUP BY ALL UNION ALL
    SELECT city, unit, 'q', coalesce(quad, 'missing'), sum(population) FROM flagged WHERE hot GROUP BY ALL)) WHERE r = 1 GROUP BY 1, 2),
raw AS (SELECT city, country_iso, unit, count(*) AS n_cells, count(*) / any_value(cn)::DOUBLE AS city_cell_share, CAST(sum(population) AS DOUBLE) AS population_total,
    CASE WHEN any_value(cp) > 0 THEN sum(population) / any_value(cp)::DOUBLE ELSE 0 END AS city_population_share, avg(score) AS mean_score,
    quantile_cont(score, 0.5) AS median_score, CASE WHEN sum(population) > 0 THEN sum(score * population) / sum(population) ELSE avg(score) END AS population_weighted_mean_score,
    any_value(t) AS city_score_top_fraction_threshold, CASE WHEN sum(population) > 0 THEN coalesce(sum(population) FILTER (WHERE top), 0) / sum(population)::DOUBLE ELSE 0 END AS citywide_q90_population_share,
    count(*) FILTER (WHERE top) / count(*)::DOUBLE AS citywide_q90_cell_share, CAST(coalesce(sum(population) FILTER (WHERE hot), 0) AS DOUBLE) AS hotspot_population_total,
    CASE WHEN sum(population) > 0 THEN coalesce(sum(population) FILTER (WHERE hot), 0) / sum(population)::DOUBLE ELSE 0 END AS hotspot_population_share,
    count(*) FILTER (WHERE hot) AS hotspot_cell_count, count(*) FILTER (WHERE hot) / count(*)::DOUBLE AS hotspot_cell_share FROM flagged GROUP BY 1, 2, 3),
uraw AS (SELECT raw.*, coalesce(hotspot_dominant_dimension, 'missing') AS hotspot_dominant_dimension, hotspot_dominant_dimension_weight_share,
    coalesce(hotspot_priority_mode, 'missing') AS hotspot_priority_mode, hotspot_priority_mode_weight_share,
    n_cells >= 10 AND city_population_share >= 0.01 AS eligible_priority_flag FROM raw LEFT JOIN modes USING (city, unit)),
ranks AS (SELECT city, unit, row_number() OVER (PARTITION BY city ORDER BY population_weighted_mean_score DESC, unit) AS a,
    row_number() OVER (PARTITION BY city ORDER BY citywide_q90_population_share DESC, unit) AS b,
    row_number() OVER (PARTITION BY city ORDER BY hotspot_population_share DESC, unit) AS c,
    greatest(1, ceil(count(*) OVER (PARTITION BY city) * 0.25::DOUBLE)) AS m FROM uraw WHERE eligible_priority_flag),
counted AS (SELECT uraw.*, coalesce(a <= m, false) AS population_weighted_mean_score_top_priority_flag, coalesce(b <= m, false) AS citywide_q90_population_share_top_priority_flag,
    coalesce(c <= m, false) AS hotspot_population_share_top_priority_flag,
    CAST(coalesce(a <= m, false) AS BIGINT) + CAST(coalesce(b <= m, false) AS BIGINT) + CAST(coalesce(c <= m, false) AS BIGINT) AS district_priority_metric_count
    FROM uraw LEFT JOIN ranks USING (city, unit)),
ordered AS (SELECT city, unit, row_number() OVER (PARTITION BY city ORDER BY district_priority_metric_count DESC, hotspot_population_share DESC,
    citywide_q90_population_share DESC, population_weighted_mean_score DESC, population_total DESC, unit) AS district_priority_rank FROM counted WHERE eligible_priority_flag),
districts AS (SELECT counted.*, CASE WHEN NOT eligible_priority_flag THEN 'small_footprint' WHEN district_priority_metric_count >= 2 THEN 'high_priority'
    WHEN district_priority_metric_count = 1 THEN 'emerging_priority' ELSE 'lower_priority' END AS district_priority_class, district_priority_rank
    FROM counted LEFT JOIN ordered USING (city, unit))"""
BASE_UNIT = roles.CELLS + "," + UNIT
UNIT_DOUBLES = [
    "city_cell_share", "population_total", "city_population_share", "mean_score", "median_score",
    "population_weighted_mean_score", "city_score_top_fraction_threshold", "citywide_q90_population_share",
    "citywide_q90_cell_share", "hotspot_population_total", "hotspot_population_share", "hotspot_cell_share",
    "hotspot_dominant_dimension_weight_share", "hotspot_priority_mode_weight_share",
]


def unit_summary(spark, sf):
    rows = roles.cells(spark, sf).withColumns({
        "dom": F.when(F.col("cell_id") % 3 == 0, "access").when(F.col("cell_id") % 3 == 1, "services"),
        "quad": F.when(F.col("spend") >= 2000000, "joint").otherwise("lower"),
        "unit_id": F.col("unit"),
    })
    return admin.summarize_units(
        roles.keep(rows), "city", "country_iso", "unit", "unit_id", "score", "population",
        hotspot="hotspot", dominant="dom", priority="quad",
    ).drop("unit_id", "_admin_iso_placeholder")


@query("summarize_units", "SELECT * FROM districts", UNIT_DOUBLES, BASE_UNIT)
def _(spark, sf):
    return unit_summary(spark, sf)


@query("district_classes", """
    SELECT city, district_priority_class, count(*) AS n, min(district_priority_rank) AS first_rank FROM districts GROUP BY 1, 2""",
       base=BASE_UNIT)
def _(spark, sf):
    return unit_summary(spark, sf).groupBy("city", "district_priority_class").agg(
        F.count(F.lit(1)).alias("n"), F.min("district_priority_rank").alias("first_rank")
    )


@query("unit_footprints", """
    SELECT city, unit, count(*) AS n_cells, sum(population * 1.5) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y
    FROM cells GROUP BY 1, 2""", ["area", "min_x", "min_y", "max_x", "max_y"], roles.CELLS)
def _(spark, sf):
    rows = roles.cells(spark, sf).withColumn("area_m2", F.col("population") * 1.5)
    return admin.unit_footprints(rows, ["city", "unit"], "cell_id", "area_m2", "x", "y")


@query("unit_cells", "SELECT DISTINCT city, unit, cell_id FROM cells", base=roles.CELLS)
def _(spark, sf):
    return admin.unit_cells(roles.cells(spark, sf), ["city", "unit"], "cell_id")

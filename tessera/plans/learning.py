"""Queries of the benchmark, findings, chart and profile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import charts, findings, metrics, models, profile, report, splits
from tessera.plans import roles
from tessera.plans.indexing import BASE_UNIT, unit_summary
from tessera.plans.registry import query
from tessera.plans.reports import LONG
from tessera.sources import points

# ------------------------------------------------------------------- metrics


@query("regression_metrics", """
    SELECT protocol, model, avg(abs(rwi_true - rwi_pred)) AS mae, sqrt(avg((rwi_true - rwi_pred) ^ 2)) AS rmse,
    CASE WHEN var_pop(rwi_true) > 0 THEN 1 - sum((rwi_true - rwi_pred) ^ 2) / (var_pop(rwi_true) * count(*)) ELSE 0 END AS r2, corr(rwi_true, rwi_pred) AS pearson_corr, corr(ry, rp) AS spearman_corr FROM (
    SELECT *, rank() OVER (PARTITION BY protocol ORDER BY rwi_true) + (count(*) OVER (PARTITION BY protocol, rwi_true) - 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY protocol ORDER BY rwi_pred) + (count(*) OVER (PARTITION BY protocol, rwi_pred) - 1) / 2.0 AS rp FROM predictions) GROUP BY 1, 2""",
       ["mae", "rmse", "r2", "pearson_corr", "spearman_corr"], roles.PREDICTIONS)
def _(spark, sf):
    return metrics.regression_metrics(roles.predictions(spark, sf))


CLASSIFIED = """
part AS (SELECT *, low_wealth_true = 1 AS pos FROM predictions),
wins AS (SELECT a.protocol, avg(CASE WHEN a.low_wealth_prob > b.low_wealth_prob THEN 1.0 WHEN a.low_wealth_prob = b.low_wealth_prob THEN 0.5 ELSE 0.0 END) AS roc_auc
    FROM part a JOIN part b ON a.protocol = b.protocol AND a.pos AND NOT b.pos GROUP BY 1),
cum AS (SELECT protocol, p, sum(p) OVER o AS cp, sum(n) OVER o AS cn FROM (SELECT protocol, low_wealth_prob, count(*) FILTER (WHERE pos) AS p, count(*) AS n FROM part GROUP BY 1, 2)
    WINDOW o AS (PARTITION BY protocol ORDER BY low_wealth_prob DESC)),
ap AS (SELECT protocol, CASE WHEN max(cp) < max(cn) THEN sum(p * cp / cn::DOUBLE) / sum(p) END AS average_precision FROM cum GROUP BY 1),
conf AS (SELECT protocol, model, count(*) FILTER (WHERE pos) AS np, count(*) FILTER (WHERE NOT pos) AS nq, count(*) FILTER (WHERE pos AND low_wealth_prob >= 0.5) AS tp,
    count(*) FILTER (WHERE NOT pos AND low_wealth_prob >= 0.5) AS fp FROM part GROUP BY 1, 2),
classified AS (SELECT protocol, model, roc_auc, average_precision, CASE WHEN np > 0 AND nq > 0 THEN 2.0 * tp / (np + tp + fp) END AS f1,
    CASE WHEN np > 0 AND nq > 0 THEN (tp / np::DOUBLE + (nq - fp) / nq::DOUBLE) / 2 END AS balanced_accuracy FROM conf LEFT JOIN wins USING (protocol) LEFT JOIN ap USING (protocol))"""


@query("classification_metrics", "SELECT * FROM classified", ["roc_auc", "average_precision", "f1", "balanced_accuracy"],
       roles.PREDICTIONS + "," + CLASSIFIED)
def _(spark, sf):
    return metrics.classification_metrics(roles.predictions(spark, sf))


@query("long_metrics", """
    SELECT protocol, model, metric, value FROM classified UNPIVOT INCLUDE NULLS (value FOR metric IN (roc_auc, average_precision, f1, balanced_accuracy))""",
       ["value"], roles.PREDICTIONS + "," + CLASSIFIED)
def _(spark, sf):
    table = metrics.classification_metrics(roles.predictions(spark, sf))
    return metrics.long_metrics(table, ["protocol", "model"], metrics.CLASSIFICATION)


@query("benchmark_leaders", """
    SELECT protocol, metric, model AS winner_model, value, direction FROM ranked WHERE rank = 1""", ["value"], roles.METRICS)
def _(spark, sf):
    return findings.benchmark_leaders(roles.model_metrics(spark, sf))


AVERAGED = """
averaged AS (SELECT scope, metric, model, avg(rank) AS mean_rank FROM (SELECT *, 'all_protocols' AS scope FROM ranked UNION ALL
    SELECT *, CASE WHEN protocol = 'pooled_random' THEN 'pooled_only' ELSE 'transfer_only' END FROM ranked) GROUP BY 1, 2, 3)"""


@query("average_ranks", "SELECT * FROM averaged", ["mean_rank"], roles.METRICS + "," + AVERAGED)
def _(spark, sf):
    return findings.average_ranks(roles.model_metrics(spark, sf))


@query("hardest_holdouts", """
    SELECT (SELECT protocol FROM ranked WHERE rank = 1 AND metric = 'rmse' AND protocol <> 'pooled_random' ORDER BY value DESC, protocol LIMIT 1) AS rmse_protocol,
    (SELECT value FROM ranked WHERE rank = 1 AND metric = 'rmse' AND protocol <> 'pooled_random' ORDER BY value DESC, protocol LIMIT 1) AS best_rmse,
    (SELECT protocol FROM ranked WHERE rank = 1 AND metric = 'average_precision' AND protocol <> 'pooled_random' ORDER BY value, protocol LIMIT 1) AS ap_protocol,
    (SELECT value FROM ranked WHERE rank = 1 AND metric = 'average_precision' AND protocol <> 'pooled_random' ORDER BY value, protocol LIMIT 1) AS best_ap""",
       ["best_rmse", "best_ap"], roles.METRICS)
def _(spark, sf):
    row = findings.hardest_holdouts(roles.model_metrics(spark, sf))
    return row.select(
        F.col("rmse.protocol").alias("rmse_protocol"), F.col("rmse.best_rmse").alias("best_rmse"),
        F.col("average_precision.protocol").alias("ap_protocol"),
        F.col("average_precision.best_average_precision").alias("best_ap"),
    )


@query("holdout_recommendations", """
    SELECT protocol, max(model) FILTER (WHERE metric = 'rmse') AS regression, max(model) FILTER (WHERE metric = 'spearman_corr') AS ranking,
    max(model) FILTER (WHERE metric = 'average_precision') AS screening FROM ranked WHERE rank = 1 AND protocol <> 'pooled_random' GROUP BY 1""",
       base=roles.METRICS)
def _(spark, sf):
    rows = findings.holdout_recommendations(roles.model_metrics(spark, sf))
    return rows.select("protocol", *[
        F.col(f"{n}_recommendation.winner_model").alias(n) for n in ("regression", "ranking", "screening")
    ])


@query("baseline_wins", "SELECT protocol, metric, value FROM ranked WHERE rank = 1 AND model = 'model_5-low'", ["value"], roles.METRICS)
def _(spark, sf):
    return findings.baseline_wins(roles.model_metrics(spark, sf), "model_5-low").select("protocol", "metric", "value")


@query("benchmark_summary", """
    SELECT (SELECT count(*) FROM ranked WHERE rank = 1) AS n_leaders, (SELECT count(DISTINCT protocol) FROM ranked) AS n_protocols,
    (SELECT model FROM ranked WHERE rank = 1 AND protocol = 'pooled_random' AND metric = 'rmse') AS pooled_rmse,
    (SELECT model FROM averaged WHERE scope = 'transfer_only' AND metric = 'mae' ORDER BY mean_rank, model LIMIT 1) AS transfer_mae""",
       base=roles.METRICS + "," + AVERAGED)
def _(spark, sf):
    row = findings.benchmark_summary(roles.model_metrics(spark, sf))
    return row.select(
        F.size("leaders").alias("n_leaders"), F.size("by_protocol").alias("n_protocols"),
        F.col("by_protocol")["pooled_random"]["rmse"]["winner_model"].alias("pooled_rmse"),
        F.col("average_ranks")["transfer_only"]["mae"][0]["model"].alias("transfer_mae"),
    )


@query("benchmark_findings", """
    SELECT count(DISTINCT model) AS n_models, count(DISTINCT protocol) AS n_protocols, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols,
    count(*) FILTER (WHERE rank = 1 AND model = 'model_5-low') AS n_wins, count(DISTINCT protocol) FILTER (WHERE protocol <> 'pooled_random') AS n_holdouts FROM ranked""",
       base=roles.METRICS)
def _(spark, sf):
    row = findings.benchmark_findings(roles.model_metrics(spark, sf), "model_5-low")
    return row.select(
        "n_models", "n_protocols", F.concat_ws(",", "protocols").alias("protocols"),
        F.col("baseline_retained_value.n_metric_wins").alias("n_wins"), F.size("holdout_protocols").alias("n_holdouts"),
    )


# -------------------------------------------------------------------- splits

LABELLED = """
labelled AS (SELECT cell_id, city, score < 1000 AS cls, price IS NOT NULL OR score < 0 AS label_mask FROM cells)"""


def _labelled(spark, sf):
    return roles.cells(spark, sf).select(
        "cell_id", "city", (F.col("score") < 1000).alias("cls"),
        (F.col("price").isNotNull() | (F.col("score") < 0)).alias("label_mask"),
    )


@query("protocol_splits", """
    SELECT 'holdout_' || lower(h.city) AS protocol, CASE WHEN l.city = h.city THEN 'test' ELSE 'train' END AS role, count(*) AS n
    FROM labelled l, (SELECT DISTINCT city FROM labelled WHERE label_mask) h WHERE label_mask GROUP BY 1, 2 UNION ALL
    SELECT 'pooled_random', 'test', CAST(sum(round(n * 0.2::DOUBLE)) AS BIGINT) FROM (SELECT count(*) AS n FROM labelled WHERE label_mask GROUP BY city, cls) UNION ALL
    SELECT 'pooled_random', 'train', CAST(sum(n - round(n * 0.2::DOUBLE)) AS BIGINT) FROM (SELECT count(*) AS n FROM labelled WHERE label_mask GROUP BY city, cls)""",
       base=roles.CELLS + "," + LABELLED)
def _(spark, sf):
    rows = splits.protocol_splits(_labelled(spark, sf), cls="cls")
    return rows.groupBy("protocol", "role").agg(F.count(F.lit(1)).alias("n"))


@query("protocol_all_pairs", """
    SELECT lower(a.city) || '_to_' || lower(b.city) AS protocol, CASE WHEN l.city = b.city THEN 'test' ELSE 'train' END AS role, count(*) AS n
    FROM labelled l JOIN (SELECT DISTINCT city FROM labelled) a ON true JOIN (SELECT DISTINCT city FROM labelled) b ON a.city <> b.city AND l.city IN (a.city, b.city)
    WHERE label_mask GROUP BY 1, 2""", base=roles.CELLS + "," + LABELLED)
def _(spark, sf):
    rows = splits.protocol_splits(_labelled(spark, sf), cls="cls", strategy="all_pairs").where("protocol <> 'pooled_random'")
    return rows.groupBy("protocol", "role").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_share", """
    SELECT city, cls, count(*) AS n, CAST(round(count(*) * 0.2::DOUBLE) AS BIGINT) AS test FROM labelled GROUP BY 1, 2""",
       base=roles.CELLS + "," + LABELLED)
def _(spark, sf):
    rows = splits.seeded_share(_labelled(spark, sf), ["city", "cls"], 0.2, "cell_id", 42, "t")
    return rows.groupBy("city", "cls").agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("test"))


@query("train_validation_split", """
    SELECT cls, CAST(count(*) - round(count(*) * 0.15::DOUBLE) AS BIGINT) AS train, CAST(round(count(*) * 0.15::DOUBLE) AS BIGINT) AS validation FROM labelled GROUP BY 1""",
       base=roles.CELLS + "," + LABELLED)
def _(spark, sf):
    train, held = splits.train_validation_split(_labelled(spark, sf), "cls")
    a = train.groupBy("cls").agg(F.count(F.lit(1)).alias("train"))
    return a.join(held.groupBy("cls").agg(F.count(F.lit(1)).alias("validation")), "cls")


@query("standardize_train", """
    SELECT cell_id, (coalesce(price, m) - m) / s AS price FROM cells, (SELECT avg(price) AS m, CASE WHEN stddev_pop(price) <= 1e-6 THEN 1 ELSE stddev_pop(price) END AS s
    FROM cells WHERE cell_id % 5 > 0)""", ["price"], roles.CELLS)
def _(spark, sf):
    rows = roles.cells(spark, sf).withColumn("role", F.when(F.col("cell_id") % 5 > 0, "train").otherwise("test"))
    return models.standardize_features(rows, ["price"]).select("cell_id", "price")


@query("standardize_channels", """
    SELECT vec_id, CAST((CAST(embedding[1] AS DOUBLE) - m0) / s0 AS REAL) AS first, CAST((CAST(embedding[64] AS DOUBLE) - m1) / s1 AS REAL) AS last FROM embeddings,
    (SELECT avg(CAST(v AS DOUBLE)) AS m0, stddev_pop(CAST(v AS DOUBLE)) AS s0 FROM (SELECT unnest(embedding[1:32]) AS v FROM embeddings WHERE vec_id % 4 > 0)),
    (SELECT avg(CAST(v AS DOUBLE)) AS m1, stddev_pop(CAST(v AS DOUBLE)) AS s1 FROM (SELECT unnest(embedding[33:64]) AS v FROM embeddings WHERE vec_id % 4 > 0))""",
       ["first:4", "last:4"])
def _(spark, sf):
    rows = roles.table(spark, sf, "embeddings").withColumn("role", F.when(F.col("vec_id") % 4 > 0, "train").otherwise("test"))
    out = models.standardize_patches(rows, "embedding", 2)
    return out.select("vec_id", F.col("embedding")[0].alias("first"), F.col("embedding")[63].alias("last"))


@query("align_to_ids", "SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id)")
def _(spark, sf):
    ids = roles.table(spark, sf, "labels").select("doc_id", "quality")
    return models.align_to(roles.table(spark, sf, "documents").select("doc_id", "n_chars"), ids, "doc_id")


@query("array_dataset", """
    SELECT CAST(cell_id AS VARCHAR) AS cell_id, city, CAST(discount AS REAL) AS f0, CAST(price AS REAL) AS f1, CAST(spend AS REAL) AS target, CAST(score < 1000 AS INT) AS label,
    spend IS NOT NULL AS label_mask FROM cells""", ["f0", "f1:2", "target:2", "label"], roles.CELLS)
def _(spark, sf):
    rows = roles.cells(spark, sf).withColumn("low", F.col("score") < 1000)
    out = points.array_dataset(rows, ["discount", "price"], regression="spend", classification="low")
    return out.select(
        "cell_id", "city", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"),
        F.col("regression_target").alias("target"),
        F.col("classification_target").alias("label"), "label_mask",
    )


# -------------------------------------------------------------------- models


def baseline_rows(spark, sf):
    return roles.keep(roles.cells(spark, sf).select(
        "cell_id", "score", "spend", (F.col("spend") > 2200000).cast("int").alias("rich"), F.lit("p").alias("protocol"),
        F.when(F.col("cell_id") % 4 > 0, "train").otherwise("test").alias("role"),
    ))


@query("linear_baseline_line", """
    SELECT cell_id, a + b * -score AS rwi_pred FROM cells, (SELECT regr_slope(spend, -score) AS b, regr_intercept(spend, -score) AS a FROM cells WHERE cell_id % 4 > 0)
    WHERE cell_id % 4 = 0""", ["rwi_pred:2"], roles.CELLS)
def _(spark, sf):
    return models.linear_baseline(baseline_rows(spark, sf), "score", "spend", "rich").select("cell_id", "rwi_pred")


# Newton steps of three protocols' curves, from the classes' log odds; the penalty is on the slope of the raw score.
CURVES = """
    WITH RECURSIVE train AS (SELECT cell_id % 3 AS k, -score AS x, CAST(CAST(spend > 2200000 AS INTEGER) AS DOUBLE) AS y
        FROM cells WHERE cell_id % 4 > 0 AND score IS NOT NULL AND spend IS NOT NULL),
    scale AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s, ln(sum(y) / sum(1 - y)) AS c FROM train GROUP BY k),
    unit AS (SELECT k, (x - m) / s AS z, y, s, c FROM train JOIN scale USING (k)),
    newton AS (
        SELECT k, 0 AS i, c AS a, 0.0::DOUBLE AS b FROM scale
        UNION ALL
        SELECT k, i + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
            SELECT k, i, a, b, sum(p - y) AS g0, sum((p - y) * z) + b / any_value(s * s) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * z) AS h01,
                sum(p * (1 - p) * z * z) + 1 / any_value(s * s) AS h11
            FROM (SELECT n.k, i, a, b, z, y, s, 1 / (1 + exp(-(a + b * z))) AS p FROM newton n JOIN unit u ON n.k = u.k WHERE i < 25)
            GROUP BY k, i, a, b))
    SELECT cell_id, 1 / (1 + exp(-(a + b * (-score - m) / s))) AS low_wealth_prob
    FROM cells JOIN newton ON k = cell_id % 3 AND i = 25 JOIN scale USING (k) WHERE cell_id % 4 = 0"""


@query("linear_baseline_probability", CURVES, ["low_wealth_prob"], roles.CELLS)
def _(spark, sf):
    rows = baseline_rows(spark, sf).withColumn("protocol", F.concat(F.lit("p"), F.col("cell_id") % 3))
    return models.linear_baseline(rows, "score", "spend", "rich").select("cell_id", "low_wealth_prob")


@query("kmeans_groups")
def _(spark, sf):
    cells = roles.cells(spark, sf).select("cell_id", "score", "spend", "quantity")
    rows, _ = models.kmeans_groups(cells, ["score", "spend", "quantity"], 4, restarts=3)
    return rows.select("cell_id", "cluster_id")


@query("cluster_report", """
    SELECT cell_id % 4 AS cluster_id, count(*) AS cluster_size, avg(score) AS score, avg(spend) AS spend FROM cells GROUP BY 1""",
       ["score:4", "spend:3"], roles.CELLS)
def _(spark, sf):
    rows = roles.cells(spark, sf).withColumn("cluster_id", F.col("cell_id") % 4)
    return models.cluster_report(rows, ["score", "spend"])


@query("run_benchmark")
def _(spark, sf):
    """Both models, all protocols, with few trees."""
    rows = roles.cells(spark, sf).withColumns({
        "rwi_mean": F.col("spend") / 1e6, "low": (F.col("spend") < 1800000).cast("int"), "mask": F.col("spend").isNotNull(),
    })
    out, _ = models.run_benchmark(
        roles.keep(rows), ["score", "quantity", "price", "lines"], score="score", label="low", mask="mask", trees=3, depth=3
    )
    return out


# ------------------------------------------------------------------ findings


@query("ranking_summary", """
    SELECT city, value, row_number() OVER (ORDER BY value DESC, city) AS rank, max(value) OVER () - min(value) OVER () AS top_minus_bottom_gap
    FROM (SELECT city, avg(score) AS value FROM cells GROUP BY 1)""", ["value", "top_minus_bottom_gap"], roles.CELLS)
def _(spark, sf):
    return findings.ranking_rows(report.score_summary(roles.cells(spark, sf), "city", "score"), "mean")


@query("top_categories", """
    SELECT city, unit AS category, share, rank FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY share DESC, unit) AS rank FROM (
    SELECT city, unit, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY city) AS share FROM cells GROUP BY 1, 2)) WHERE rank <= 3""",
       ["share"], roles.CELLS)
def _(spark, sf):
    return findings.top_categories(report.category_shares(roles.cells(spark, sf), "city", "unit"), "unit", "share", 3)


@query("top_units", """
    SELECT city, unit AS admin_unit, district_priority_rank, district_priority_class, district_priority_metric_count, population_weighted_mean_score,
    citywide_q90_population_share, hotspot_population_share, hotspot_dominant_dimension, position FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY
    district_priority_rank, population_total DESC, unit) AS position FROM districts WHERE district_priority_rank IS NOT NULL AND district_priority_class = 'high_priority') WHERE position <= 5""",
       ["population_weighted_mean_score", "citywide_q90_population_share", "hotspot_population_share"], BASE_UNIT)
def _(spark, sf):
    return findings.top_units(unit_summary(spark, sf), 5, True, name="unit")


@query("class_population_share", """
    SELECT city, district_priority_class, sum(population_total) AS population_total_by_class, sum(population_total) / sum(sum(population_total)) OVER (PARTITION BY city) AS population_share
    FROM districts GROUP BY 1, 2""", ["population_total_by_class", "population_share"], BASE_UNIT)
def _(spark, sf):
    return findings.class_population_share(unit_summary(spark, sf))


@query("order_stability", """
    SELECT (SELECT city FROM cells WHERE price IS NOT NULL GROUP BY city ORDER BY avg(price) DESC, city LIMIT 1) =
    (SELECT city FROM cells WHERE price IS NOT NULL AND population > 8 GROUP BY city ORDER BY avg(price) DESC, city LIMIT 1) AS mean""", base=roles.CELLS)
def _(spark, sf):
    rows = roles.cells(spark, sf)
    both = report.score_summary(rows, "city", "price", "a").unionByName(
        report.score_summary(rows.where("population > 8"), "city", "price", "b")
    )
    return findings.order_stability(both, "mean", "a", "b")


def finding_tables(spark, sf):
    """Small summary tables of two scenarios: all cells, and the busy ones."""
    cells = roles.keep(roles.cells(spark, sf).withColumns({
        "dominant_dimension": F.when(F.col("cell_id") % 3 == 0, "access").otherwise("services"),
        "priority_quadrant": F.when(F.col("spend") >= 2000000, "joint_priority").otherwise("lower_priority"),
    }))
    cells = cells.withColumn("hotspot_typology", F.concat_ws("__", "priority_quadrant", "dominant_dimension"))
    busy = cells.where("population > 8")
    hot = ("hotspot", "high_high")

    def both(make):
        return roles.keep(make(cells, "base").unionByName(make(busy, "busy")))

    from tessera.operators import compare

    left = cells.select("cell_id", "city", "score")
    right = cells.where("spend IS NOT NULL").select("cell_id", F.col("spend").alias("other"))
    summary, merged = compare.compare_scores(left, right, ["cell_id"], "city", "score", "other", "absolute", "relative", scenario="base")
    scores = both(lambda d, s: report.score_summary(d, "city", "score", s))
    exposed = both(lambda d, s: report.exposure(d, "city", "score", "population", scenario=s))
    unequal = both(lambda d, s: report.inequality(d, "city", "score", "population", s))
    out = {
        "city_score_summary": scores, "population_exposure": exposed, "inequality_summary": unequal,
        "grid_size_score_summary": scores, "grid_size_population_exposure": exposed,
        "grid_size_inequality_summary": unequal,
        "absolute_relative_alignment": summary,
        "relative_shift_summary": compare.comparison_shift(merged, "city", "absolute", "relative", scenario="base"),
        "admin_summary": unit_summary(spark, sf).withColumnRenamed("unit", "admin2_name"),
    }
    for name, category in (
        ("hotspot_dominant_population_share", "dominant_dimension"),
        ("hotspot_priority_population_share", "priority_quadrant"),
        ("hotspot_typology_population_share", "hotspot_typology"),
    ):
        out[name] = report.weighted_category_shares(cells, "city", category, "population", "base", hot)
    return {k: roles.keep(v) for k, v in out.items()}


@query("core_findings", """
    SELECT 5 AS n_cities, (SELECT city FROM cells GROUP BY 1 ORDER BY avg(score) DESC, city LIMIT 1) AS highest,
    (SELECT max(m) - min(m) FROM (SELECT avg(score) AS m FROM cells GROUP BY city)) AS gap,
    (SELECT avg(score) FROM cells WHERE city = 'BUILDING' AND population > 8) - (SELECT avg(score) FROM cells WHERE city = 'BUILDING') AS delta,
    (SELECT count(*) FROM (SELECT DISTINCT city FROM districts WHERE district_priority_class = 'high_priority')) + 24 AS n_claims""",
       ["gap", "delta"], BASE_UNIT)
def _(spark, sf):
    row = findings.core_findings(finding_tables(spark, sf), "base", "busy")
    return row.select(
        F.size("cities").alias("n_cities"), F.col("cross_city.mean_score.ranking")[0]["city"].alias("highest"),
        F.col("cross_city.mean_score.top_minus_bottom_gap").alias("gap"),
        F.col("cities")["BUILDING"]["sensitivity"]["mean_score"]["delta_busy_minus_base"].alias("delta"),
        F.size("claims").alias("n_claims"),
    )


# -------------------------------------------------------------------- charts


@query("histogram", """
    SELECT bin, lo + (bin - 1) * (hi - lo) / 12 AS bin_start, lo + bin * (hi - lo) / 12 AS bin_end, coalesce(n, 0) AS count FROM (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    generate_series(1, 12) AS t(bin) LEFT JOIN (SELECT least(12, 1 + CAST(floor((o_totalprice - lo) / (hi - lo) * 12) AS BIGINT)) AS b, count(*) AS n FROM orders,
    (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1) ON b = bin""", ["bin_start:4", "bin_end:4"])
def _(spark, sf):
    return charts.histogram(roles.table(spark, sf, "orders"), "o_totalprice")


@query("box_stats", """
    SELECT event_type, any_value(q1) AS q1, any_value(m) AS median, any_value(q3) AS q3, min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
    max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) USING (event_type) GROUP BY 1""",
       ["q1", "median", "q3", "whisker_low", "whisker_high"])
def _(spark, sf):
    return charts.box_stats(roles.table(spark, sf, "events"), "value", "event_type")


@query("color_range", "SELECT quantile_cont(value, 0.01) AS vmin, quantile_cont(value, 0.99) AS vmax FROM events", ["vmin", "vmax"])
def _(spark, sf):
    return charts.color_range(roles.table(spark, sf, "events"), "value")


MEANS = "means AS (SELECT feature, city, avg(v) AS value FROM long GROUP BY 1, 2)"


def _means(spark, sf):
    from tessera.plans.reports import FEATURES

    rows = roles.cells(spark, sf).groupBy("city").agg(*[F.avg(f).alias(f) for f in FEATURES])
    return rows.unpivot(["city"], FEATURES, "feature", "value")


@query("heatmap", """
    SELECT feature, AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY, mean_abs_value, row_number() OVER (ORDER BY mean_abs_value DESC, feature) AS row_order,
    (SELECT max(abs(value)) FROM means) AS lim FROM (SELECT feature, avg(abs(value)) AS mean_abs_value, max(value) FILTER (WHERE city = 'AUTOMOBILE') AS AUTOMOBILE,
    max(value) FILTER (WHERE city = 'BUILDING') AS BUILDING, max(value) FILTER (WHERE city = 'FURNITURE') AS FURNITURE,
    max(value) FILTER (WHERE city = 'HOUSEHOLD') AS HOUSEHOLD, max(value) FILTER (WHERE city = 'MACHINERY') AS MACHINERY FROM means GROUP BY 1)""",
       ["AUTOMOBILE:4", "BUILDING:4", "FURNITURE:4", "HOUSEHOLD:4", "MACHINERY:4", "mean_abs_value:4", "lim:4"], roles.CELLS + "," + LONG + "," + MEANS)
def _(spark, sf):
    return charts.heatmap(_means(spark, sf), "feature", "city", "value").withColumnRenamed("limit", "lim")


@query("faceted_heatmap", """
    SELECT o_orderpriority, o_orderstatus, year, value, row_order, max(abs(value)) OVER () AS lim FROM (SELECT o_orderpriority, o_orderstatus,
    CAST(year(o_orderdate) AS VARCHAR) AS year, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3) JOIN (SELECT year, row_number() OVER (ORDER BY avg(abs(value)) DESC, year) AS row_order FROM (
    SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, avg(o_totalprice) AS value FROM orders GROUP BY year(o_orderdate), o_orderpriority, o_orderstatus) GROUP BY 1) USING (year)""",
       ["value:3", "lim:3"])
def _(spark, sf):
    rows = roles.table(spark, sf, "orders").groupBy(
        "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year")
    ).agg(F.avg("o_totalprice").alias("value"))
    return charts.faceted_heatmap(rows, "o_orderpriority", "o_orderstatus", "year", "value").withColumnRenamed("limit", "lim")


@query("grouped_bars", """
    SELECT o_orderpriority, max(n) FILTER (WHERE s = 'F') AS F, max(n) FILTER (WHERE s = 'O') AS O, max(n) FILTER (WHERE s = 'P') AS P FROM (
    SELECT o_orderpriority, o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    counts = roles.table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return charts.grouped_bars(counts, "o_orderpriority", "n", "o_orderstatus")


@query("hotspot_legend", """
    SELECT city, position, category, coalesce(n, 0) AS count FROM (SELECT * FROM (SELECT DISTINCT city FROM cells), (VALUES (1, 'high_high'), (2, 'low_low'), (3, 'high_low'), (4, 'low_high'),
    (5, 'not_significant'), (6, 'unknown'), (7, 'missing')) AS t(position, category)) LEFT JOIN (SELECT city, coalesce(hotspot, 'missing') AS category, count(*) AS n FROM cells GROUP BY 1, 2)
    USING (city, category)""", base=roles.CELLS)
def _(spark, sf):
    return charts.hotspot_legend(roles.cells(spark, sf), "hotspot", "city")


@query("category_legend", """
    SELECT p_type AS category, count(*) AS count, row_number() OVER (ORDER BY p_type) AS position FROM part GROUP BY 1""")
def _(spark, sf):
    return charts.legend_counts(roles.table(spark, sf, "part"), "p_type")


@query("scatter_limits", """
    SELECT least(min(l_quantity), min(l_discount)) AS axis_min, greatest(max(l_quantity), max(l_discount)) AS axis_max FROM lineitem""", ["axis_min", "axis_max"])
def _(spark, sf):
    return charts.scatter_limits(roles.table(spark, sf, "lineitem"), "l_quantity", "l_discount")


@query("lowest_highest", """
    (SELECT o_orderkey, o_totalprice, 'lowest' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 8) UNION ALL
    (SELECT o_orderkey, o_totalprice, 'highest' FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8)""", ["o_totalprice"])
def _(spark, sf):
    return charts.lowest_highest(roles.table(spark, sf, "orders"), "o_totalprice", "o_orderkey")


@query("quicklook_points", "SELECT x, y, score FROM cells", ["x", "y", "score"], roles.CELLS)
def _(spark, sf):
    return charts.quicklook(roles.cells(spark, sf), "score", lon="x", lat="y")["point_map"]


# ------------------------------------------------------------------- profile


@query("profile", """
    SELECT * FROM (SELECT 0 AS position, 'o_orderkey' AS name, 'bigint' AS dtype, count(*) AS rows, count(o_orderkey) AS non_null, count(*) - count(o_orderkey) AS nulls, count(DISTINCT o_orderkey) AS n_unique FROM orders
    UNION ALL SELECT 1, 'o_totalprice', 'double', count(*), count(o_totalprice), count(*) - count(o_totalprice), count(DISTINCT o_totalprice) FROM orders
    UNION ALL SELECT 2, 'o_orderstatus', 'string', count(*), count(o_orderstatus), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders
    UNION ALL SELECT 3, 'big', 'double', count(*), count(*) FILTER (WHERE o_totalprice > 400000), count(*) - count(*) FILTER (WHERE o_totalprice > 400000), count(DISTINCT o_totalprice) FILTER (WHERE o_totalprice > 400000) FROM orders)""")
def _(spark, sf):
    rows = roles.table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus",
        F.when(F.col("o_totalprice") > 400000, F.col("o_totalprice")).alias("big"),
    )
    return profile.profile(rows).drop("examples")


@query("profile_examples", """
    SELECT 0 AS position, array_to_string(list_sort(list(DISTINCT o_orderkey))[1:3], ',') AS examples FROM (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders)
    UNION ALL SELECT 1, array_to_string(list_sort(list(DISTINCT o_orderstatus))[1:3], ',') FROM orders""")
def _(spark, sf):
    rows = roles.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return profile.examples(rows, distinct=True).withColumn("examples", F.array_join("examples", ","))


@query("profile_bounds", "SELECT city, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM cells GROUP BY 1",
       ["minx", "miny", "maxx", "maxy"], roles.CELLS)
def _(spark, sf):
    return profile.bounds(roles.cells(spark, sf), by=["city"])


@query("profile_preview", "SELECT * FROM lineitem ORDER BY ALL LIMIT 5")
def _(spark, sf):
    """The first five rows by their columns."""
    return profile.preview(roles.table(spark, sf, "lineitem"))

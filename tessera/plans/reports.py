"""Queries of the report, comparison, contrast and validation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import compare, contrast, order, report, transform, validate
from tessera.plans import roles
from tessera.plans.registry import query
from tessera.sources import tables

FEATURES = ["lines", "quantity", "price", "discount", "returned"]


# --------------------------------------------------------------- row-local


@query("numeric_coercion", """
    SELECT event_type, count(k) AS n_numeric, count(*) - count(k) AS n_missing, sum(k) AS total, count(bad) AS n_bad
    FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k,
          try_cast(event_type AS DOUBLE) AS bad FROM events) GROUP BY 1""", ["total"])
def _(spark, sf):
    rows = roles.table(spark, sf, "events").select(
        "event_type", C.numeric(F.get_json_object("props", "$.k")).alias("k"), C.numeric("event_type").alias("bad")
    )
    return rows.groupBy("event_type").agg(
        F.count("k").alias("n_numeric"), F.count_if(F.col("k").isNull()).alias("n_missing"),
        F.sum("k").alias("total"), F.count("bad").alias("n_bad"),
    )


@query("filter_eq", "SELECT event_id, event_type, value FROM events WHERE event_type = 'click'")
def _(spark, sf):
    return C.filter_eq(roles.table(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", "click")


@query("optional_filter", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return C.filter_eq(roles.table(spark, sf, "events"), None, "x").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


MASK = [{"column": "value", "op": ">=", "value": 60}, {"column": "user_id", "op": "!=", "value": 7}]


@query("analysis_mask", "SELECT event_id, user_id, value FROM events WHERE coalesce(value >= 60, false) AND user_id IS DISTINCT FROM 7")
def _(spark, sf):
    return C.analysis_mask(roles.table(spark, sf, "events").select("event_id", "user_id", "value"), MASK, "all")


@query("analysis_mask_any", """
    SELECT c_mktsegment AS city, count(*) AS n FROM customer
    WHERE c_acctbal < 0 OR c_nationkey <= 3 OR c_nationkey = 20 GROUP BY 1""")
def _(spark, sf):
    conditions = [
        {"column": "c_acctbal", "op": "<", "value": 0},
        {"column": "c_nationkey", "op": "<=", "value": 3},
        {"column": "c_nationkey", "op": "==", "value": 20},
    ]
    rows = roles.table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "city")
    return C.analysis_mask(rows, conditions, "any").groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@query("mask_report", """
    SELECT city, rows_before, rows_after, rows_before - rows_after AS rows_removed,
           CAST(rows_after AS DOUBLE) / rows_before AS share_kept
    FROM (SELECT event_type AS city, count(*) AS rows_before,
          count(*) FILTER (WHERE value > 30 OR user_id < 10) AS rows_after FROM events GROUP BY ROLLUP (event_type))""",
       ["share_kept"])
def _(spark, sf):
    rows = roles.table(spark, sf, "events").withColumnRenamed("event_type", "city")
    conditions = [{"column": "value", "op": ">", "value": 30}, {"column": "user_id", "op": "<", "value": 10}]
    return C.mask_report(rows, conditions, "any")


@query("composite_column", """
    SELECT cell_id, coalesce(hotspot, 'missing') || '__' || unit AS label FROM cells""", base=roles.CELLS)
def _(spark, sf):
    return C.composite_column(roles.cells(spark, sf), ["hotspot", "unit"], "label").select("cell_id", "label")


@query("scenario_tag", "SELECT 'base' AS scenario, s_suppkey, s_name FROM supplier")
def _(spark, sf):
    return C.tag_scenario(roles.table(spark, sf, "supplier").select("s_suppkey", "s_name"), "base")


@query("scenario_filter", "SELECT o_orderkey, o_orderstatus AS scenario FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf):
    rows = roles.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("scenario"))
    return C.filter_scenario(rows, "P")


@query("service_amenities", """
    SELECT city, coalesce(amenity, 'none') AS kind, count(*) AS n FROM amenities
    WHERE coalesce(lower(amenity) NOT IN ('bench', 'parking'), true) GROUP BY 1, 2""", base=roles.AMENITY)
def _(spark, sf):
    rows = C.service_points(roles.amenities(spark, sf))
    return rows.groupBy("city", F.coalesce("amenity", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("school_amenities", "SELECT poi_id FROM amenities WHERE lower(amenity) IN ('school', 'university')", base=roles.AMENITY)
def _(spark, sf):
    return C.school_points(roles.amenities(spark, sf)).select("poi_id")


@query("clinic_amenities", """
    SELECT poi_id FROM amenities WHERE coalesce(lower(amenity) IN ('clinic', 'pharmacy'), false)
    OR coalesce(healthcare IN ('yes', 'doctors'), false)""", base=roles.AMENITY)
def _(spark, sf):
    return C.clinic_points(roles.amenities(spark, sf)).select("poi_id")


@query("intersection_nodes", "SELECT poi_id, street_count FROM amenities WHERE street_count >= 3", base=roles.AMENITY)
def _(spark, sf):
    return C.intersection_nodes(roles.amenities(spark, sf)).select("poi_id", "street_count")


@query("nonnegative_weights", """
    SELECT c_custkey, greatest(coalesce(CASE WHEN c_acctbal < 5000 THEN c_acctbal END, 0), 0) AS w FROM customer""", ["w"])
def _(spark, sf):
    balance = F.when(F.col("c_acctbal") < 5000, F.col("c_acctbal"))
    return roles.table(spark, sf, "customer").select("c_custkey", C.weight(balance).alias("w"))


@query("clip_values", """
    SELECT cell_id, CASE WHEN price IS NOT NULL THEN least(greatest(price, 30000), 50000) END AS clipped FROM cells""",
       ["clipped"], roles.CELLS)
def _(spark, sf):
    return roles.cells(spark, sf).select("cell_id", C.clip(F.col("price"), 30000, 50000).alias("clipped"))


@query("slug_names", r"""
    SELECT p_partkey, regexp_replace(regexp_replace(lower(trim('  ' || p_brand || ' -- ' || p_type || '!')),
    '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
def _(spark, sf):
    name = F.concat(F.lit("  "), "p_brand", F.lit(" -- "), "p_type", F.lit("!"))
    return roles.table(spark, sf, "part").select("p_partkey", C.slug(name).alias("slug"))


@query("select_available", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000", ["o_totalprice:2"])
def _(spark, sf):
    rows = roles.table(spark, sf, "orders").where(F.col("o_totalprice") > 300000)
    return C.select_available(rows, ["o_orderkey", "absent", "o_totalprice"])


@query("population_per_service", """
    SELECT cell_id, population / greatest(CAST(lines % 4 AS DOUBLE), 1) AS per_service FROM cells""", ["per_service"], roles.CELLS)
def _(spark, sf):
    rows = roles.cells(spark, sf).withColumn("services", F.col("lines") % 4)
    return rows.select("cell_id", C.population_per_service("population", "services").alias("per_service"))


@query("weighted_columns", "SELECT o_orderkey, (2 * o_totalprice + 3 * o_custkey) / 5 AS v FROM orders", ["v:4"])
def _(spark, sf):
    rows = roles.table(spark, sf, "orders")
    return rows.select("o_orderkey", C.weighted_average([("o_totalprice", 2.0), ("o_custkey", 3.0)]).alias("v"))


@query("drop_debug_columns", "SELECT c_custkey, c_acctbal AS x__score FROM customer")
def _(spark, sf):
    rows = roles.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("x__score"), F.lit(1).alias("x__z"), F.lit(2).alias("x__aligned")
    )
    return C.drop_debug_columns(rows)


@query("flatten_nested", "SELECT event_id, replace(props, ' ', '') AS props FROM events")
def _(spark, sf):
    rows = roles.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return tables.flatten(rows)


@query("concat_tables", """
    SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def _(spark, sf):
    a = roles.table(spark, sf, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    b = roles.table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")
    )
    return C.concat_tables(a, b)


# ------------------------------------------------------------------ reports


@query("score_summary", """
    SELECT l_returnflag, count(l_extendedprice) AS count, avg(l_extendedprice) AS mean,
           quantile_cont(l_extendedprice, 0.5) AS median, stddev_samp(l_extendedprice) AS std,
           min(l_extendedprice) AS min, max(l_extendedprice) AS max
    FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1""", ["mean:3", "median:4", "std:3", "min", "max"])
def _(spark, sf):
    rows = roles.table(spark, sf, "lineitem")
    return report.score_summary(rows, "l_returnflag", "l_extendedprice", filter=("l_linestatus", "F"))


@query("feature_medians", """
    SELECT 'base' AS scenario, l_returnflag, quantile_cont(l_quantity, 0.5) AS l_quantity,
           quantile_cont(l_discount, 0.5) AS l_discount, quantile_cont(l_tax, 0.5) AS l_tax FROM lineitem GROUP BY 2""",
       ["l_quantity", "l_discount", "l_tax"])
def _(spark, sf):
    rows = roles.table(spark, sf, "lineitem")
    return report.feature_medians(rows, "l_returnflag", ["l_quantity", "l_discount", "l_tax", "absent"], "base")


@query("category_shares", """
    SELECT l_returnflag, l_linenumber, count(*) AS count,
           CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS share FROM lineitem GROUP BY 1, 2""",
       ["share"])
def _(spark, sf):
    return report.category_shares(roles.table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber")


@query("weighted_category_shares", """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS weight_sum,
           sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag) AS weight_share
    FROM lineitem GROUP BY 1, 2""", ["weight_sum", "weight_share"])
def _(spark, sf):
    return report.weighted_category_shares(roles.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")


@query("share_of_total", """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n,
           CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS share FROM orders GROUP BY 1, 2""",
       ["share"])
def _(spark, sf):
    counts = roles.table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return report.share_of_group(counts, "o_orderstatus", "n", "share")


@query("exposure", """
    SELECT city, any_value(n) AS n_cells, any_value(tp) AS total_population, any_value(sp) / any_value(tp) AS population_weighted_mean_score,
        any_value(q8) AS score_q80, sum(population) FILTER (WHERE score >= q8) / any_value(tp) AS population_share_at_or_above_q80,
        any_value(q9) AS score_q90, sum(population) FILTER (WHERE score >= q9) / any_value(tp) AS population_share_at_or_above_q90
    FROM scored JOIN (SELECT city, count(*) AS n, sum(population) AS tp, sum(score * population) AS sp,
        quantile_cont(score, 0.8) AS q8, quantile_cont(score, 0.9) AS q9 FROM scored GROUP BY 1) USING (city) GROUP BY city""",
       ["total_population", "population_weighted_mean_score:3", "score_q80:4", "population_share_at_or_above_q80",
        "score_q90:4", "population_share_at_or_above_q90"], roles.ORDERS)
def _(spark, sf):
    return report.exposure(roles.orders(spark, sf), "city", "score", "population")


INEQUALITY = """
steps AS (SELECT city, score, population AS w, sum(1.0::DOUBLE) OVER o AS cn, sum(score) OVER o AS cs,
    sum(population) OVER o AS cw, sum(score * population) OVER o AS cv FROM scored
    WINDOW o AS (PARTITION BY city ORDER BY score, cell_id ROWS UNBOUNDED PRECEDING)),
totals AS (SELECT city, count(*) AS n_cells, sum(population) AS tw, avg(score) AS score_mean, sum(score) AS ts,
    sum(score * population) AS tv, quantile_cont(score, 0.1) AS p1, quantile_cont(score, 0.5) AS p5,
    quantile_cont(score, 0.9) AS p9 FROM scored GROUP BY 1),
ineq AS (SELECT city, any_value(n_cells) AS n_cells, any_value(tw) AS population_total, any_value(score_mean) AS score_mean,
    1 - sum(2 * cs - score) / (any_value(n_cells) * any_value(ts)) AS score_gini_unweighted,
    1 - sum(w * (2 * cv - score * w)) / (any_value(tw) * any_value(tv)) AS score_gini_population_weighted,
    any_value(p1) AS score_p10, any_value(p5) AS score_p50, any_value(p9) AS score_p90,
    any_value(p9) / greatest(any_value(p1), 1e-9) AS score_p90_p10_ratio,
    min(score) FILTER (WHERE cw >= tw * 0.1::DOUBLE) AS score_wp10, min(score) FILTER (WHERE cw >= tw * 0.5::DOUBLE) AS score_wp50,
    min(score) FILTER (WHERE cw >= tw * 0.9::DOUBLE) AS score_wp90
    FROM steps JOIN totals USING (city) GROUP BY city)"""


@query("inequality", "SELECT * FROM ineq", [
    "population_total", "score_mean:3", "score_gini_unweighted", "score_gini_population_weighted", "score_p10:4",
    "score_p50:4", "score_p90:4", "score_p90_p10_ratio", "score_wp10", "score_wp50", "score_wp90",
], roles.ORDERS + "," + INEQUALITY)
def _(spark, sf):
    return report.inequality(roles.orders(spark, sf), "city", "score", "population")


@query("gini", "SELECT city, score_gini_unweighted, score_gini_population_weighted FROM ineq",
       ["score_gini_unweighted", "score_gini_population_weighted"], roles.ORDERS + "," + INEQUALITY)
def _(spark, sf):
    return report.gini(roles.orders(spark, sf), "city", "score", "population")


@query("weighted_quantiles", "SELECT city, score_wp10, score_wp50, score_wp90 FROM ineq",
       ["score_wp10", "score_wp50", "score_wp90"], roles.ORDERS + "," + INEQUALITY)
def _(spark, sf):
    return report.weighted_quantiles(roles.orders(spark, sf), "city", "score", "population", [0.1, 0.5, 0.9])


@query("running_lorenz", """
    SELECT l_returnflag, l_quantity, count(*) AS n, sum(count(*)) OVER o AS cum_n,
           sum(l_quantity * count(*)) OVER o AS cum_value FROM lineitem GROUP BY 1, 2
    WINDOW o AS (PARTITION BY l_returnflag ORDER BY l_quantity ROWS UNBOUNDED PRECEDING)""", ["cum_n", "cum_value"])
def _(spark, sf):
    values = order.value_table(roles.table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    values = values.withColumn("__v", F.col("l_quantity") * F.col("n"))
    return order.running_sums(
        values, ["l_returnflag"], [F.col("l_quantity")], {"cum_n": "n", "cum_value": "__v"}
    ).drop("__v")


@query("weighted_mean", """
    SELECT city, CASE WHEN sum(CASE WHEN price IS NOT NULL THEN population END) > 0
        THEN sum(price * population) / sum(CASE WHEN price IS NOT NULL THEN population END) ELSE avg(price) END AS mean
    FROM cells GROUP BY 1""", ["mean:4"], roles.CELLS)
def _(spark, sf):
    value = report.weighted_mean(F.col("price"), C.weight("population"))
    return roles.cells(spark, sf).groupBy("city").agg(value.alias("mean"))


@query("weighted_mode", """
    SELECT city, unit AS mode, w / t AS mode_weight_share FROM (
        SELECT city, unit, sum(population) AS w, sum(sum(population)) OVER (PARTITION BY city) AS t,
        row_number() OVER (PARTITION BY city ORDER BY sum(population) DESC, unit) AS r FROM cells GROUP BY 1, 2)
    WHERE r = 1""", ["mode_weight_share"], roles.CELLS)
def _(spark, sf):
    return report.weighted_mode(roles.cells(spark, sf), ["city"], "unit", C.weight("population"), "mode")


@query("top_n", """
    SELECT cell_id, city, population, score FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY score DESC, cell_id) AS r
    FROM scored) WHERE r <= 25""", ["population", "score"], roles.ORDERS)
def _(spark, sf):
    return report.top_n(roles.orders(spark, sf), "city", "score", 25, ["cell_id", "city", "population", "score"])


@query("top_fraction_flags", """
    SELECT cell_id, r <= greatest(1, floor(n * 0.05::DOUBLE)) AS flag FROM (SELECT cell_id,
    row_number() OVER (PARTITION BY city ORDER BY score DESC, cell_id) AS r, count(score) OVER (PARTITION BY city) AS n FROM scored)""",
       base=roles.ORDERS)
def _(spark, sf):
    rows = report.top_fraction_rows(roles.orders(spark, sf), ["city"], "score", 0.05, "flag", ["cell_id"])
    return rows.select("cell_id", "flag")


@query("ordered_report", """
    SELECT o_orderpriority, o_orderstatus, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority,
    o_orderstatus) AS place FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    counts = roles.table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return order.number_rows(counts, [], [F.col("n").desc(), F.col("o_orderpriority"), F.col("o_orderstatus")], "place")


# --------------------------------------------------------------- transforms


@query("average_rank", """
    SELECT cell_id, rank() OVER (PARTITION BY city ORDER BY other DESC)
    + (count(*) OVER (PARTITION BY city, other) - 1) / 2.0 AS r FROM scored""", ["r"], roles.ORDERS)
def _(spark, sf):
    rows = order.average_rank(roles.orders(spark, sf), ["city"], "other", "r", descending=True)
    return rows.select("cell_id", "r")


@query("dense_rank_global", "SELECT cell_id, dense_rank() OVER (ORDER BY other DESC) AS r FROM scored", base=roles.ORDERS)
def _(spark, sf):
    return order.dense_rank_desc(roles.orders(spark, sf), "other", "r").select("cell_id", "r")


@query("percent_rank_average", """
    SELECT cell_id, (rank() OVER (PARTITION BY city ORDER BY other) + (count(*) OVER (PARTITION BY city, other) - 1) / 2.0)
    / count(*) OVER (PARTITION BY city) AS p FROM scored""", ["p"], roles.ORDERS)
def _(spark, sf):
    return transform.percent_rank(roles.orders(spark, sf), "city", "other", "p").select("cell_id", "p")


@query("quantile_flag_proxy", """
    SELECT cell_id, p <= 0.2 AS low, (1 - p) * 100 AS proxy FROM (SELECT cell_id, (rank() OVER (PARTITION BY city ORDER BY other)
    + (count(*) OVER (PARTITION BY city, other) - 1) / 2.0) / count(*) OVER (PARTITION BY city) AS p FROM scored)""",
       ["proxy"], roles.ORDERS)
def _(spark, sf):
    rows = transform.percent_rank(roles.orders(spark, sf), "city", "other", "p")
    return rows.select("cell_id", (F.col("p") <= 0.2).alias("low"), ((1 - F.col("p")) * 100).alias("proxy"))


@query("rank_percentile", """
    SELECT cell_id, CASE WHEN n <= 1 THEN 1.0 ELSE 1.0 - (r - 1.0) / (n - 1.0) END AS p FROM (SELECT cell_id,
    CAST(rank() OVER (PARTITION BY city ORDER BY other DESC) + (count(*) OVER (PARTITION BY city, other) - 1) / 2.0 AS DOUBLE) AS r,
    CAST(count(*) OVER (PARTITION BY city) AS DOUBLE) AS n FROM scored)""", ["p"], roles.ORDERS)
def _(spark, sf):
    rows = roles.orders(spark, sf)
    ranked = order.average_rank(rows, ["city"], "other", "r", descending=True)
    sizes = rows.groupBy("city").agg(F.count("other").alias("n"))
    return transform.attach(ranked, sizes, ["city"]).select(
        "cell_id", compare.rank_percentile(F.col("r"), F.col("n")).alias("p")
    )


@query("winsorize_grouped", """
    SELECT cell_id, least(greatest(score, lo), hi) AS score FROM scored JOIN (SELECT city, quantile_cont(score, 0.05) AS lo,
    quantile_cont(score, 0.95) AS hi FROM scored GROUP BY 1) USING (city)""", ["score:4"], roles.ORDERS)
def _(spark, sf):
    return transform.winsorize(roles.orders(spark, sf), ["score"], [0.05, 0.95], "city").select("cell_id", "score")


@query("zscore_global", """
    SELECT cell_id, (score - m) / s AS z FROM scored, (SELECT avg(score) AS m, stddev_pop(score) AS s FROM scored)""",
       ["z"], roles.ORDERS)
def _(spark, sf):
    return transform.zscore(roles.orders(spark, sf), ["score"]).select("cell_id", F.col("score__z").alias("z"))


@query("zscore_grouped_clipped", """
    SELECT cell_id, least(greatest((score - m) / s, -1.5), 1.5) AS z FROM scored JOIN (SELECT city, avg(score) AS m,
    stddev_pop(score) AS s FROM scored GROUP BY 1) USING (city)""", ["z"], roles.ORDERS)
def _(spark, sf):
    rows = transform.zscore(roles.orders(spark, sf), ["score"], "city", 1.5)
    return rows.select("cell_id", F.col("score__z").alias("z"))


@query("minmax_grouped", """
    SELECT cell_id, 100.0 * (least(greatest(score, lo), hi) - lo) / (hi - lo) AS scaled FROM scored JOIN (SELECT city,
    quantile_cont(score, 0.02) AS lo, quantile_cont(score, 0.98) AS hi FROM scored GROUP BY 1) USING (city)""",
       ["scaled"], roles.ORDERS)
def _(spark, sf):
    rows = transform.minmax_0_100(roles.orders(spark, sf), {"score": "scaled"}, 0.02, 0.98, "city")
    return rows.select("cell_id", "scaled")


@query("top_fraction_threshold", """
    SELECT cell_id, t AS threshold, score >= t AS flag FROM scored JOIN (SELECT city, quantile_cont(score, 0.9) AS t
    FROM scored GROUP BY 1) USING (city)""", ["threshold:4"], roles.ORDERS)
def _(spark, sf):
    rows = transform.top_fraction_flag(roles.orders(spark, sf), "city", "score", 0.1, "threshold", "flag")
    return rows.select("cell_id", "threshold", "flag")


@query("lookup_totals", """
    SELECT cell_id, population / t AS share FROM scored JOIN (SELECT city, sum(population) AS t FROM scored GROUP BY 1)
    USING (city)""", ["share:9"], roles.ORDERS)
def _(spark, sf):
    rows = transform.groupwise(
        roles.orders(spark, sf), "city", {"__t": F.sum("population")},
        lambda: {"share": F.col("population") / F.col("__t")},
    )
    return rows.select("cell_id", "share")


# --------------------------------------------------------------- comparison

PAIRED = """
paired AS (SELECT cell_id, city, score AS left_score, spend AS right_score FROM cells),
pranked AS (SELECT *, rank() OVER (PARTITION BY city ORDER BY left_score DESC) + (count(*) OVER (PARTITION BY city, left_score) - 1) / 2.0 AS left_rank_desc,
    rank() OVER (PARTITION BY city ORDER BY right_score DESC) + (count(*) OVER (PARTITION BY city, right_score) - 1) / 2.0 AS right_rank_desc,
    count(*) OVER (PARTITION BY city) AS n,
    row_number() OVER (PARTITION BY city ORDER BY left_score DESC, cell_id) <= greatest(1, floor(count(*) OVER (PARTITION BY city) * 0.1::DOUBLE)) AS lt,
    row_number() OVER (PARTITION BY city ORDER BY right_score DESC, cell_id) <= greatest(1, floor(count(*) OVER (PARTITION BY city) * 0.1::DOUBLE)) AS rt
    FROM paired WHERE right_score IS NOT NULL),
shifted AS (SELECT *, 1 - (left_rank_desc - 1) / (n - 1)::DOUBLE AS left_percentile, 1 - (right_rank_desc - 1) / (n - 1)::DOUBLE AS right_percentile,
    right_score - left_score AS right_minus_left, right_rank_desc - left_rank_desc AS right_rank_minus_left_rank,
    (left_rank_desc - right_rank_desc) / (n - 1)::DOUBLE AS right_percentile_minus_left_percentile,
    CASE WHEN lt AND rt THEN 'stable_top_fraction' WHEN rt THEN 'entered_top_fraction' WHEN lt THEN 'exited_top_fraction'
    ELSE 'stable_non_top_fraction' END AS top_fraction_status FROM pranked),
agreed AS (SELECT city, count(*) AS n_rows, corr(left_score, right_score) AS pearson_corr, corr(left_rank_desc, right_rank_desc) AS spearman_corr,
    0.1::DOUBLE AS top_fraction, CAST(count(*) FILTER (WHERE lt AND rt) AS DOUBLE) / greatest(1, floor(count(*) * 0.1::DOUBLE)) AS top_overlap_share
    FROM shifted GROUP BY 1),
moved AS (SELECT city, 'left' AS left_label, 'right' AS right_label, 0.1::DOUBLE AS top_fraction, count(*) AS n_rows,
    avg(right_minus_left) AS mean_score_shift, quantile_cont(right_minus_left, 0.5) AS median_score_shift,
    avg(abs(right_minus_left)) AS mean_abs_score_shift, quantile_cont(abs(right_minus_left), 0.5) AS median_abs_score_shift,
    quantile_cont(abs(right_minus_left), 0.9) AS p90_abs_score_shift,
    avg(abs(right_rank_minus_left_rank)) AS mean_abs_rank_shift, quantile_cont(abs(CAST(right_rank_minus_left_rank AS DOUBLE)), 0.5) AS median_abs_rank_shift,
    quantile_cont(abs(CAST(right_rank_minus_left_rank AS DOUBLE)), 0.9) AS p90_abs_rank_shift,
    avg(abs(right_percentile_minus_left_percentile)) AS mean_abs_percentile_shift,
    quantile_cont(abs(right_percentile_minus_left_percentile), 0.5) AS median_abs_percentile_shift,
    quantile_cont(abs(right_percentile_minus_left_percentile), 0.9) AS p90_abs_percentile_shift,
    avg(CAST(top_fraction_status = 'stable_top_fraction' AS INT)) AS stable_top_fraction_share,
    avg(CAST(top_fraction_status = 'entered_top_fraction' AS INT)) AS entered_top_fraction_share,
    avg(CAST(top_fraction_status = 'exited_top_fraction' AS INT)) AS exited_top_fraction_share,
    avg(CAST(top_fraction_status IN ('entered_top_fraction', 'exited_top_fraction') AS INT)) AS top_fraction_reclassification_share
    FROM shifted GROUP BY 1)"""
BASE_PAIRED = roles.CELLS + "," + PAIRED
SHIFT_DOUBLES = [
    "top_fraction", "mean_score_shift:3", "median_score_shift:3", "mean_abs_score_shift:3", "median_abs_score_shift:3",
    "p90_abs_score_shift:3", "mean_abs_rank_shift", "median_abs_rank_shift", "p90_abs_rank_shift",
    "mean_abs_percentile_shift", "median_abs_percentile_shift", "p90_abs_percentile_shift", "stable_top_fraction_share",
    "entered_top_fraction_share", "exited_top_fraction_share", "top_fraction_reclassification_share",
]


def _two_sides(spark, sf):
    rows = roles.keep(roles.cells(spark, sf).select("cell_id", "city", "score", "spend"))
    right = rows.where(F.col("spend").isNotNull()).select("cell_id", F.col("spend").alias("other"))
    return rows.select("cell_id", "city", "score"), right


@query("score_join", "SELECT cell_id, city, left_score, right_score FROM paired WHERE right_score IS NOT NULL",
       ["left_score", "right_score"], BASE_PAIRED)
def _(spark, sf):
    left, right = _two_sides(spark, sf)
    return compare.join_scores(left, right, ["cell_id"], "score", "other")


@query("comparison_rows", """
    SELECT cell_id, city, left_score, right_score, left_rank_desc, right_rank_desc, left_percentile, right_percentile,
    right_minus_left, right_rank_minus_left_rank, right_percentile_minus_left_percentile, abs(right_minus_left) AS abs_score_shift,
    abs(right_rank_minus_left_rank) AS abs_rank_shift, abs(right_percentile_minus_left_percentile) AS abs_percentile_shift,
    lt AS left_top_fraction_flag, rt AS right_top_fraction_flag, top_fraction_status FROM shifted""", [
        "left_score", "right_score", "left_rank_desc", "right_rank_desc", "left_percentile", "right_percentile",
        "right_minus_left:4", "right_rank_minus_left_rank", "right_percentile_minus_left_percentile",
        "abs_score_shift:4", "abs_rank_shift", "abs_percentile_shift"], BASE_PAIRED)
def _(spark, sf):
    left, right = _two_sides(spark, sf)
    return compare.comparison_columns(
        compare.join_scores(left, right, ["cell_id"], "score", "other"), "city", "left", "right"
    )


@query("alignment", "SELECT * FROM agreed", ["pearson_corr", "spearman_corr", "top_fraction", "top_overlap_share"], BASE_PAIRED)
def _(spark, sf):
    return compare.alignment(roles.cells(spark, sf), "city", "score", "spend")


@query("comparison_shift", "SELECT * FROM moved", SHIFT_DOUBLES, BASE_PAIRED)
def _(spark, sf):
    left, right = _two_sides(spark, sf)
    rows = compare.join_scores(left, right, ["cell_id"], "score", "other")
    merged = roles.keep(compare.comparison_columns(rows, "city", "left", "right"))
    return compare.comparison_shift(merged, "city", "left", "right")


@query("compare_scores", """
    SELECT moved.* EXCLUDE (n_rows), agreed.n_rows, pearson_corr, spearman_corr, top_overlap_share
    FROM moved JOIN agreed USING (city)""",
       [*SHIFT_DOUBLES, "pearson_corr", "spearman_corr", "top_overlap_share"], BASE_PAIRED)
def _(spark, sf):
    left, right = _two_sides(spark, sf)
    return compare.compare_scores(left, right, ["cell_id"], "city", "score", "other")[0]


# ----------------------------------------------------------------- contrast


def _unpivot(features: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT *, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM cells" for f in features
    )


LONG = f"long AS ({_unpivot(FEATURES)})"


@query("binary_contrast", """
    SELECT city, 'hotspot' AS binary_col, 'high_high' AS target_value, 'other' AS reference_value, feature, target_n, reference_n,
        CAST(t_rows AS DOUBLE) / n AS target_share, tm AS target_mean, rm AS reference_mean, tm - rm AS mean_difference,
        td AS target_median, rd AS reference_median, td - rd AS median_difference, d AS standardized_mean_diff,
        abs(d) AS abs_standardized_mean_diff, CASE WHEN d > 0 THEN 'target_higher' WHEN d < 0 THEN 'target_lower' ELSE 'no_difference' END AS contrast_direction,
        dense_rank() OVER (PARTITION BY city ORDER BY abs(d) DESC) AS contrast_rank
    FROM (SELECT *, CASE WHEN pooled > 0 THEN (tm - rm) / pooled ELSE 0 END AS d FROM (
        SELECT city, feature, count(v) FILTER (WHERE t) AS target_n, count(v) FILTER (WHERE NOT t) AS reference_n,
        count(*) FILTER (WHERE t) AS t_rows, count(*) AS n, avg(v) FILTER (WHERE t) AS tm, avg(v) FILTER (WHERE NOT t) AS rm,
        quantile_cont(v, 0.5) FILTER (WHERE t) AS td, quantile_cont(v, 0.5) FILTER (WHERE NOT t) AS rd,
        sqrt((stddev_pop(v) FILTER (WHERE t) ^ 2 + stddev_pop(v) FILTER (WHERE NOT t) ^ 2) / 2) AS pooled
        FROM (SELECT *, coalesce(hotspot = 'high_high', false) AS t FROM long) GROUP BY 1, 2))""", [
            "target_share", "target_mean:4", "reference_mean:4", "mean_difference:4", "target_median:4", "reference_median:4",
            "median_difference:4", "standardized_mean_diff", "abs_standardized_mean_diff"], roles.CELLS + "," + LONG)
def _(spark, sf):
    return contrast.binary_contrast(roles.cells(spark, sf), "city", "hotspot", "high_high", FEATURES)


@query("binary_contrast_pair", """
    SELECT city, feature, target_n, reference_n, tm - rm AS mean_difference FROM (
        SELECT city, feature, count(v) FILTER (WHERE hotspot = 'high_high') AS target_n, count(v) FILTER (WHERE hotspot = 'low_low') AS reference_n,
        avg(v) FILTER (WHERE hotspot = 'high_high') AS tm, avg(v) FILTER (WHERE hotspot = 'low_low') AS rm FROM long GROUP BY 1, 2)
    WHERE target_n > 0 AND reference_n > 0""", ["mean_difference:4"], roles.CELLS + "," + LONG)
def _(spark, sf):
    rows = contrast.binary_contrast(roles.cells(spark, sf), "city", "hotspot", "high_high", FEATURES, "low_low")
    return rows.select("city", "feature", "target_n", "reference_n", "mean_difference")


@query("category_profiles", """
    SELECT city, hotspot, feature, group_n, category_n, CAST(category_n AS DOUBLE) / group_n AS category_share, cm AS category_mean,
        cd AS category_median, gm AS group_mean, gd AS group_median, cm - gm AS mean_difference_from_group,
        cd - gd AS median_difference_from_group, d AS standardized_profile_diff, abs(d) AS abs_standardized_profile_diff,
        CASE WHEN d > 0 THEN 'above_group_mean' WHEN d < 0 THEN 'below_group_mean' ELSE 'at_group_mean' END AS profile_direction,
        dense_rank() OVER (PARTITION BY city, hotspot ORDER BY abs(d) DESC) AS profile_rank
    FROM (SELECT *, CASE WHEN gs > 0 THEN (cm - gm) / gs ELSE 0 END AS d FROM (
        SELECT city, coalesce(hotspot, 'missing') AS hotspot, feature, count(*) AS category_n, avg(v) AS cm, quantile_cont(v, 0.5) AS cd,
        count(v) AS nv FROM long GROUP BY 1, 2, 3) JOIN (
        SELECT city, feature, count(*) AS group_n, avg(v) AS gm, quantile_cont(v, 0.5) AS gd, stddev_pop(v) AS gs FROM long GROUP BY 1, 2)
        USING (city, feature) WHERE nv > 0)""", [
            "category_share", "category_mean:4", "category_median:4", "group_mean:4", "group_median:4",
            "mean_difference_from_group:4", "median_difference_from_group:4", "standardized_profile_diff",
            "abs_standardized_profile_diff"], roles.CELLS + "," + LONG)
def _(spark, sf):
    return contrast.category_profiles(roles.cells(spark, sf), "city", "hotspot", FEATURES)


# --------------------------------------------------------------- validation

VALIDATED = """
vlong AS (SELECT cell_id, city, 'score' AS score_column, score AS s, returned AS e FROM cells UNION ALL
    SELECT cell_id, city, 'spend', spend, returned FROM cells),
vrank AS (SELECT *, rank() OVER (PARTITION BY city, score_column ORDER BY s) + (count(*) OVER (PARTITION BY city, score_column, s) - 1) / 2.0 AS rs,
    rank() OVER (PARTITION BY city, score_column ORDER BY e) + (count(*) OVER (PARTITION BY city, score_column, e) - 1) / 2.0 AS re,
    row_number() OVER (PARTITION BY city, score_column ORDER BY s DESC, cell_id) AS top, row_number() OVER (PARTITION BY city, score_column ORDER BY s, cell_id) AS low,
    greatest(1, floor(count(*) OVER (PARTITION BY city, score_column) * 0.1::DOUBLE)) AS c FROM vlong WHERE s IS NOT NULL AND e IS NOT NULL),
vsum AS (SELECT city, score_column, count(*) AS n_rows, corr(s, e) AS pearson_corr, corr(rs, re) AS spearman_corr,
    avg(e) FILTER (WHERE top <= c) AS t, avg(e) FILTER (WHERE low <= c) AS b, stddev_pop(e) AS sd FROM vrank GROUP BY 1, 2),
validated AS (SELECT city, score_column, 'returned' AS external_column, n_rows, 'negative' AS expected_relation, pearson_corr, spearman_corr,
    -pearson_corr AS expected_signed_pearson, -spearman_corr AS expected_signed_spearman, 0.1::DOUBLE AS top_fraction,
    t AS top_score_external_mean, b AS bottom_score_external_mean, t - b AS top_minus_bottom_external_mean,
    b - t AS bottom_minus_top_external_mean, CASE WHEN abs(b) > 1e-9 THEN t / b END AS top_over_bottom_external_ratio,
    CASE WHEN sd > 1e-9 THEN (t - b) / sd END AS standardized_top_minus_bottom_gap FROM vsum)"""


@query("validate_external", "SELECT * FROM validated", [
    "pearson_corr", "spearman_corr", "expected_signed_pearson", "expected_signed_spearman", "top_fraction",
    "top_score_external_mean", "bottom_score_external_mean", "top_minus_bottom_external_mean",
    "bottom_minus_top_external_mean", "top_over_bottom_external_ratio", "standardized_top_minus_bottom_gap",
], roles.CELLS + "," + VALIDATED)
def _(spark, sf):
    return validate.validate_external(roles.cells(spark, sf), "city", "returned", ["score", "spend"])


@query("validation_findings", """
    SELECT (SELECT count(*) FROM validated) AS n_rows,
        (SELECT city FROM validated WHERE score_column = 'score' ORDER BY expected_signed_spearman DESC, city LIMIT 1) AS best_for_score,
        (SELECT city FROM validated WHERE score_column = 'spend' ORDER BY expected_signed_spearman DESC, city LIMIT 1) AS best_for_spend,
        (SELECT city || '/' || score_column FROM validated ORDER BY expected_signed_spearman DESC LIMIT 1) AS strongest,
        (SELECT city || '/' || score_column FROM validated ORDER BY expected_signed_spearman LIMIT 1) AS weakest,
        (SELECT string_agg(DISTINCT city, ',' ORDER BY city) FROM validated) AS groups""",
       base=roles.CELLS + "," + VALIDATED)
def _(spark, sf):
    summary = roles.keep(validate.validate_external(roles.cells(spark, sf), "city", "returned", ["score", "spend"]))
    found = validate.validation_findings(summary, "city")

    def place(side: str):
        row = F.col(f"overall.{side}_expected_alignment")
        return F.concat_ws("/", row["city"], row["score_column"])

    return found.select(
        "n_rows",
        F.col("strongest_by_score")["score"]["best_group"].alias("best_for_score"),
        F.col("strongest_by_score")["spend"]["best_group"].alias("best_for_spend"),
        place("strongest").alias("strongest"), place("weakest").alias("weakest"),
        F.concat_ws(",", "groups").alias("groups"),
    )

"""Benchmark leaders, average ranks and the nested findings documents.

The inputs are summary tables: a few rows per city, protocol or category.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import filter_scenario
from tessera.operators.report import share_of_group
from tessera.runtime import keep

# The compared metrics and which end of each is better.
DIRECTIONS = (
    ("rmse", "min"),
    ("mae", "min"),
    ("spearman_corr", "max"),
    ("roc_auc", "max"),
    ("average_precision", "max"),
    ("balanced_accuracy", "max"),
)
POOLED = "pooled_random"


def model_ranks(metrics: DataFrame) -> DataFrame:
    """Rank of each model per protocol and metric; ties go by model name."""
    direction = F.coalesce(*[F.when(F.col("metric") == m, F.lit(d)) for m, d in DIRECTIONS])
    rows = metrics.withColumn("direction", direction).where(
        F.col("direction").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")
    )
    signed = F.when(F.col("direction") == "min", F.col("value")).otherwise(-F.col("value"))
    order = Window.partitionBy("protocol", "metric").orderBy(signed, "model")
    return rows.withColumn("rank", F.row_number().over(order)).select(
        "protocol", "metric", "model", "value", "direction", "rank"
    )


def benchmark_leaders(metrics: DataFrame) -> DataFrame:
    return model_ranks(metrics).where("rank = 1").select(
        "protocol", "metric", F.col("model").alias("winner_model"), "value", "direction"
    )


def average_ranks(metrics: DataFrame) -> DataFrame:
    """Mean rank of each model per metric over all, transfer and pooled protocols."""
    pooled = F.col("protocol") == POOLED
    scopes = F.when(pooled, F.array(F.lit("all_protocols"), F.lit("pooled_only"))).otherwise(
        F.array(F.lit("all_protocols"), F.lit("transfer_only"))
    )
    return model_ranks(metrics).withColumn("scope", F.explode(scopes)).groupBy("scope", "metric", "model").agg(
        F.avg("rank").alias("mean_rank")
    )


def _entries(key: str, value: Column) -> Column:
    """Aggregate: the rows of a small table as a map ordered by key."""
    pairs = F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v")))
    ordered = F.array_sort(pairs, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return F.map_from_entries(ordered)


def _as_map(df: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    return df.agg(_entries(key, value).alias(out))


def _map_per(df: DataFrame, by: str, key: str, value: Column, out: str) -> DataFrame:
    return df.groupBy(by).agg(_entries(key, value).alias(out))


def _beside(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # each part is one row
    return out


def rank_lists(ranks: DataFrame) -> DataFrame:
    """Per scope: metric -> models ordered by mean rank."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("mean_rank", "model"))),
        lambda e: F.struct(e["model"].alias("model"), e["mean_rank"].alias("mean_rank")),
    )
    per_metric = ranks.groupBy("scope", "metric").agg(ordered.alias("models"))
    return _map_per(per_metric, "scope", "metric", F.col("models"), "ranks")


def benchmark_summary(metrics: DataFrame) -> DataFrame:
    """One nested row: leaders, winners by protocol, average ranks by scope."""
    leaders = keep(benchmark_leaders(metrics))
    win = F.struct("winner_model", "value", "direction")
    by_protocol = _map_per(leaders, "protocol", "metric", win, "winners")
    listed = F.array_sort(F.collect_list(F.struct("protocol", "metric", "winner_model", "value", "direction")))
    return _beside(
        leaders.agg(listed.alias("leaders")),
        _as_map(by_protocol, "protocol", F.col("winners"), "by_protocol"),
        _as_map(rank_lists(average_ranks(metrics)), "scope", F.col("ranks"), "average_ranks"),
    )


def hardest_holdouts(metrics: DataFrame) -> DataFrame:
    """One row: the hold-outs whose best RMSE is largest and whose best average
    precision is smallest; ties go by protocol."""
    held = benchmark_leaders(metrics).where(F.col("protocol") != POOLED)

    def record(name: str) -> Column:
        return F.struct("protocol", F.col("value").alias(name), "winner_model")

    rmse, ap = F.col("metric") == "rmse", F.col("metric") == "average_precision"
    return held.agg(
        F.min_by(F.when(rmse, record("best_rmse")), F.when(rmse, F.struct(-F.col("value"), F.col("protocol")))).alias("rmse"),
        F.min_by(
            F.when(ap, record("best_average_precision")), F.when(ap, F.struct(F.col("value"), F.col("protocol")))
        ).alias("average_precision"),
    )


def holdout_recommendations(metrics: DataFrame) -> DataFrame:
    """Per hold-out: best model for regression, ranking and screening."""
    held = benchmark_leaders(metrics).where(F.col("protocol") != POOLED)
    win = F.struct("winner_model", "value", "direction")

    def of(metric: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, win))

    return held.groupBy("protocol").agg(
        of("rmse").alias("regression_recommendation"),
        of("spearman_corr").alias("ranking_recommendation"),
        of("average_precision").alias("screening_recommendation"),
    )


def baseline_wins(metrics: DataFrame, baseline: str = "linear_baseline") -> DataFrame:
    return benchmark_leaders(metrics).where(F.col("winner_model") == baseline)


def benchmark_findings(metrics: DataFrame, baseline: str = "linear_baseline") -> DataFrame:
    """One nested row with the whole benchmark story."""
    leaders = keep(benchmark_leaders(metrics))
    win = F.struct("winner_model", "value", "direction")
    winners = keep(_map_per(leaders, "protocol", "metric", win, "winners"))
    ranks = keep(rank_lists(average_ranks(metrics)))
    empty = F.create_map().cast(ranks.schema["ranks"].dataType)

    def scope(name: str) -> Column:
        return F.coalesce(F.max_by(F.col("ranks"), F.when(F.col("scope") == name, 1)), empty)

    wins = F.struct("protocol", "metric", "winner_model", "value", "direction")
    recommendations = holdout_recommendations(metrics)
    return _beside(
        metrics.agg(
            F.count_distinct("model").alias("n_models"),
            F.count_distinct("protocol").alias("n_protocols"),
            F.array_sort(F.collect_set("protocol")).alias("protocols"),
        ),
        winners.agg(F.max_by("winners", F.when(F.col("protocol") == POOLED, 1)).alias("pooled_random")),
        _as_map(winners.where(F.col("protocol") != POOLED), "protocol", F.col("winners"), "holdout_protocols"),
        ranks.agg(
            scope("transfer_only").alias("transfer_only_average_ranks"),
            scope("all_protocols").alias("all_protocol_average_ranks"),
        ),
        hardest_holdouts(metrics).select(F.struct("rmse", "average_precision").alias("hardest_holdouts")),
        leaders.where(F.col("winner_model") == baseline).agg(F.struct(
            F.count(F.lit(1)).alias("n_metric_wins"), F.array_sort(F.collect_list(wins)).alias("wins")
        ).alias("baseline_retained_value")),
        _as_map(
            recommendations, "protocol",
            F.struct("regression_recommendation", "ranking_recommendation", "screening_recommendation"),
            "per_holdout_recommendations",
        ),
    )


# ---------------------------------------------------------------- core findings


def ranking_rows(df: DataFrame, value: str, by: str = "city", within: Sequence[str] = ()) -> DataFrame:
    """Rows ordered by value, largest first, with the gap from top to bottom."""
    keys = list(within)
    place = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), F.col(by))
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.when(F.count(F.lit(1)).over(whole) >= 2, F.first(value).over(whole) - F.last(value).over(whole))
    return df.select(
        *keys, F.col(by).cast("string").alias(by), F.col(value).alias("value"),
        F.row_number().over(place).alias("rank"), gap.alias("top_minus_bottom_gap"),
    )


def ranking(df: DataFrame, value: str, out: str, by: str = "city", within: str | None = None) -> DataFrame:
    """The ranking of a summary table as one nested value."""
    keys = [within] if within else []
    rows = ranking_rows(df, value, by, keys)
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", by, "value"))),
        lambda e: F.struct(e[by].alias(by), e["value"].alias("value"), e["rank"].alias("rank")),
    )
    block = F.struct(
        F.lit(value).alias("metric"), listed.alias("ranking"),
        F.first("top_minus_bottom_gap").alias("top_minus_bottom_gap"),
    ).alias(out)
    return rows.groupBy(within).agg(block) if within else rows.agg(block)


def top_categories(df: DataFrame, category: str, share: str, n: int = 2, by: str = "city") -> DataFrame:
    """The ``n`` largest categories of each city with their rank."""
    place = Window.partitionBy(by).orderBy(F.col(share).desc_nulls_last(), F.col(category))
    return df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n).select(
        by, F.col(category).cast("string").alias("category"), share, "rank"
    )


_UNIT_COLUMNS = (
    "district_priority_rank", "district_priority_class", "district_priority_metric_count",
    "population_weighted_mean_score", "citywide_q90_population_share", "hotspot_population_share",
    "hotspot_dominant_dimension",
)


def top_units(
    df: DataFrame, n: int = 3, only_high_priority: bool = False, by: str = "city", name: str = "admin2_name"
) -> DataFrame:
    """The first ``n`` ranked units of each city."""
    rows = df.where(F.col("district_priority_rank").isNotNull())
    if only_high_priority:
        rows = rows.where(F.col("district_priority_class") == "high_priority")
    place = Window.partitionBy(by).orderBy("district_priority_rank", F.col("population_total").desc_nulls_last(), name)
    return rows.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= n).select(
        by, F.col(name).cast("string").alias("admin_unit"), *_UNIT_COLUMNS, F.col("__r").alias("position")
    )


def class_population_share(df: DataFrame, by: str = "city", klass: str = "district_priority_class") -> DataFrame:
    """Share of a city's population living in each class of unit."""
    sums = df.groupBy(by, klass).agg(F.sum("population_total").alias("population_total_by_class"))
    return share_of_group(sums, by, "population_total_by_class", "population_share")


def order_stability(df: DataFrame, value: str, primary: str, sensitivity: str, by: str = "city") -> DataFrame:
    """Whether both scenarios put the same city first."""
    first = F.struct(F.coalesce(-F.col(value), F.lit(float("inf"))), F.col(by))
    return df.agg((
        F.min_by(by, F.when(F.col("scenario") == primary, first))
        .eqNullSafe(F.min_by(by, F.when(F.col("scenario") == sensitivity, first)))
    ).alias(value))


def _nested_list(df: DataFrame, by: str, order: str, columns: Sequence[str], out: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *columns)))
    return df.groupBy(by).agg(F.transform(
        listed, lambda e: F.struct(*[e[c].alias(c) for c in columns])
    ).alias(out))


def _row_block(df: DataFrame, by: str, out: str) -> DataFrame:
    return df.select(F.col(by).cast("string").alias(by), F.struct(*[c for c in df.columns if c != by]).alias(out))


_SENSITIVITY = (
    ("mean_score", "grid_size_score_summary", "mean"),
    ("population_share_at_or_above_q90", "grid_size_population_exposure", "population_share_at_or_above_q90"),
    ("score_gini_population_weighted", "grid_size_inequality_summary", "score_gini_population_weighted"),
)


def city_sensitivity(tables: Mapping[str, DataFrame], primary: str, sensitivity: str, by: str = "city") -> DataFrame:
    """Per city: three measures under both scenarios and their difference."""
    out = None
    for name, table, value in _SENSITIVITY:
        def of(scenario: str, value: str = value) -> Column:
            return F.max(F.when(F.col("scenario") == scenario, F.col(value)))

        block = F.struct(
            of(primary).alias(primary), of(sensitivity).alias(sensitivity),
            (of(sensitivity) - of(primary)).alias(f"delta_{sensitivity}_minus_{primary}"),
        ).alias(name)
        part = tables[table].groupBy(F.col(by).cast("string").alias(by)).agg(block)
        out = part if out is None else out.join(part, by, "left")
    return out.select(by, F.struct(*[n for n, _, _ in _SENSITIVITY]).alias("sensitivity"))


def city_blocks(
    tables: Mapping[str, DataFrame], primary: str | None, sensitivity: str | None, by: str = "city"
) -> DataFrame:
    """One nested row per city, from twelve summary tables."""
    t = {k: filter_scenario(v, primary) for k, v in tables.items() if not k.startswith("grid_size_")}
    out = _row_block(t["city_score_summary"], by, "score")
    for name, block in (
        ("population_exposure", "exposure"), ("inequality_summary", "inequality"),
        ("absolute_relative_alignment", "alignment"), ("relative_shift_summary", "shift"),
    ):
        out = out.join(_row_block(t[name], by, block), by, "left")
    for name, category, n, block in (
        ("hotspot_dominant_population_share", "dominant_dimension", 2, "dominant_dimension_by_population"),
        ("hotspot_priority_population_share", "priority_quadrant", 2, "priority_quadrant_by_population"),
        ("hotspot_typology_population_share", "hotspot_typology", 3, "top_typologies_by_population"),
    ):
        top = top_categories(t[name], category, "weight_share", n, by)
        out = out.join(_nested_list(top, by, "rank", ["category", "weight_share", "rank"], block), by, "left")
    if "admin_summary" in t:
        units = t["admin_summary"]
        columns = ["admin_unit", *_UNIT_COLUMNS]
        out = out.join(_nested_list(top_units(units, 3, False, by), by, "position", columns, "top_priority_units"), by, "left")
        out = out.join(_nested_list(top_units(units, 5, True, by), by, "position", columns, "high_priority_units"), by, "left")
        shares = _map_per(class_population_share(units, by), by, "district_priority_class",
                          F.col("population_share"), "priority_class_population_share")
        districts = ["top_priority_units", "high_priority_units", "priority_class_population_share"]
        out = out.join(shares, by, "left")
    else:
        districts = []
    blocks = [
        by,
        F.struct("score", "exposure", "inequality").alias("primary_summary"),
        F.struct(
            "dominant_dimension_by_population", "priority_quadrant_by_population", "top_typologies_by_population"
        ).alias("hotspots"),
        F.struct("alignment", "shift").alias("absolute_vs_relative"),
    ]
    if districts:
        blocks.append(F.struct(*districts).alias("districts"))
    if primary and sensitivity:
        out = out.join(city_sensitivity(tables, primary, sensitivity, by), by, "left")
        blocks.append("sensitivity")
    return out.select(*blocks)


def claims(blocks: DataFrame, t: Mapping[str, DataFrame], primary: str | None, by: str = "city") -> DataFrame:
    """Claims as rows ``claim_id, topic, city, scenario, details`` where
    ``details`` is JSON."""
    scenario = F.lit(primary).cast("string")

    def row(id: Column, topic: str, city: Column, details: Column) -> list[Column]:
        return [
            id.alias("claim_id"), F.lit(topic).alias("topic"), city.cast("string").alias("city"),
            scenario.alias("scenario"), F.to_json(details).alias("details"),
        ]

    out = None
    for id, table, value in (
        ("primary_mean_score_order", "city_score_summary", "mean"),
        ("primary_q90_exposure_order", "population_exposure", "population_share_at_or_above_q90"),
        ("primary_weighted_gini_order", "inequality_summary", "score_gini_population_weighted"),
    ):
        ranked = ranking(filter_scenario(t[table], primary), value, "r", by)
        part = ranked.select(*row(F.lit(id), "cross_city_ordering", F.lit(None), F.col("r")))
        out = part if out is None else out.unionByName(part)
    name = F.replace(F.lower(F.col(by)), F.lit(" "), F.lit("_"))

    def per_city(prefix: str, topic: str, details: Column, where: Column) -> DataFrame:
        return blocks.where(where).select(*row(F.concat(F.lit(f"{prefix}__"), name), topic, F.col(by), details))

    def first(path: str) -> Column:
        return F.get(F.col(path), F.lit(0))

    for prefix, topic, path in (
        ("hotspot_population_dominant_dimension", "hotspot_mechanism", "hotspots.dominant_dimension_by_population"),
        ("hotspot_population_top_typology", "hotspot_typology", "hotspots.top_typologies_by_population"),
    ):
        top = first(path)
        out = out.unionByName(per_city(
            prefix, topic, F.struct(top["category"].alias("category"), top["weight_share"].alias("weight_share")),
            top.isNotNull(),
        ))
    alignment, shift = F.col("absolute_vs_relative.alignment"), F.col("absolute_vs_relative.shift")
    out = out.unionByName(per_city(
        "absolute_relative_reranking", "robustness_absolute_vs_relative",
        F.struct(
            alignment["pearson_corr"].alias("pearson_corr"),
            alignment["top_overlap_share"].alias("top_overlap_share"),
            (1.0 - alignment["top_overlap_share"]).alias("top_fraction_reclassification_within_top_sets"),
            shift["mean_abs_percentile_shift"].alias("mean_abs_percentile_shift"),
            shift["p90_abs_percentile_shift"].alias("p90_abs_percentile_shift"),
        ),
        alignment.isNotNull() & shift.isNotNull(),
    ))
    if "districts" in blocks.columns:
        unit = first("districts.top_priority_units")
        parts = ["admin_unit", *[c for c in _UNIT_COLUMNS if c != "district_priority_rank"]]
        out = out.unionByName(per_city(
            "top_priority_admin_unit", "district_targeting",
            F.struct(*[unit[c].alias(c) for c in parts]), unit.isNotNull(),
        ))
        share = F.col("districts.priority_class_population_share")["high_priority"]
        out = out.unionByName(per_city(
            "high_priority_district_population_share", "district_targeting",
            F.struct(F.lit("high_priority").alias("district_priority_class"), share.alias("population_share")),
            share.isNotNull(),
        ))
    return out


def core_findings(
    tables: Mapping[str, DataFrame], primary: str | None = None, sensitivity: str | None = None, by: str = "city"
) -> DataFrame:
    """One nested row: cross-city rankings, a block per city, order stability
    between the scenarios, rankings per scenario and the list of claims."""
    blocks = keep(city_blocks(tables, primary, sensitivity, by))
    t = {k: filter_scenario(v, primary) for k, v in tables.items() if not k.startswith("grid_size_")}
    rankings = [
        ranking(t["city_score_summary"], "mean", "mean_score", by),
        ranking(t["population_exposure"], "population_weighted_mean_score", "population_weighted_mean_score", by),
        ranking(t["population_exposure"], "population_share_at_or_above_q90", "population_share_at_or_above_q90", by),
        ranking(t["inequality_summary"], "score_gini_population_weighted", "score_gini_population_weighted", by),
    ]
    cross = _beside(*rankings).select(F.struct("*").alias("cross_city"))
    listed = claims(blocks, tables, primary, by)
    parts = [
        cross,
        _as_map(blocks, by, F.struct(*[c for c in blocks.columns if c != by]), "cities"),
    ]
    if primary and sensitivity:
        stable = _beside(*[
            order_stability(tables[table], value, primary, sensitivity, by).withColumnRenamed(value, name)
            for name, table, value in _SENSITIVITY
        ]).select(F.struct("*").alias("order_stability"))
        per_scenario = [
            _as_map(ranking(tables[table], value, "r", by, "scenario"), "scenario", F.col("r"), out)
            for (_, table, value), out in zip(
                _SENSITIVITY, ("score_rankings", "exposure_rankings", "inequality_rankings")
            )
        ]
        stable = keep(stable)
        parts.append(_beside(stable, *per_scenario).select(F.struct("*").alias("sensitivity")))
        listed = listed.unionByName(stable.select(
            F.lit("grid_size_order_stability").alias("claim_id"), F.lit("sensitivity").alias("topic"),
            F.lit(None).cast("string").alias("city"), F.lit(primary).alias("scenario"),
            F.to_json(F.struct(
                F.lit(primary).alias("primary_scenario"), F.lit(sensitivity).alias("sensitivity_scenario"),
                "order_stability",
            )).alias("details"),
        ))
    order = F.array_sort(F.collect_list(F.struct("claim_id", "topic", "city", "scenario", "details")))
    parts.append(listed.agg(order.alias("claims")))
    return _beside(*parts).select(
        F.lit(primary).cast("string").alias("primary_scenario"),
        F.lit(sensitivity).cast("string").alias("sensitivity_scenario"), "*",
    )

"""Summaries and priority classes of administrative units."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import numeric, weight
from tessera.operators.order import number_rows
from tessera.operators.quantiles import quantile_table
from tessera.operators.report import weighted_mean, weighted_mode
from tessera.operators.transform import top_fraction_flag
from tessera.runtime import attach, has_hot_group, keep, require, require_columns

_METRICS = ("population_weighted_mean_score", "citywide_q90_population_share", "hotspot_population_share")


def _left_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be NULL, keeping the left key columns."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys])
    return left.join(renamed, on, "left").drop(*[f"__k_{k}" for k in keys])


def summarize_units(
    df: DataFrame,
    by: str,
    country: str,
    name: str,
    id: str,
    score: str,
    population: str,
    iso: str | None = None,
    hotspot: str | None = None,
    hotspot_value: str = "high_high",
    dominant: str | None = None,
    priority: str | None = None,
    top_fraction: float = 0.1,
    priority_fraction: float = 0.25,
    min_cells: int = 10,
    min_share: float = 0.01,
) -> DataFrame:
    require_columns(df, [by, country, name, id, score, population])
    require(0 < top_fraction < 1, "top_fraction must be in (0, 1)")
    require(0 < priority_fraction <= 1, "priority_fraction must be in (0, 1]")
    keys = [by, country, name, id]
    iso_name = iso or "_admin_iso_placeholder"
    if iso and iso in df.columns:
        rows = df
    else:
        rows = df.withColumn(iso_name, F.lit(None).cast("string"))
    keys.append(iso_name)
    is_hot = F.lit(False)
    if hotspot and hotspot in df.columns:
        is_hot = F.coalesce(F.col(hotspot).cast("string"), F.lit("missing")) == str(hotspot_value)
    labels = [c for c in (dominant, priority) if c and c in df.columns]
    rows = rows.select(
        *keys, *labels, numeric(score).alias("__s"), weight(population).alias("__p"), is_hot.alias("__hot")
    )
    rows = keep(top_fraction_flag(rows, by, "__s", top_fraction, "__cut", "__top"))
    city = rows.groupBy(by).agg(F.sum("__p").alias("__city_p"), F.count(F.lit(1)).alias("__city_n"))

    def total(flag: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, F.col("__p"))), F.lit(0.0))

    hot, top, n = F.col("__hot"), F.col("__top"), F.count(F.lit(1))
    units = rows.groupBy(*keys).agg(
        n.alias("n_cells"),
        F.sum("__p").alias("population_total"),
        F.avg("__s").alias("mean_score"),
        weighted_mean(F.col("__s"), F.col("__p")).alias("population_weighted_mean_score"),
        F.first("__cut").alias("city_score_top_fraction_threshold"),
        total(top).alias("__top_p"),
        (F.count_if(top) / n).alias("citywide_q90_cell_share"),
        total(hot).alias("hotspot_population_total"),
        F.count_if(hot).alias("hotspot_cell_count"),
        (F.count_if(hot) / n).alias("hotspot_cell_share"),
    )
    medians = quantile_table(rows, keys, ["__s"], [0.5])
    units = _left_null_safe(units, medians.select(*keys, F.col("__s")[0].alias("median_score")), keys)
    units = _left_null_safe(units, city, [by])
    hot_rows = rows.where(hot)
    for label, out in ((dominant, "hotspot_dominant_dimension"), (priority, "hotspot_priority_mode")):
        if label in labels:
            modes = weighted_mode(hot_rows, keys, label, F.col("__p"), out)
            units = _left_null_safe(units, modes, keys)
            units = units.withColumn(out, F.coalesce(out, F.lit("missing")))
        else:
            units = units.withColumns({
                out: F.lit("missing"), f"{out}_weight_share": F.lit(None).cast("double")
            })

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    units = units.withColumns({
        "city_cell_share": F.col("n_cells") / F.greatest(F.col("__city_n"), F.lit(1)),
        "city_population_share": share("population_total", "__city_p"),
        "citywide_q90_population_share": share("__top_p", "population_total"),
        "hotspot_population_share": share("hotspot_population_total", "population_total"),
    })
    units = keep(units.withColumn(
        "eligible_priority_flag",
        (F.col("n_cells") >= min_cells) & (F.col("city_population_share") >= min_share),
    ))
    return classify_units(units, by, id, iso_name, keys, priority_fraction)


def classify_units(
    units: DataFrame, by: str, id: str, iso_name: str, keys: Sequence[str], priority_fraction: float
) -> DataFrame:
    """Priority flags, class and rank of the eligible units of each city."""
    eligible = units.where(F.col("eligible_priority_flag"))
    sizes = eligible.groupBy(by).agg(F.count(F.lit(1)).alias("__m"))
    ranked = attach(eligible, sizes, [by])
    hot = has_hot_group(eligible, [by])
    top = F.greatest(F.lit(1), F.ceil(F.col("__m") * F.lit(float(priority_fraction))))
    tie = [F.col(k).asc_nulls_last() for k in (id, *[k for k in keys if k not in (by, id)])]
    for metric in _METRICS:
        ranked = number_rows(ranked, [by], [F.col(metric).desc_nulls_last(), *tie], f"__r_{metric}", hot)
        ranked = ranked.withColumn(
            f"{metric}_top_priority_flag",
            F.col(metric).isNotNull() & F.col("__m").isNotNull() & (F.col(f"__r_{metric}") <= top),
        ).drop(f"__r_{metric}")
    flags = [f"{m}_top_priority_flag" for m in _METRICS]
    count = reduce(lambda a, b: a + b, [F.col(f).cast("int") for f in flags])
    ranked = ranked.withColumn("district_priority_metric_count", count).drop("__m")
    order = [F.col(c).desc_nulls_last() for c in (
        "district_priority_metric_count", "hotspot_population_share", "citywide_q90_population_share",
        "population_weighted_mean_score", "population_total",
    )]
    ranked = number_rows(ranked, [by], [*order, *tie], "district_priority_rank", hot)
    rest = units.where(~F.col("eligible_priority_flag")).withColumns(
        {f: F.lit(False) for f in flags}
        | {"district_priority_metric_count": F.lit(0), "district_priority_rank": F.lit(None).cast("bigint")}
    )
    klass = (
        F.when(~F.col("eligible_priority_flag"), "small_footprint")
        .when(F.col("district_priority_metric_count") >= 2, "high_priority")
        .when(F.col("district_priority_metric_count") == 1, "emerging_priority")
        .otherwise("lower_priority")
    )
    return ranked.unionByName(rest).withColumn("district_priority_class", klass).select(
        *keys,
        "n_cells", "city_cell_share", "population_total", "city_population_share",
        "mean_score", "median_score", "population_weighted_mean_score",
        "city_score_top_fraction_threshold", "citywide_q90_population_share", "citywide_q90_cell_share",
        "hotspot_population_total", "hotspot_population_share", "hotspot_cell_count", "hotspot_cell_share",
        "hotspot_dominant_dimension", "hotspot_dominant_dimension_weight_share",
        "hotspot_priority_mode", "hotspot_priority_mode_weight_share",
        "eligible_priority_flag", *flags,
        "district_priority_metric_count", "district_priority_class", "district_priority_rank",
    )


def unit_footprints(df: DataFrame, keys: Sequence[str], cell: str, area: str, x: str, y: str) -> DataFrame:
    """Extent, area and number of the cells that make up each unit. The cells
    themselves stay rows; ``unit_cells`` lists them."""
    return df.groupBy(*keys).agg(
        F.count(cell).alias("n_cells"),
        F.sum(area).alias("area"),
        F.min(x).alias("min_x"),
        F.min(y).alias("min_y"),
        F.max(x).alias("max_x"),
        F.max(y).alias("max_y"),
    )


def unit_cells(df: DataFrame, keys: Sequence[str], cell: str) -> DataFrame:
    """Membership table of unit footprints."""
    return df.select(*keys, cell).distinct()

"""Grouped reports: score summaries, shares, exposure and inequality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import available, filter_eq, numeric, tag_scenario, weight, with_numeric
from tessera.operators.order import number_rows, running_sums, value_table
from tessera.operators.quantiles import quantile_table
from tessera.runtime import attach, counted_hot, has_hot_group, keep, require, require_columns

# The feature columns reported when none are named.
DEFAULT_FEATURES = (
    "road_distance_m",
    "school_distance_m",
    "clinic_distance_m",
    "amenity_count_1km",
    "population_per_service",
    "building_coverage_ratio",
    "open_space_share",
    "intersection_density_km2",
)


def grouped(df: DataFrame, by: str, columns: Sequence[str], filter: tuple | None = None) -> DataFrame:
    """Shared entry of the reports: checks, optional filter, no NULL group."""
    require_columns(df, [by, *columns])
    if filter:
        df = filter_eq(df, *filter)
    return df.where(F.col(by).isNotNull())


def score_summary(
    df: DataFrame, by: str, score: str, scenario: str | None = None, filter: tuple | None = None
) -> DataFrame:
    rows = with_numeric(grouped(df, by, [score], filter), score).select(by, score)
    value = F.col(score)
    moments = keep(rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ))
    hot = counted_hot(moments, "__rows")
    medians = quantile_table(rows, [by], [score], [0.5], hot).select(by, F.col(score)[0].alias("median"))
    out = moments.join(medians, by).select(by, "count", "mean", "median", "std", "min", "max")
    return tag_scenario(out, scenario)


def feature_medians(
    df: DataFrame,
    by: str,
    features: Sequence[str] | None = None,
    scenario: str | None = None,
    filter: tuple | None = None,
) -> DataFrame:
    columns = available(df, features or DEFAULT_FEATURES)
    require(len(columns) > 0, "none of the requested feature columns exists")
    rows = with_numeric(grouped(df, by, columns, filter), *columns).select(by, *columns)
    medians = quantile_table(rows, [by], columns, [0.5])
    return tag_scenario(medians.select(by, *[F.col(c)[0].alias(c) for c in columns]), scenario)


def summarize_index(df, by, score, features=None, scenario=None, filter=None) -> tuple[DataFrame, DataFrame]:
    return (
        score_summary(df, by, score, scenario, filter),
        feature_medians(df, by, features, scenario, filter),
    )


def share_of_group(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Share of a group's total, for tables already reduced to few rows a group."""
    total = F.sum(value).over(Window.partitionBy(by))
    return df.withColumn(out, F.when(total != 0, F.col(value) / total))


def category_shares(
    df: DataFrame, by: str, category: str, scenario: str | None = None, filter: tuple | None = None
) -> DataFrame:
    rows = grouped(df, by, [category], filter).where(F.col(category).isNotNull())
    counts = keep(rows.groupBy(by, category).agg(F.count(F.lit(1)).alias("count")))
    totals = counts.groupBy(by).agg(F.sum("count").alias("__all"))
    out = attach(counts, totals, [by]).withColumn("share", F.col("count") / F.col("__all")).drop("__all")
    return tag_scenario(out.select(by, category, "count", "share"), scenario)


def weighted_category_shares(
    df: DataFrame, by: str, category: str, weights: str, scenario: str | None = None, filter: tuple | None = None
) -> DataFrame:
    rows = grouped(df, by, [category, weights], filter).where(F.col(category).isNotNull())
    sums = keep(rows.groupBy(by, category).agg(F.sum(weight(weights)).alias("weight_sum")))
    totals = sums.groupBy(by).agg(F.sum("weight_sum").alias("__all"))
    share = F.when(F.col("__all") > 0, F.col("weight_sum") / F.col("__all"))
    out = attach(sums, totals, [by]).withColumn("weight_share", share)
    return tag_scenario(out.select(by, category, "weight_sum", "weight_share"), scenario)


def exposure(
    df: DataFrame,
    by: str,
    score: str,
    population: str,
    quantiles: Sequence[float] = (0.8, 0.9),
    scenario: str | None = None,
) -> DataFrame:
    """Population living at or above the group's own score quantiles. The mean
    is over the whole population, unscored rows included."""
    rows = grouped(df, by, [score, population]).select(
        by, numeric(score).alias("__s"), weight(population).alias("__p")
    )
    cuts = quantile_table(rows, [by], ["__s"], quantiles).withColumnRenamed("__s", "__cut")
    names = [str(int(round(q * 100))) for q in quantiles]
    above = [
        F.sum(F.when(F.col("__s") >= F.col("__cut")[i], F.col("__p"))).alias(f"__above{i}")
        for i in range(len(names))
    ]
    sums = attach(rows, cuts, [by]).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum("__p").alias("total_population"),
        F.sum(F.col("__s") * F.col("__p")).alias("__sp"),
        F.first("__cut").alias("__cut"),
        *above,
    )
    populated = F.col("total_population") > 0
    columns: list[Column] = [
        F.col(by),
        F.col("n_cells"),
        F.col("total_population"),
        F.when(populated, F.coalesce("__sp", F.lit(0.0)) / F.col("total_population")).alias(
            "population_weighted_mean_score"
        ),
    ]
    for i, name in enumerate(names):
        exposed = F.coalesce(F.col(f"__above{i}"), F.lit(0.0))
        columns.append(F.col("__cut")[i].alias(f"score_q{name}"))
        columns.append(
            F.when(populated, exposed / F.col("total_population")).alias(
                f"population_share_at_or_above_q{name}"
            )
        )
    return tag_scenario(sums.select(*columns), scenario)


def weighted_mean(value: Column, weights: Column) -> Column:
    """Aggregate: weighted mean of the present values, plain mean if the weights
    add to nothing, NULL without values."""
    present = value.isNotNull()
    total = F.sum(F.when(present, weights))
    return F.when(total > 0, F.sum(value * weights) / total).otherwise(F.avg(value))


def weighted_mode(df: DataFrame, by: Sequence[str], category: str, weights: Column, out: str) -> DataFrame:
    """Heaviest category per group and its share of weight; ties go by name."""
    sums = (
        df.groupBy(*by, F.coalesce(F.col(category).cast("string"), F.lit("missing")).alias("__cat"))
        .agg(F.sum(weights).alias("__w"))
    )
    best = F.min(F.struct((-F.col("__w")).alias("w"), F.col("__cat").alias("c")))
    return (
        sums.groupBy(*by)
        .agg(best.alias("__best"), F.sum("__w").alias("__all"))
        .select(
            *by,
            F.col("__best.c").alias(out),
            F.when(F.col("__all") > 0, -F.col("__best.w") / F.col("__all")).alias(f"{out}_weight_share"),
        )
    )


def _lorenz(df: DataFrame, by: Sequence[str], score: str, population: str) -> DataFrame:
    """Distinct scores per group with running counts, weights and weighted
    scores. Tied scores act as one Lorenz step."""
    rows = df.where(F.col(score).isNotNull())
    values = value_table(rows, by, score, {"__w": F.col(population), "__vw": F.col(score) * F.col(population)})
    values = keep(values.withColumn("__vn", F.col(score) * F.col("n")))
    sums = {"__cn": "n", "__cvn": "__vn", "__cw": "__w", "__cvw": "__vw"}
    return running_sums(values, by, [F.col(score).asc()], sums)


def _gini(running: Column, own: Column, weights: Column) -> Column:
    """One minus twice the trapezoid area below the Lorenz curve."""
    total_weight, total_value = F.sum(weights), F.sum(own)
    area2 = F.sum(weights * (2 * running - own))
    return F.when((total_weight != 0) & (total_value != 0), 1 - area2 / (total_weight * total_value))


def gini(df: DataFrame, by: str, score: str, population: str) -> DataFrame:
    steps = _lorenz(_scored(df, by, score, population), [by], "__s", "__p")
    return steps.groupBy(by).agg(
        _gini(F.col("__cvn"), F.col("__vn"), F.col("n")).alias("score_gini_unweighted"),
        _gini(F.col("__cvw"), F.col("__vw"), F.col("__w")).alias("score_gini_population_weighted"),
    )


def weighted_quantiles(
    df: DataFrame, by: str, score: str, population: str, quantiles: Sequence[float]
) -> DataFrame:
    """First score whose running weight reaches the share ``q`` of all weight."""
    steps = keep(_lorenz(_scored(df, by, score, population), [by], "__s", "__p"))
    return _pick_weighted(steps, by, quantiles)


def _pick_weighted(steps: DataFrame, by: str, quantiles: Sequence[float]) -> DataFrame:
    totals = steps.groupBy(by).agg(F.max("__cw").alias("__all"))
    reached = [
        F.min(F.when((F.col("__all") > 0) & (F.col("__cw") >= F.col("__all") * F.lit(float(q))), F.col("__s")))
        .alias(f"score_wp{int(round(q * 100))}")
        for q in quantiles
    ]
    return attach(steps, totals, [by]).groupBy(by).agg(*reached)


def _scored(df: DataFrame, by: str, score: str, population: str) -> DataFrame:
    return grouped(df, by, [score, population]).select(
        by, numeric(score).alias("__s"), weight(population).alias("__p")
    ).where(F.col("__s").isNotNull())


def inequality(
    df: DataFrame, by: str, score: str, population: str, scenario: str | None = None
) -> DataFrame:
    rows = _scored(df, by, score, population)
    steps = keep(_lorenz(rows, [by], "__s", "__p"))
    totals = keep(steps.groupBy(by).agg(
        F.sum("n").alias("n_cells"),
        F.sum("__w").alias("population_total"),
        (F.sum("__vn") / F.sum("n")).alias("score_mean"),
        _gini(F.col("__cvn"), F.col("__vn"), F.col("n")).alias("score_gini_unweighted"),
        _gini(F.col("__cvw"), F.col("__vw"), F.col("__w")).alias("score_gini_population_weighted"),
    ))
    levels = quantile_table(rows, [by], ["__s"], [0.1, 0.5, 0.9], counted_hot(totals, "n_cells"))
    p10, p50, p90 = (F.col("__s")[i] for i in range(3))
    levels = levels.select(
        by,
        p10.alias("score_p10"),
        p50.alias("score_p50"),
        p90.alias("score_p90"),
        (p90 / F.greatest(p10, F.lit(1e-9))).alias("score_p90_p10_ratio"),
    )
    out = totals.join(levels, by).join(_pick_weighted(steps, by, [0.1, 0.5, 0.9]), by)
    return tag_scenario(out, scenario)


# Fixed value: Spark's default bound on the rows its window group limit keeps.
_GROUP_LIMIT = 1000


def top_n(
    df: DataFrame,
    by: str,
    score: str,
    n: int = 25,
    columns: Sequence[str] | None = None,
    tie: Sequence[str] = ("cell_id",),
    scenario: str | None = None,
) -> DataFrame:
    """Highest rows of each group. Up to a thousand rows the row-number limit
    lets every task keep only its own best ``n`` before the shuffle; beyond that
    Spark has no such limit and a hot group is numbered over the cluster."""
    names = columns or (
        "cell_id", by, "country_iso", "lon", "lat", "population", score, *DEFAULT_FEATURES,
    )
    rows = grouped(df, by, [score, *tie])
    order = [F.col(score).desc_nulls_last(), *[F.col(c).asc() for c in tie]]
    if n <= _GROUP_LIMIT:
        numbered = rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    else:
        numbered = number_rows(rows, [by], order, "__r")
    top = numbered.where(F.col("__r") <= n)
    return tag_scenario(top.select(*dict.fromkeys(available(df, names))), scenario)


def top_fraction_rows(
    df: DataFrame, by: Sequence[str], score: str, fraction: float, name: str, tie: Sequence[str],
    descending: bool = True, hot: bool | None = None,
) -> DataFrame:
    """Flag the ``max(1, int(n * fraction))`` extreme scored rows of a group."""
    by = list(by)
    if hot is None:
        hot = has_hot_group(df, by)
    first = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    numbered = number_rows(df, by, [first, *[F.col(c).asc() for c in tie]], "__r", hot=hot)
    if hot:
        sizes = df.groupBy(*by).agg(F.count(score).alias("__n"))
        numbered = attach(numbered, sizes, by)
    else:
        numbered = numbered.withColumn("__n", F.count(score).over(Window.partitionBy(*by)))
    flag = F.col(score).isNotNull() & (F.col("__r") <= top_size(F.col("__n"), fraction))
    return numbered.withColumn(name, flag).drop("__r", "__n")


def top_size(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction))))

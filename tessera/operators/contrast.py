"""Feature contrasts between two sides of a group, and feature profiles of the
categories inside a group.

Moments and medians are aggregated over the wide rows; only the small result is
turned into one row per feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import available, tag_scenario, text, with_numeric
from tessera.operators.quantiles import quantile_table
from tessera.operators.report import grouped
from tessera.runtime import counted_hot, keep, require


def feature_stats(rows: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long table ``keys, feature, rows, n, mean, std, median``."""
    keys = list(keys)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for f in features:
        aggs.append(F.struct(
            F.count(f).alias("n"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")
        ).alias(f))
    moments = keep(rows.groupBy(*keys).agg(*aggs))
    hot = counted_hot(moments, "rows", len(features))
    medians = quantile_table(rows, keys, features, [0.5], hot)
    medians = medians.select(*keys, *[F.col(f)[0].alias(f"{f}__median") for f in features])
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("s"), F.col(f"{f}__median").alias("median"))
        for f in features
    ])
    return (
        moments.join(medians, keys)
        .select(*keys, "rows", F.explode(entries).alias("e"))
        .select(*keys, "rows", "e.feature", "e.s.n", "e.s.mean", "e.s.std", "e.median")
    )


def _direction(diff: Column, above: str, below: str, equal: str) -> Column:
    return F.when(diff > 0, above).when(diff < 0, below).otherwise(equal)


def _ranked(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(value).desc())))


def binary_contrast(
    df: DataFrame,
    by: str,
    binary: str,
    target: str,
    values: Sequence[str],
    reference: str | None = None,
    scenario: str | None = None,
    filter: tuple | None = None,
) -> DataFrame:
    features = available(df, values)
    require(len(features) > 0, "none of the requested value columns exists")
    label = F.col(binary).cast("string")
    is_target = F.coalesce(label == str(target), F.lit(False))
    is_reference = ~is_target if reference is None else F.coalesce(label == str(reference), F.lit(False))
    side = F.when(is_target, "t").when(is_reference, "r").otherwise("x")
    # Moments and medians take several passes; the input itself is computed once.
    rows = keep(with_numeric(grouped(df, by, [binary], filter), *features).select(
        by, side.alias("__side"), *features
    ))
    stats = keep(feature_stats(rows, [by, "__side"], features))

    def of(which: str, column: str) -> Column:
        return F.max(F.when(F.col("__side") == which, F.col(column)))

    pairs = stats.groupBy(by, "feature").agg(
        of("t", "n").alias("target_n"),
        of("r", "n").alias("reference_n"),
        (of("t", "rows") / F.sum("rows")).alias("target_share"),
        of("t", "mean").alias("target_mean"),
        of("r", "mean").alias("reference_mean"),
        of("t", "median").alias("target_median"),
        of("r", "median").alias("reference_median"),
        F.sqrt((F.pow(of("t", "std"), 2) + F.pow(of("r", "std"), 2)) / 2.0).alias("__pooled"),
    ).where((F.col("target_n") > 0) & (F.col("reference_n") > 0))
    diff = F.col("target_mean") - F.col("reference_mean")
    smd = F.when(F.col("__pooled") > 0, diff / F.col("__pooled")).otherwise(0.0)
    out = pairs.select(
        by,
        F.lit(binary).alias("binary_col"),
        F.lit(str(target)).alias("target_value"),
        F.lit("other" if reference is None else str(reference)).alias("reference_value"),
        "feature",
        "target_n",
        "reference_n",
        "target_share",
        "target_mean",
        "reference_mean",
        diff.alias("mean_difference"),
        "target_median",
        "reference_median",
        (F.col("target_median") - F.col("reference_median")).alias("median_difference"),
        smd.alias("standardized_mean_diff"),
        F.abs(smd).alias("abs_standardized_mean_diff"),
        _direction(smd, "target_higher", "target_lower", "no_difference").alias("contrast_direction"),
    )
    out = keep(_ranked(out, [by], "abs_standardized_mean_diff", "contrast_rank"))
    require(not out.isEmpty(), "no contrast row can be computed")
    return tag_scenario(out, scenario)


def category_profiles(
    df: DataFrame,
    by: str,
    category: str,
    values: Sequence[str],
    scenario: str | None = None,
    filter: tuple | None = None,
) -> DataFrame:
    features = available(df, values)
    require(len(features) > 0, "none of the requested value columns exists")
    rows = keep(with_numeric(grouped(df, by, [category], filter), *features).select(
        by, text(category).alias("__cat"), *features
    ))
    whole = feature_stats(rows, [by], features).where(F.col("n") > 0).select(
        by, "feature", F.col("rows").alias("group_n"), F.col("mean").alias("group_mean"),
        F.col("median").alias("group_median"), F.col("std").alias("__sd"),
    )
    parts = feature_stats(rows, [by, "__cat"], features).where(F.col("n") > 0).select(
        by, F.col("__cat"), "feature", F.col("rows").alias("category_n"),
        F.col("mean").alias("category_mean"), F.col("median").alias("category_median"),
    )
    diff = F.col("category_mean") - F.col("group_mean")
    std = F.when(F.col("__sd") > 0, diff / F.col("__sd")).otherwise(0.0)
    out = parts.join(whole, [by, "feature"]).select(
        by,
        F.col("__cat").alias(category),
        "feature",
        "group_n",
        "category_n",
        (F.col("category_n") / F.col("group_n")).alias("category_share"),
        "category_mean",
        "category_median",
        "group_mean",
        "group_median",
        diff.alias("mean_difference_from_group"),
        (F.col("category_median") - F.col("group_median")).alias("median_difference_from_group"),
        std.alias("standardized_profile_diff"),
        F.abs(std).alias("abs_standardized_profile_diff"),
        _direction(std, "above_group_mean", "below_group_mean", "at_group_mean").alias("profile_direction"),
    )
    out = keep(_ranked(out, [by, category], "abs_standardized_profile_diff", "profile_rank"))
    require(not out.isEmpty(), "no category profile can be computed")
    return tag_scenario(out, scenario)

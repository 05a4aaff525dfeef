"""The tables behind the charts: bins, box statistics, pivots, legends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import available, numeric, text
from tessera.operators.order import number_rows
from tessera.operators.quantiles import quantile_table
from tessera.operators.transform import grouped_rows, keys_of
from tessera.runtime import attach, keep, require, require_columns

# The hotspot legend, in drawing order.
HOTSPOT_ORDER = (
    "high_high", "low_low", "high_low", "low_high", "not_significant", "unknown", "missing",
)


def histogram(df: DataFrame, score: str, bins: int = 12) -> DataFrame:
    """Counts of equal-width bins over the range of the score, empty ones too."""
    require_columns(df, [score])
    rows = df.select(numeric(score).alias("__v")).where(F.col("__v").isNotNull())
    ends = rows.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    # A constant column gets a range one wide around its value.
    flat = F.col("__lo") == F.col("__hi")
    ends = keep(ends.select(
        F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo")).alias("__lo"),
        F.when(flat, F.col("__hi") + 0.5).otherwise(F.col("__hi")).alias("__hi"),
    ).where(F.col("__lo").isNotNull()))
    width = (F.col("__hi") - F.col("__lo")) / bins
    bin_of = F.least(F.width_bucket("__v", "__lo", "__hi", F.lit(bins)), F.lit(bins)).cast("int")
    counts = attach(rows, ends, []).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = ends.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "__lo", "__hi").select(
        "bin", (F.col("__lo") + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.col("__lo") + F.col("bin") * width).alias("bin_end"),
    )
    return edges.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def box_stats(df: DataFrame, score: str, by: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends and the number of outliers per group."""
    rows = df.where(F.col(by).isNotNull()).select(by, numeric(score).alias("__v")).where(F.col("__v").isNotNull())
    table = quantile_table(rows, [by], ["__v"], [0.25, 0.5, 0.75]).select(
        by, *[F.col("__v")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    )
    reach = whisker * (F.col("q3") - F.col("q1"))
    v = F.col("__v")
    joined = attach(rows, table, [by])
    return joined.groupBy(by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
        F.count_if((v < F.col("q1") - reach) | (v > F.col("q3") + reach)).alias("n_outliers"),
    )


def color_range(df: DataFrame, score: str) -> DataFrame:
    """1 % to 99 % range of a score, or its full range if that is one point."""
    rows = df.select(numeric(score).alias("__v"))
    q = quantile_table(rows, [], ["__v"], [0.0, 0.01, 0.99, 1.0])
    lo, p1, p99, hi = (F.col("__v")[i] for i in range(4))
    return q.select(
        F.when(p1 == p99, lo).otherwise(p1).alias("vmin"), F.when(p1 == p99, hi).otherwise(p99).alias("vmax")
    )


def _plottable(df: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    require_columns(df, [*columns, value])
    rows = keep(df.select(*columns, numeric(value).alias(value)).na.drop())
    require(not rows.isEmpty(), "no row can be plotted")
    return rows


def _limit(rows: DataFrame, value: str) -> DataFrame:
    top = F.max(F.abs(F.col(value)))
    return rows.agg(F.when((top > 0) & (top < float("inf")), top).otherwise(1.0).alias("limit"))


def heatmap(df: DataFrame, feature: str, by: str, value: str, sort: bool = True) -> DataFrame:
    """Feature by group pivot with row order and the symmetric colour limit."""
    rows = _plottable(df, [feature, by], value)
    wide = rows.groupBy(feature).pivot(by).agg(F.first(value))
    sizes = rows.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias("mean_abs_value"))
    order = Window.orderBy(F.col("mean_abs_value").desc(), F.col(feature)) if sort else Window.orderBy(feature)
    # One row per feature: the ordered table is as small as the chart.
    ordered = sizes.withColumn("row_order", F.row_number().over(order))
    return attach(wide.join(ordered, feature), _limit(rows, value), [])


def faceted_heatmap(df: DataFrame, facet: str, x: str, y: str, value: str) -> DataFrame:
    """Long cells of a faceted heat-map with the shared row order and limit."""
    rows = _plottable(df, [facet, x, y], value).select(
        *[F.col(c).cast("string").alias(c) for c in (facet, x, y)], value
    )
    sizes = rows.groupBy(y).agg(F.avg(F.abs(F.col(value))).alias("__m"))
    ordered = sizes.withColumn("row_order", F.row_number().over(Window.orderBy(F.col("__m").desc(), F.col(y))))
    return attach(rows.join(ordered.drop("__m"), y), _limit(rows, value), []).select(
        facet, x, y, value, "row_order", "limit"
    )


def grouped_bars(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Bar heights: one column per hue value, or ``x`` and ``y`` alone."""
    require_columns(df, [x, y])
    if not hue or hue not in df.columns:
        return df.select(F.col(x).cast("string").alias(x), numeric(y).alias(y))
    rows = df.where(F.col(x).isNotNull() & F.col(hue).isNotNull())
    return rows.groupBy(F.col(x).cast("string").alias(x)).pivot(hue).agg(F.first(numeric(y)))


def legend_counts(
    df: DataFrame, category: str, by: str | None = None, order: Sequence[str] | None = None
) -> DataFrame:
    """Counts per legend entry, in fixed or alphabetical order. With a fixed
    order entries without rows stay, at zero."""
    keys = keys_of(by)
    counts = grouped_rows(df, by).groupBy(*keys, text(category).alias("category")).agg(
        F.count(F.lit(1)).alias("count")
    )
    if order is None:
        names = counts.select("category").distinct()
        return counts.join(number_rows(names, [], [F.col("category")], "position"), "category")
    entries = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("category")) for i, name in enumerate(order)
    ]))
    base = counts.select(*keys).distinct() if by else df.sparkSession.range(1).select()
    table = base.select(*keys, entries.alias("e")).select(*keys, "e.position", "e.category")
    return table.join(counts, [*keys, "category"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def hotspot_legend(df: DataFrame, hotspot: str, by: str | None = None) -> DataFrame:
    return legend_counts(df, hotspot, by, HOTSPOT_ORDER)


def scatter_limits(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = numeric(x), numeric(y)
    return df.agg(
        F.least(F.min(a), F.min(b)).alias("axis_min"), F.greatest(F.max(a), F.max(b)).alias("axis_max")
    )


def lowest_highest(df: DataFrame, score: str, id: str, n: int = 8) -> DataFrame:
    """The ``n`` lowest and ``n`` highest rows of the whole table."""
    rows = df.select(F.col(id).alias(id), numeric(score).alias(score))
    low = rows.orderBy(F.col(score).asc_nulls_last(), id).limit(n).withColumn("side", F.lit("lowest"))
    high = rows.orderBy(F.col(score).desc_nulls_last(), id).limit(n).withColumn("side", F.lit("highest"))
    return low.unionByName(high)


def quicklook(
    df: DataFrame, score: str, id: str | None = None, by: str | None = None,
    lon: str | None = None, lat: str | None = None, sample: float | None = None, seed: int = 42,
) -> dict[str, DataFrame]:
    """The quick-look tables whose columns exist. The point map holds all rows
    unless a sampling share is asked for."""
    require_columns(df, [score])
    out = {"histogram": histogram(df, score)}
    if by and by in df.columns:
        out["box_stats"] = box_stats(df, score, by)
    if id and id in df.columns:
        out["lowest_highest"] = lowest_highest(df, score, id)
    if lon and lat and len(available(df, [lon, lat])) == 2:
        points = df.select(lon, lat, score)
        out["point_map"] = points if sample is None else points.sample(fraction=sample, seed=seed)
    return out

"""Group-wise transforms that leave the row count alone: winsorise, z-score,
min-max, percent rank and flags. Each is one statistics pass plus a lookup."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import clip
from tessera.operators.order import average_rank
from tessera.operators.quantiles import quantile_table
from tessera.runtime import attach, has_hot_group


def keys_of(by: str | None) -> list[str]:
    return [by] if by else []


def grouped_rows(df: DataFrame, by: str | None) -> DataFrame:
    return df.where(F.col(by).isNotNull()) if by else df


def groupwise(
    df: DataFrame, by: str | None, stats: dict[str, Column], transform: Callable[[], dict[str, Column]]
) -> DataFrame:
    """Attach aggregates of the group, or of the whole table, and map rows with
    them. ``transform`` returns output columns that may use the aggregates."""
    rows = grouped_rows(df, by)
    table = rows.groupBy(by).agg(*[c.alias(n) for n, c in stats.items()]) if by else rows.agg(
        *[c.alias(n) for n, c in stats.items()]
    )
    return attach(df, table, keys_of(by)).withColumns(transform()).drop(*stats)


def winsorize(
    df: DataFrame, columns: Sequence[str], quantiles: Sequence[float], by: str | None = None,
    hot: bool | None = None,
) -> DataFrame:
    table = quantile_table(grouped_rows(df, by), keys_of(by), columns, quantiles, hot=hot)
    table = table.withColumnsRenamed({c: f"__q_{c}" for c in columns})
    bounded = attach(df, table, keys_of(by))
    grouped_row = F.col(by).isNotNull() if by else F.lit(True)
    return bounded.withColumns({
        c: F.when(grouped_row, clip(F.col(c), F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1])) for c in columns
    }).drop(*[f"__q_{c}" for c in columns])


def zscore(
    df: DataFrame, columns: Sequence[str], by: str | None = None, bound: float | None = None,
    suffix: str = "__z",
) -> DataFrame:
    """Population z-score; a constant column scores 0. In a grouped call rows
    without a group score NULL."""
    stats: dict[str, Column] = {"__rows": F.count(F.lit(1))}
    for c in columns:
        stats[f"__m_{c}"] = F.avg(c)
        stats[f"__s_{c}"] = F.stddev_pop(c)

    def score(c: str) -> Column:
        sd = F.col(f"__s_{c}")
        z = F.when(sd > 0, (F.col(c) - F.col(f"__m_{c}")) / sd).otherwise(0.0)
        z = F.when(F.col("__rows").isNotNull(), z)
        return clip(z, -bound, bound) if bound is not None else z

    return groupwise(df, by, stats, lambda: {f"{c}{suffix}": score(c) for c in columns})


def minmax_0_100(
    df: DataFrame,
    columns: dict[str, str],
    lower: float | None = None,
    upper: float | None = None,
    by: str | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Scale to 0-100 between quantiles; a constant group scores 50. ``columns``
    maps input to output names. The ends of the clipped values are the clipped
    ends, so one statistics pass is enough."""
    probs = [0.0 if lower is None else lower, 1.0 if upper is None else upper]
    names = list(columns)
    table = quantile_table(grouped_rows(df, by), keys_of(by), names, probs, hot=hot)
    table = table.withColumnsRenamed({c: f"__q_{c}" for c in names})

    def scaled(c: str) -> Column:
        low, high = F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]
        value = 100.0 * (clip(F.col(c), low, high) - low) / (high - low)
        return F.when(low.isNull(), None).when(high == low, 50.0).otherwise(value)

    out = attach(df, table, keys_of(by))
    return out.withColumns({o: scaled(c) for c, o in columns.items()}).drop(*[f"__q_{c}" for c in names])


def percent_rank(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Average ascending rank divided by the number of scored rows."""
    hot = has_hot_group(df, [by])
    ranked = average_rank(df, [by], value, "__r", hot=hot)
    if hot:
        sizes = df.groupBy(by).agg(F.count(value).alias("__n"))
        ranked = attach(ranked, sizes, [by])
    else:
        ranked = ranked.withColumn("__n", F.count(value).over(Window.partitionBy(by)))
    return ranked.withColumn(out, F.col("__r") / F.col("__n")).drop("__r", "__n")


def top_fraction_flag(
    df: DataFrame, by: str | None, score: str, fraction: float, threshold: str, flag: str
) -> DataFrame:
    """Flag rows at or above the upper quantile of their group."""
    table = quantile_table(grouped_rows(df, by), keys_of(by), [score], [1.0 - float(fraction)])
    table = table.select(*keys_of(by), F.col(score)[0].alias(threshold))
    hit = F.coalesce(F.col(score) >= F.col(threshold), F.lit(False))
    return attach(df, table, keys_of(by)).withColumn(flag, hit)

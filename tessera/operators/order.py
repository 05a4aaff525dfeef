"""Positions, ranks and running sums inside groups of any size.

Each function has two forms. A group that fits a task goes through a window.
If any group is hot, rows are range-sorted over the whole cluster instead: the
sorted table is materialised, each partition contributes one total per group,
and the running total of those totals is added back. No task ever holds more
than one range partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import has_hot_group, keep, lookup

_POS, _PART, _GROUP = "__pos", "__part", "__group"
_PART_SHIFT = 33  # monotonically_increasing_id keeps the partition above bit 33


def group_key(by: Sequence[str]) -> Column:
    """The group columns as one value, in which NULL equals NULL."""
    return F.struct(*by) if by else F.lit(0)


def _place(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Sort globally by group and order, and keep each row's place."""
    ordered = df.withColumn(_GROUP, group_key(by)).orderBy(_GROUP, *order)
    placed = keep(ordered.withColumn(_POS, F.monotonically_increasing_id()))
    return placed.withColumn(_PART, F.shiftright(_POS, _PART_SHIFT))


def _carry(placed: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """Per partition and group: first place and what earlier partitions of the
    same group add up to. Has at most partitions + groups rows."""
    spans = placed.groupBy(_PART, _GROUP).agg(
        F.min(_POS).alias("__first"), *[c.alias(f"__own_{n}") for n, c in totals.items()]
    )
    earlier = Window.partitionBy(_GROUP).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return spans.select(
        _PART,
        _GROUP,
        "__first",
        *[
            F.coalesce(F.sum(f"__own_{n}").over(earlier), F.lit(0)).alias(f"__before_{n}")
            for n in totals
        ],
    )


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, hot: bool | None = None
) -> DataFrame:
    """Add the 1-based position of each row in its group. ``order`` must end in
    a tie breaker for the result to be defined."""
    by = list(by)
    if hot is None:
        hot = has_hot_group(df, by)
    if not hot:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    placed = _place(df, by, order)
    carry = lookup(_carry(placed, {"n": F.count(F.lit(1))}))
    return (
        placed.join(carry, [_PART, _GROUP])
        .withColumn(name, F.col(_POS) - F.col("__first") + F.col("__before_n") + 1)
        .drop(_POS, _PART, _GROUP, "__first", "__before_n")
    )


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, str],
    hot: bool | None = None,
) -> DataFrame:
    """Add inclusive running sums: output name -> summed column."""
    by = list(by)
    if hot is None:
        hot = has_hot_group(df, by)
    if not hot:
        frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(frame) for n, c in sums.items()})
    placed = _place(df, by, order)
    carry = lookup(_carry(placed, {n: F.sum(c) for n, c in sums.items()}))
    frame = Window.partitionBy(_PART, _GROUP).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({n: F.sum(c).over(frame) for n, c in sums.items()})
    joined = local.join(carry, [_PART, _GROUP])
    return joined.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums}).drop(
        _POS, _PART, _GROUP, "__first", *[f"__before_{n}" for n in sums]
    )


def value_table(
    df: DataFrame, by: Sequence[str], value: str, sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """Distinct values per group with their row count ``n`` and further sums:
    ties, however many, become one row before anything is sorted."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggs)


def average_rank(
    df: DataFrame, by: Sequence[str], value: str, name: str, descending: bool = False, hot: bool | None = None
) -> DataFrame:
    """Rank with ties sharing their mean position; a missing value has none."""
    by = list(by)
    if hot is None:
        hot = has_hot_group(df, by)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    if not hot:
        ordered = Window.partitionBy(*by).orderBy(order)
        first = F.rank().over(ordered)
        last = F.count(F.lit(1)).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn(name, F.when(F.col(value).isNotNull(), (first + last) / 2.0))
    keyed = df.withColumn("__key", group_key(by))
    values = running_sums(value_table(keyed, ["__key"], value), ["__key"], [order], {"__upto": "n"}, hot=True)
    ranks = values.select("__key", value, (F.col("__upto") - (F.col("n") - 1) / 2.0).alias(name))
    return keyed.join(lookup(ranks), ["__key", value], "left").select(*df.columns, name)


def dense_rank_desc(df: DataFrame, value: str, name: str, hot: bool | None = None) -> DataFrame:
    """Dense rank over the whole table, largest first, through its distinct
    values, so the rows themselves are never put in one order."""
    values = df.where(F.col(value).isNotNull()).select(value).distinct()
    ordinals = number_rows(keep(values), [], [F.col(value).desc()], name, hot=hot)
    return df.join(lookup(ordinals), [value], "left").select(*df.columns, name)

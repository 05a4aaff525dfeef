"""Exact quantiles per group, for groups of any size.

``percentile`` holds a value-to-count map of the group in one task, so it is
used only where every group is small. Otherwise a quantile sketch first brackets
each quantile, a second pass counts what lies under each bracket, and only the
values inside the brackets are sorted to pick the exact order statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import group_key, running_sums
from tessera.runtime import attach, has_hot_group, keep, lookup

_SKETCH = 10_000


def quantile_table(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float], hot: bool | None = None
) -> DataFrame:
    """One row per group; each column becomes the array of its linearly
    interpolated quantiles, or NULL where the group has no value."""
    by, columns, probs = list(by), list(columns), [float(p) for p in probs]
    if hot is None:
        hot = has_hot_group(df, by, len(columns))
    if hot:
        # One key column, in which a NULL group equals itself in the joins.
        keyed = df.withColumn("__key", group_key(by)).select("__key", *columns)
        return _bracketed(keyed, ["__key"], columns, probs).select(*[F.col(f"__key.{c}").alias(c) for c in by], *columns)
    wanted = F.array(*[F.lit(p) for p in probs])
    aggs = [F.percentile(F.col(c).cast("double"), wanted).alias(c) for c in columns]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _bracketed(df: DataFrame, by: list[str], columns: list[str], probs: list[float]) -> DataFrame:
    groups = keep(df.select(*by).distinct())
    long = df.select(
        *by, F.explode(F.array(*[
            F.struct(F.lit(c).alias("__f"), F.col(c).cast("double").alias("__v")) for c in columns
        ])).alias("__e"),
    ).select(*by, "__e.__f", "__e.__v").where(F.col("__v").isNotNull())
    keys = [*by, "__f"]
    slack = 3.0 / _SKETCH
    low = F.array(*[F.lit(max(p - slack, 0.0)) for p in probs])
    high = F.array(*[F.lit(min(p + slack, 1.0)) for p in probs])
    sketch = long.groupBy(*keys).agg(
        F.percentile_approx("__v", low, F.lit(_SKETCH)).alias("__lo"),
        F.percentile_approx("__v", high, F.lit(_SKETCH)).alias("__hi"),
        F.count(F.lit(1)).alias("__n"),
    )
    brackets = keep(sketch)
    marked = long.join(lookup(brackets), keys)
    below = marked.groupBy(*keys).agg(F.array(*[
        F.count_if(F.col("__v") < F.col("__lo")[i]) for i in range(len(probs))
    ]).alias("__below"))
    inside = marked.select(
        *keys, "__v",
        F.explode(F.filter(
            F.array(*[
                F.when((F.col("__v") >= F.col("__lo")[i]) & (F.col("__v") <= F.col("__hi")[i]), F.lit(i))
                for i in range(len(probs))
            ]),
            lambda slot: slot.isNotNull(),
        )).alias("__i"),
    )
    values = inside.groupBy(*keys, "__i", "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_sums(keep(values), [*keys, "__i"], [F.col("__v")], {"__upto": "__c"}, hot=True)
    probability = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("__i") + 1)
    where = (F.col("__n") - 1) * probability
    placed = (
        attach(attach(ranked, brackets.select(*keys, "__n"), keys), below, keys)
        .withColumn("__upto", F.col("__upto") + F.col("__below")[F.col("__i")])
        .withColumn("__start", F.col("__upto") - F.col("__c"))
        .withColumn("__k", F.floor(where))
        .withColumn("__t", where - F.floor(where))
    )

    def value_at(position):
        hit = (F.col("__start") <= position) & (F.col("__upto") > position)
        return F.max(F.when(hit, F.col("__v")))

    picked = keep(placed.groupBy(*keys, "__i").agg(
        value_at(F.col("__k")).alias("__a"),
        value_at(F.least(F.col("__k") + 1, F.col("__n") - 1)).alias("__b"),
        F.first("__t").alias("__t"),
    ))
    if picked.where(F.col("__a").isNull() | F.col("__b").isNull()).limit(1).count():
        return _sorted(long, by, columns, probs, groups)
    return _wide(picked, by, columns, probs, groups)


def _sorted(long: DataFrame, by: list[str], columns: list[str], probs: list[float], groups) -> DataFrame:
    """Order statistics from a full sort, if a bracket missed its quantile."""
    keys = [*by, "__f"]
    values = keep(long.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")))
    ranked = running_sums(values, keys, [F.col("__v")], {"__upto": "__c"}, hot=True)
    sizes = values.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    placed = attach(ranked, sizes, keys).withColumn(
        "__p", F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)
        ]))
    )
    where = (F.col("__n") - 1) * F.col("__p.p")
    start = F.col("__upto") - F.col("__c")

    def value_at(position):
        return F.max(F.when((start <= position) & (F.col("__upto") > position), F.col("__v")))

    picked = placed.groupBy(*keys, F.col("__p.i").alias("__i")).agg(
        value_at(F.floor(where)).alias("__a"),
        value_at(F.least(F.floor(where) + 1, F.col("__n") - 1)).alias("__b"),
        F.first(where - F.floor(where)).alias("__t"),
    )
    return _wide(picked, by, columns, probs, groups)


def _wide(picked: DataFrame, by: list[str], columns: list[str], probs: list[float], groups) -> DataFrame:
    # The same sum as ``percentile`` makes, so both forms give equal doubles.
    value = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("__a") * (1.0 - F.col("__t")) + F.col("__b") * F.col("__t"))
    cells = picked.withColumn("__q", value)

    def slot(column: str, i: int):
        return F.max(F.when((F.col("__f") == column) & (F.col("__i") == i), F.col("__q")))

    aggs = []
    for column in columns:
        filled = F.array(*[slot(column, i) for i in range(len(probs))])
        aggs.append(F.when(slot(column, 0).isNotNull(), filled).alias(column))
    return groups.join(cells.groupBy(*by).agg(*aggs), by, "left")

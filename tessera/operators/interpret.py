"""Why a row scores high, and which rows come first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import MISSING, composite_column, numeric
from tessera.operators.transform import top_fraction_flag
from tessera.runtime import require, require_columns


def _finite(column: str) -> Column:
    value = numeric(column)
    return F.when(F.abs(value) < float("inf"), value)


def dominant_dimension(
    df: DataFrame, dimension_cols: Sequence[str], thresholds: Sequence[float] = (0.25, 0.75)
) -> DataFrame:
    """Largest dimension score of a row (the first on ties), its margin to the
    second, and the strength class of that margin."""
    columns = list(dimension_cols)
    require_columns(df, columns)
    require(len(thresholds) == 2, "two margin thresholds are needed")
    mixed, strong = float(thresholds[0]), float(thresholds[1])
    require(0 <= mixed <= strong, "thresholds must satisfy 0 <= mixed <= strong")
    values = [_finite(c) for c in columns]
    top = F.greatest(*values) if len(values) > 1 else values[0]
    name = F.coalesce(*[F.when(v == top, F.lit(c.replace("__score", ""))) for c, v in zip(columns, values)])
    if len(values) > 1:
        second = F.get(F.sort_array(F.filter(F.array(*values), lambda v: v.isNotNull()), asc=False), F.lit(1))
    else:
        second = F.when(top.isNotNull(), F.lit(0.0))
    margin = F.col("dominant_dimension_score") - F.col("__second")
    return (
        df.withColumns({
            "dominant_dimension": F.coalesce(name, F.lit(MISSING)),
            "dominant_dimension_score": top,
            "__second": second,
        })
        .withColumn("dominant_dimension_margin", margin)
        .withColumn(
            "dominant_dimension_strength",
            F.when(F.col("dominant_dimension_margin").isNull(), MISSING)
            .when(F.col("dominant_dimension_margin") < mixed, "mixed")
            .when(F.col("dominant_dimension_margin") < strong, "moderate")
            .otherwise("strong"),
        )
        .drop("__second")
    )


def priority_quadrants(
    df: DataFrame,
    absolute: str,
    relative: str,
    by: str,
    absolute_top: float = 0.1,
    relative_top: float = 0.1,
) -> DataFrame:
    """High on the absolute score over all rows, on the relative score within
    the group, on both, or on neither."""
    require_columns(df, [absolute, relative, by])
    require(0 < absolute_top < 1 and 0 < relative_top < 1, "top fractions must be in (0, 1)")
    rows = df.withColumns({"__a": numeric(absolute), "__r": numeric(relative)})
    rows = top_fraction_flag(rows, None, "__a", absolute_top, "absolute_priority_threshold", "absolute_priority_flag")
    rows = top_fraction_flag(rows, by, "__r", relative_top, "relative_priority_threshold", "relative_priority_flag")
    a, r = F.col("absolute_priority_flag"), F.col("relative_priority_flag")
    quadrant = (
        F.when(a & r, "joint_priority").when(a, "absolute_only").when(r, "relative_only")
        .otherwise("lower_priority")
    )
    return rows.withColumn("priority_quadrant", quadrant).drop("__a", "__r")


def hotspot_typology(
    df: DataFrame, quadrant: str = "priority_quadrant", dimension: str = "dominant_dimension",
    out: str = "hotspot_typology",
) -> DataFrame:
    return composite_column(df, [quadrant, dimension], out)

"""Column profile of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

_EXAMPLES = 3
_PREVIEW = 5


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, present and missing values, distinct values and
    three examples, with the row count of the table."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    comparable = [f.name for f in df.schema if not isinstance(f.dataType, MapType)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, field in enumerate(df.schema):
        c = F.col(field.name)
        aggs.append(F.count(c).alias(f"__n{i}"))
        aggs.append((distinct(c) if field.name in comparable else F.lit(None).cast("bigint")).alias(f"__u{i}"))
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(field.name).alias("name"),
            F.lit(field.dataType.simpleString()).alias("dtype"),
            F.col("__rows").alias("rows"),
            F.col(f"__n{i}").alias("non_null"),
            (F.col("__rows") - F.col(f"__n{i}")).alias("nulls"),
            F.col(f"__u{i}").alias("n_unique"),
        )
        for i, field in enumerate(df.schema)
    ])
    counts = df.agg(*aggs).select(F.explode(entries).alias("e")).select("e.*")
    shown = counts.join(F.broadcast(examples(df)), "position", "left")
    return shown.withColumn("examples", F.coalesce("examples", F.array().cast("array<string>"))).orderBy("position")


def examples(df: DataFrame, distinct: bool = False) -> DataFrame:
    """The three smallest values of each column as text, copies included unless
    ``distinct``: the values of all columns in one scan. With copies every task
    passes on three; else equal values are made one before they are ordered."""
    columns = [F.to_json(f.name) if isinstance(f.dataType, MapType) else F.col(f.name).cast("string") for f in df.schema]
    values = df.select(F.posexplode(F.array(*columns)).alias("position", "v")).where(F.col("v").isNotNull())
    if distinct:
        values = values.distinct()
    least = F.row_number().over(Window.partitionBy("position").orderBy("v"))
    few = values.withColumn("r", least).where(F.col("r") <= _EXAMPLES)
    return few.groupBy("position").agg(F.sort_array(F.collect_list("v")).alias("examples"))


def preview(df: DataFrame) -> DataFrame:
    """The first rows in the order of their columns, so the same in every run."""
    order = [f.name for f in df.schema if not isinstance(f.dataType, MapType)]
    return df.orderBy(*order).limit(_PREVIEW)


def bounds(df: DataFrame, x: str = "x", y: str = "y", by: list[str] | None = None) -> DataFrame:
    ends = [F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy")]
    return df.groupBy(*by).agg(*ends) if by else df.agg(*ends)

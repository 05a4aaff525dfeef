"""Row-local expressions. All are pure column transforms, so they run the same
on a batch and on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import require, require_columns

MISSING = "missing"

# Map tags that decide what counts as a service, school or clinic.
NOT_A_SERVICE = (
    "bench",
    "bicycle_parking",
    "clock",
    "drinking_water",
    "fountain",
    "parking",
    "parking_space",
    "post_box",
    "recycling",
    "shelter",
    "telephone",
    "toilets",
    "vending_machine",
    "waste_basket",
    "waste_disposal",
)
SCHOOLS = ("school", "college", "university", "kindergarten")
CLINICS = ("clinic", "doctors", "hospital", "pharmacy", "health_post")
CLINIC_HEALTHCARE = (*CLINICS, "yes", "centre", "center")


def numeric(column: str | Column) -> Column:
    """Double, with unreadable text and NaN both turned into NULL."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(value), value)


def with_numeric(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: numeric(c) for c in columns})


def text(column: str | Column) -> Column:
    """String form with NULL shown as ``missing``."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def weight(column: str | Column) -> Column:
    """Numeric weight: missing counts as 0 and negatives are raised to 0."""
    return F.greatest(F.coalesce(numeric(column), F.lit(0.0)), F.lit(0.0))


def clip(value: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """Bound a value; a missing value stays missing, a missing bound is none."""
    out = value
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def filter_eq(df: DataFrame, column: str | None, value) -> DataFrame:
    """Keep rows whose string form equals ``value``; no column, no filter."""
    if not column:
        return df
    require_columns(df, [column])
    return df.where(F.col(column).cast("string") == str(value))


def filter_scenario(df: DataFrame, scenario: str | None) -> DataFrame:
    if scenario and "scenario" in df.columns:
        return filter_eq(df, "scenario", scenario)
    return df


def tag_scenario(df: DataFrame, scenario: str | None) -> DataFrame:
    return df.select(F.lit(scenario).alias("scenario"), "*") if scenario else df


def composite_column(df: DataFrame, columns: Sequence[str], out: str, sep: str = "__") -> DataFrame:
    require_columns(df, columns)
    return df.withColumn(out, F.concat_ws(sep, *[text(c) for c in columns]))


_COMPARE = {
    ">=": lambda c, v: c >= v,
    ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v,
    "<": lambda c, v: c < v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: ~c.eqNullSafe(v),
}


def mask_expr(df: DataFrame, conditions: Sequence[Mapping], mode: str = "any") -> Column:
    """Boolean column of an analysis mask. A missing value fails each test but
    ``!=``."""
    require(len(conditions) > 0, "a mask needs at least one condition")
    require(mode in ("all", "any"), "mode must be 'all' or 'any'")
    tests = []
    for condition in conditions:
        require_columns(df, [condition["column"]])
        require(condition["op"] in _COMPARE, f"unknown comparison {condition['op']}")
        test = _COMPARE[condition["op"]](numeric(condition["column"]), F.lit(float(condition["value"])))
        tests.append(F.coalesce(test, F.lit(False)))
    return reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), tests)


def analysis_mask(df: DataFrame, conditions: Sequence[Mapping], mode: str = "any") -> DataFrame:
    return df.where(mask_expr(df, conditions, mode))


def mask_settings(config: Mapping) -> Mapping:
    """The mask block of a larger configuration, or the block itself."""
    return config.get("analysis_mask", config)


def is_service(amenity: str = "amenity") -> Column:
    """Anything not on the fixed exclusion list, untagged rows included."""
    return ~F.coalesce(F.lower(F.col(amenity).cast("string")).isin(*NOT_A_SERVICE), F.lit(False))


def is_school(amenity: str = "amenity") -> Column:
    return F.coalesce(F.lower(F.col(amenity).cast("string")).isin(*SCHOOLS), F.lit(False))


def is_clinic(df: DataFrame, amenity: str = "amenity", healthcare: str = "healthcare") -> Column:
    tests = [F.lit(False)]
    if amenity in df.columns:
        tests.append(F.lower(F.col(amenity).cast("string")).isin(*CLINICS))
    if healthcare in df.columns:
        tests.append(F.lower(F.col(healthcare).cast("string")).isin(*CLINIC_HEALTHCARE))
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def service_points(df: DataFrame, amenity: str = "amenity") -> DataFrame:
    return df.where(is_service(amenity)) if amenity in df.columns else df.limit(0)


def school_points(df: DataFrame, amenity: str = "amenity") -> DataFrame:
    return df.where(is_school(amenity)) if amenity in df.columns else df.limit(0)


def clinic_points(df: DataFrame, amenity: str = "amenity", healthcare: str = "healthcare") -> DataFrame:
    return df.where(is_clinic(df, amenity, healthcare))


def intersection_nodes(df: DataFrame, streets: str = "street_count") -> DataFrame:
    """Nodes where three or more streets meet; all nodes if not counted."""
    if streets not in df.columns:
        return df
    return df.where(F.coalesce(numeric(streets), F.lit(0.0)) >= 3)


def population_per_service(population: str, services: str) -> Column:
    return F.col(population) / F.greatest(F.col(services), F.lit(1))


def drop_debug_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(("__aligned", "__z"))])


def weighted_average(parts: Sequence[tuple[str, float]]) -> Column:
    """Weighted mean across columns of one row."""
    total = sum(w for _, w in parts)
    require(total != 0, "the weights add up to zero")
    return reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(w)) for c, w in parts]) / F.lit(float(total))


def slug(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )


def available(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def select_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*available(df, columns))


def concat_tables(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, columns matched by name, absent ones NULL."""
    require(len(tables) > 0, "at least one table is needed")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def mask_report(df: DataFrame, conditions: Sequence[Mapping], mode: str = "any", by: str = "city") -> DataFrame:
    """Rows before and after a mask, per group and, with a NULL group, in all."""
    keep_row = mask_expr(df, conditions, mode)
    aggs = [F.count(F.lit(1)).alias("rows_before"), F.count_if(keep_row).alias("rows_after")]
    if by in df.columns:
        # A row without a group counts in the total only.
        table = df.rollup(by).agg(*aggs, F.grouping(by).alias("__all"))
        table = table.where(F.col(by).isNotNull() | (F.col("__all") == 1)).drop("__all")
    else:
        table = df.agg(*aggs)
    kept = F.when(F.col("rows_before") > 0, F.col("rows_after") / F.col("rows_before")).otherwise(0.0)
    return table.withColumns({
        "rows_removed": F.col("rows_before") - F.col("rows_after"), "share_kept": kept
    })

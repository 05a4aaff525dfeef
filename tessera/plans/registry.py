"""Registration of queries together with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _digits(entry: str) -> tuple[str, int]:
    name, _, digits = entry.partition(":")
    return name, int(digits or 6)


def _nudge(digits: int) -> float:
    """Means of cents often end exactly on a half; a small shift before rounding,
    far above the noise of summation order, keeps both engines on one side."""
    return round(3.1 * 10.0 ** -(digits + 3), digits + 4)


def tidy(df: DataFrame, doubles: Sequence[str]) -> DataFrame:
    """Round the named doubles (``name:digits``, six by default), turn -0.0 into
    0.0 and widen integers, so that two engines can be compared."""
    rounded = {}
    for entry in doubles:
        name, digits = _digits(entry)
        rounded[name] = F.round(F.col(name).cast("double") + F.lit(_nudge(digits)), digits) + F.lit(0.0)
    for name, kind in df.dtypes:
        if kind in ("int", "smallint", "tinyint"):
            rounded[name] = F.col(name).cast("bigint")
    return df.withColumns(rounded) if rounded else df


def tidy_sql(sql: str, doubles: Sequence[str], base: str) -> str:
    body = f"WITH {base}, answer AS ({sql}) " if base else f"WITH answer AS ({sql}) "
    if not doubles:
        return body + "SELECT * FROM answer"
    parts = ", ".join(
        f"round(CAST({n} AS DOUBLE) + CAST({_nudge(d)!r} AS DOUBLE), {d}) + 0.0 AS {n}" for n, d in map(_digits, doubles)
    )
    return body + f"SELECT * REPLACE ({parts}) FROM answer"


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), base: str = ""):
    """Register a query. ``base`` holds the common table expressions of its SQL."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(fn(spark, folder), doubles)

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = tidy_sql(sql, doubles, base)
        return fn

    return wrap

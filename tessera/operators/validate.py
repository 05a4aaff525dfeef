"""Agreement of scores with an external signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import numeric
from tessera.operators.compare import finite_corr
from tessera.operators.order import average_rank
from tessera.operators.report import top_fraction_rows
from tessera.runtime import has_hot_group, keep, require, require_columns

_TINY = 1e-9


def validate_external(
    df: DataFrame,
    by: str,
    external: str,
    scores: Sequence[str],
    top_fraction: float = 0.1,
    relation: str = "negative",
    tie: Sequence[str] = ("cell_id",),
) -> DataFrame:
    """Per group and score: correlations with the external signal and the gap in
    it between the highest and the lowest scored rows."""
    scores = list(scores)
    require(len(scores) > 0, "at least one score column is needed")
    require(0 < top_fraction < 0.5, "top_fraction must be in (0, 0.5)")
    require_columns(df, [by, external, *scores, *tie])
    entries = F.array(*[F.struct(F.lit(s).alias("score_column"), numeric(s).alias("__s")) for s in scores])
    rows = keep(
        df.where(F.col(by).isNotNull())
        .select(by, *dict.fromkeys(tie), numeric(external).alias("__e"), F.explode(entries).alias("x"))
        .select(by, *dict.fromkeys(tie), "__e", "x.score_column", "x.__s")
        .where(F.col("__e").isNotNull() & F.col("__s").isNotNull())
    )
    keys = [by, "score_column"]
    hot = has_hot_group(rows, keys)
    rows = average_rank(rows, keys, "__s", "__rs", hot=hot)
    rows = average_rank(rows, keys, "__e", "__re", hot=hot)
    rows = top_fraction_rows(rows, keys, "__s", top_fraction, "__top", tie, hot=hot)
    rows = top_fraction_rows(rows, keys, "__s", top_fraction, "__low", tie, descending=False, hot=hot)
    sign = -1.0 if relation == "negative" else 1.0
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        finite_corr(F.col("__s"), F.col("__e")).alias("pearson_corr"),
        finite_corr(F.col("__rs"), F.col("__re")).alias("spearman_corr"),
        F.avg(F.when(F.col("__top"), F.col("__e"))).alias("__t"),
        F.avg(F.when(F.col("__low"), F.col("__e"))).alias("__b"),
        F.stddev_pop("__e").alias("__sd"),
    )
    top, low = F.col("__t"), F.col("__b")

    def guarded(divisor: Column, quotient: Column) -> Column:
        return F.when(F.abs(divisor) > _TINY, quotient)

    return out.select(
        F.col(by).cast("string").alias(by),
        "score_column",
        F.lit(external).alias("external_column"),
        "n_rows",
        F.lit(relation).alias("expected_relation"),
        "pearson_corr",
        "spearman_corr",
        (sign * F.col("pearson_corr")).alias("expected_signed_pearson"),
        (sign * F.col("spearman_corr")).alias("expected_signed_spearman"),
        F.lit(float(top_fraction)).alias("top_fraction"),
        top.alias("top_score_external_mean"),
        low.alias("bottom_score_external_mean"),
        (top - low).alias("top_minus_bottom_external_mean"),
        (low - top).alias("bottom_minus_top_external_mean"),
        guarded(low, top / low).alias("top_over_bottom_external_ratio"),
        guarded(F.col("__sd"), (top - low) / F.col("__sd")).alias("standardized_top_minus_bottom_gap"),
    )


def validation_findings(summary: DataFrame, by: str | None = None) -> DataFrame:
    """One nested row: best group per score, and the strongest and weakest
    agreement over all rows of a validation summary."""
    by = by or summary.columns[0]
    row = F.struct(*[F.col(c) for c in summary.columns])
    # Ties go to the first group and score by name.
    order = [F.col(by).cast("string"), F.col("score_column")]
    up = F.struct(F.coalesce(-F.col("expected_signed_spearman"), F.lit(float("inf"))), *order)
    down = F.struct(F.coalesce(F.col("expected_signed_spearman"), F.lit(float("inf"))), *order)
    best = F.min_by(F.struct(
        F.col(by).cast("string").alias("best_group"),
        "expected_signed_spearman",
        "expected_signed_pearson",
        "external_column",
    ), up)
    per_score = summary.groupBy("score_column").agg(best.alias("best"))
    by_score = per_score.agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("score_column", "best")
    ))).alias("strongest_by_score"))
    overall = summary.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_set("score_column")).alias("score_columns"),
        F.array_sort(F.collect_set(F.col(by).cast("string"))).alias("groups"),
        F.struct(
            F.min_by(row, up).alias("strongest_expected_alignment"),
            F.min_by(row, down).alias("weakest_expected_alignment"),
        ).alias("overall"),
    )
    return overall.crossJoin(by_score)

"""Two scores for the same rows: ranks, shifts, agreement and reclassification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import numeric, tag_scenario, with_numeric
from tessera.operators.order import average_rank
from tessera.operators.quantiles import quantile_table
from tessera.operators.report import top_fraction_rows, top_size
from tessera.runtime import attach, counted_hot, has_hot_group, keep, require, require_columns


def join_scores(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_score: str,
    right_score: str,
    left_label: str = "left",
    right_label: str = "right",
) -> DataFrame:
    """Inner join on the keys; the right side brings nothing but its score."""
    keys = list(keys)
    require_columns(left, [*keys, left_score], "left input")
    require_columns(right, [*keys, right_score], "right input")
    renamed = left.withColumnRenamed(left_score, f"{left_label}_score")
    other = right.select(*keys, F.col(right_score).alias(f"{right_label}_score"))
    return renamed.join(other, keys, "inner")


def rank_percentile(rank: Column, n: Column) -> Column:
    """1 for the best rank, 0 for the last; 1 in a group of one."""
    return F.when(rank.isNull(), None).when(n <= 1, 1.0).otherwise(1.0 - (rank - 1.0) / (n - 1.0))


def comparison_columns(
    df: DataFrame,
    by: str,
    left_label: str,
    right_label: str,
    top_fraction: float = 0.1,
    tie: Sequence[str] = ("cell_id",),
    hot: bool | None = None,
) -> DataFrame:
    """Ranks, percentiles, shifts and top-fraction status of two scores."""
    require(0 < top_fraction <= 1, "top_fraction must be in (0, 1]")
    a, b = left_label, right_label
    require_columns(df, [by, f"{a}_score", f"{b}_score", *tie])
    rows = with_numeric(df.where(F.col(by).isNotNull()), f"{a}_score", f"{b}_score")
    hot = has_hot_group(rows, [by]) if hot is None else hot
    for label in (a, b):
        rows = average_rank(rows, [by], f"{label}_score", f"{label}_rank_desc", descending=True, hot=hot)
    for label, side in ((a, "left"), (b, "right")):
        rows = top_fraction_rows(
            rows, [by], f"{label}_score", top_fraction, f"{side}_top_fraction_flag", tie, hot=hot
        )
    if hot:
        sizes = rows.groupBy(by).agg(F.count(f"{a}_score").alias("__na"), F.count(f"{b}_score").alias("__nb"))
        rows = attach(rows, sizes, [by])
    else:
        group = Window.partitionBy(by)
        rows = rows.withColumns({
            "__na": F.count(f"{a}_score").over(group), "__nb": F.count(f"{b}_score").over(group)
        })
    rows = rows.withColumns({
        f"{a}_percentile": rank_percentile(F.col(f"{a}_rank_desc"), F.col("__na")),
        f"{b}_percentile": rank_percentile(F.col(f"{b}_rank_desc"), F.col("__nb")),
    })
    shift = F.col(f"{b}_score") - F.col(f"{a}_score")
    rank_shift = F.col(f"{b}_rank_desc") - F.col(f"{a}_rank_desc")
    percentile_shift = F.col(f"{b}_percentile") - F.col(f"{a}_percentile")
    left_top, right_top = F.col("left_top_fraction_flag"), F.col("right_top_fraction_flag")
    status = (
        F.when(left_top & right_top, "stable_top_fraction")
        .when(right_top, "entered_top_fraction")
        .when(left_top, "exited_top_fraction")
        .otherwise("stable_non_top_fraction")
    )
    return rows.withColumns({
        f"{b}_minus_{a}": shift,
        f"{b}_rank_minus_{a}_rank": rank_shift,
        f"{b}_percentile_minus_{a}_percentile": percentile_shift,
        "abs_score_shift": F.abs(shift),
        "abs_rank_shift": F.abs(rank_shift),
        "abs_percentile_shift": F.abs(percentile_shift),
        "top_fraction_status": status,
    }).drop("__na", "__nb")


def comparison_shift(
    df: DataFrame,
    by: str,
    left_label: str,
    right_label: str,
    top_fraction: float = 0.1,
    scenario: str | None = None,
) -> DataFrame:
    a, b = left_label, right_label
    shift = f"{b}_minus_{a}"
    sizes = ["abs_score_shift", "abs_rank_shift", "abs_percentile_shift"]
    require_columns(df, [
        by, f"{a}_score", f"{b}_score", shift, f"{b}_rank_minus_{a}_rank",
        f"{b}_percentile_minus_{a}_percentile", *sizes, "top_fraction_status",
    ])
    valid = df.where(
        F.col(by).isNotNull() & F.col(f"{a}_score").isNotNull()
        & F.col(f"{b}_score").isNotNull() & F.col(shift).isNotNull()
    ).select(by, shift, *sizes, "top_fraction_status")

    def status_share(*names: str) -> Column:
        return F.avg(F.col("top_fraction_status").isin(*names).cast("double"))

    means = keep(valid.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(shift).alias("mean_score_shift"),
        *[F.avg(c).alias(f"mean_{c}") for c in sizes],
        status_share("stable_top_fraction").alias("stable_top_fraction_share"),
        status_share("entered_top_fraction").alias("entered_top_fraction_share"),
        status_share("exited_top_fraction").alias("exited_top_fraction_share"),
        status_share("entered_top_fraction", "exited_top_fraction").alias(
            "top_fraction_reclassification_share"
        ),
    ))
    hot = counted_hot(means, "n_rows", 4)
    levels = quantile_table(valid, [by], [shift, *sizes], [0.5, 0.9], hot).select(
        by,
        F.col(shift)[0].alias("median_score_shift"),
        *[F.col(c)[0].alias(f"median_{c}") for c in sizes],
        *[F.col(c)[1].alias(f"p90_{c}") for c in sizes],
    )
    out = means.join(levels, by).select(
        by,
        F.lit(a).alias("left_label"),
        F.lit(b).alias("right_label"),
        F.lit(float(top_fraction)).alias("top_fraction"),
        "n_rows",
        "mean_score_shift",
        "median_score_shift",
        *[f"{stat}_{c}" for c in sizes for stat in ("mean", "median", "p90")],
        "stable_top_fraction_share",
        "entered_top_fraction_share",
        "exited_top_fraction_share",
        "top_fraction_reclassification_share",
    )
    return tag_scenario(out, scenario)


def finite_corr(a: Column, b: Column) -> Column:
    """Aggregate: Pearson correlation over rows with both values, NULL where a
    side does not vary."""
    both = a.isNotNull() & b.isNotNull()
    left, right = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(left) * F.stddev_pop(right)
    return F.when(spread > 0, F.covar_pop(left, right) / spread)


def alignment(
    df: DataFrame,
    by: str,
    a: str,
    b: str,
    top_fraction: float = 0.1,
    tie: Sequence[str] = ("cell_id",),
    scenario: str | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Pearson and Spearman correlation and overlap of the two top fractions."""
    require_columns(df, [by, a, b, *tie])
    rows = df.where(F.col(by).isNotNull()).select(
        by, *dict.fromkeys(tie), numeric(a).alias("__a"), numeric(b).alias("__b")
    ).where(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    hot = has_hot_group(rows, [by]) if hot is None else hot
    rows = average_rank(rows, [by], "__a", "__ra", hot=hot)
    rows = average_rank(rows, [by], "__b", "__rb", hot=hot)
    rows = top_fraction_rows(rows, [by], "__a", top_fraction, "__ta", tie, hot=hot)
    rows = top_fraction_rows(rows, [by], "__b", top_fraction, "__tb", tie, hot=hot)
    n = F.count(F.lit(1))
    out = rows.groupBy(by).agg(
        n.alias("n_rows"),
        finite_corr(F.col("__a"), F.col("__b")).alias("pearson_corr"),
        finite_corr(F.col("__ra"), F.col("__rb")).alias("spearman_corr"),
        F.lit(float(top_fraction)).alias("top_fraction"),
        (F.count_if(F.col("__ta") & F.col("__tb")) / top_size(n, top_fraction)).alias("top_overlap_share"),
    )
    return tag_scenario(out, scenario)


def pca_alignment(df, by, composite, pca, top_fraction=0.1, tie=("cell_id",), scenario=None) -> DataFrame:
    return alignment(df, by, composite, pca, top_fraction, tie, scenario)


def compare_scores(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    by: str,
    left_score: str,
    right_score: str,
    left_label: str = "left",
    right_label: str = "right",
    top_fraction: float = 0.1,
    tie: Sequence[str] | None = None,
    scenario: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Agreement and shift summary per group, and the merged rows behind it."""
    tie = list(tie or keys)
    joined = keep(join_scores(left, right, keys, left_score, right_score, left_label, right_label))
    hot = has_hot_group(joined, [by])
    merged = keep(comparison_columns(joined, by, left_label, right_label, top_fraction, tie, hot))
    agreement = alignment(
        merged, by, f"{left_label}_score", f"{right_label}_score", top_fraction, tie, hot=hot
    )
    shifts = comparison_shift(merged, by, left_label, right_label, top_fraction).drop("n_rows")
    summary = agreement.select(
        by, F.lit(left_label).alias("left_label"), F.lit(right_label).alias("right_label"),
        *[c for c in agreement.columns if c != by],
    ).join(shifts, [by, "left_label", "right_label", "top_fraction"], "left")
    return tag_scenario(summary, scenario), merged

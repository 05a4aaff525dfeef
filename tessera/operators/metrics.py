"""Regression and classification metrics over prediction tables, per key.

Everything is computed from distinct predictions with counts, so ties cost one
row and no group is ordered inside a single task unless it is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.compare import finite_corr
from tessera.operators.order import average_rank, running_sums
from tessera.runtime import attach, keep, require_columns

REGRESSION = ("mae", "rmse", "r2", "pearson_corr", "spearman_corr")
CLASSIFICATION = ("roc_auc", "average_precision", "f1", "balanced_accuracy")


def regression_metrics(
    pred: DataFrame, by: Sequence[str] = ("protocol", "model"), truth: str = "rwi_true", guess: str = "rwi_pred"
) -> DataFrame:
    by = list(by)
    require_columns(pred, [*by, truth, guess])
    rows = pred.select(*by, F.col(truth).cast("double").alias("__y"), F.col(guess).cast("double").alias("__p"))
    rows = average_rank(average_rank(rows, by, "__y", "__ry"), by, "__p", "__rp")
    error = F.col("__y") - F.col("__p")
    n = F.count(F.lit(1))
    total = F.var_pop("__y") * n
    return rows.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        # A constant truth scores 1 if met exactly and 0 otherwise.
        F.when(n < 2, None).when(total > 0, 1 - F.sum(error * error) / total)
        .when(F.sum(error * error) == 0, 1.0).otherwise(0.0).alias("r2"),
        finite_corr(F.col("__y"), F.col("__p")).alias("pearson_corr"),
        finite_corr(F.col("__ry"), F.col("__rp")).alias("spearman_corr"),
    )


def classification_metrics(
    pred: DataFrame,
    by: Sequence[str] = ("protocol", "model"),
    truth: str = "low_wealth_true",
    prob: str = "low_wealth_prob",
    cut: float = 0.5,
) -> DataFrame:
    """ROC AUC, average precision, F1 and balanced accuracy; NULL for a key that
    holds one class only."""
    by = list(by)
    require_columns(pred, [*by, truth, prob])
    positive = F.col(truth).cast("double") > 0.5
    steps = keep(
        pred.groupBy(*by, F.col(prob).cast("double").alias("__s")).agg(
            F.count_if(positive).alias("__p"), F.count_if(~positive).alias("__q")
        )
    )
    steps = running_sums(steps, by, [F.col("__s").desc_nulls_last()], {"__cp": "__p", "__cq": "__q"})
    totals = steps.groupBy(*by).agg(F.sum("__p").alias("__np"), F.sum("__q").alias("__nq"))
    p, q, cp, cq = (F.col(c) for c in ("__p", "__q", "__cp", "__cq"))
    hit = F.col("__s") >= float(cut)
    sums = attach(steps, totals, by).groupBy(*by).agg(
        F.first("__np").alias("__np"),
        F.first("__nq").alias("__nq"),
        # A negative at this score loses to every positive above it and ties
        # with those at it.
        F.sum(q * (cp - p + p / 2.0)).alias("__wins"),
        F.sum(p * cp / (cp + cq)).alias("__precision"),
        F.coalesce(F.sum(F.when(hit, p)), F.lit(0)).alias("__tp"),
        F.coalesce(F.sum(F.when(hit, q)), F.lit(0)).alias("__fp"),
    )
    np_, nq = F.col("__np"), F.col("__nq")
    both = (np_ > 0) & (nq > 0)

    def if_both(value: Column) -> Column:
        return F.when(both, value)

    tp, fp = F.col("__tp"), F.col("__fp")
    return sums.select(
        *by,
        if_both(F.col("__wins") / (np_ * nq)).alias("roc_auc"),
        if_both(F.col("__precision") / np_).alias("average_precision"),
        if_both(2 * tp / (np_ + tp + fp)).alias("f1"),
        if_both((tp / np_ + (nq - fp) / nq) / 2.0).alias("balanced_accuracy"),
    )


def long_metrics(table: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return table.unpivot(list(by), list(names), "metric", "value")


def all_metrics(pred: DataFrame, by: Sequence[str] = ("protocol", "model")) -> DataFrame:
    """Long metric table ``protocol, model, metric, value`` of both families."""
    return long_metrics(regression_metrics(pred, by), by, REGRESSION).unionByName(
        long_metrics(classification_metrics(pred, by), by, CLASSIFICATION)
    )

"""Weak labels: an external point signal carried to cells by nearest samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import numeric
from tessera.operators.compare import finite_corr
from tessera.operators.near import weighted_knn
from tessera.operators.order import average_rank
from tessera.operators.transform import percent_rank
from tessera.runtime import keep, require, require_columns


def weak_targets(
    cells: DataFrame,
    samples: DataFrame,
    by: str = "city",
    country: str = "country_iso",
    score: str = "deprivation_index_0_100",
    neighbors: int = 4,
    max_distance: float = 4000.0,
    low_quantile: float = 0.2,
    id: str = "cell_id",
    sample_id: str = "sample_id",
    x: str = "x",
    y: str = "y",
) -> tuple[DataFrame, DataFrame]:
    """Cells with the wealth signal of their country's nearest samples, its rank
    within the city and the low-wealth flag; and one report row per city.
    Countries are a join key, so all are done in one job."""
    require_columns(cells, [id, by, country, score, x, y], "cells")
    require_columns(samples, [country, sample_id, "rwi", "error", x, y], "samples")
    require(0 < low_quantile < 1, "low_quantile must be in (0, 1)")
    signal = weighted_knn(
        cells, samples, [country], ["rwi", "error"], neighbors, max_distance, 25.0, id, sample_id, x, y
    ).withColumnsRenamed({
        "rwi": "rwi_mean",
        "error": "rwi_error_weighted_mean",
        "max_neighbor_distance": "rwi_max_neighbor_distance_m",
        "neighbor_count": "rwi_neighbor_count",
    })
    joined = keep(cells.join(signal, [country, id], "left"))
    ranked = percent_rank(joined, by, "rwi_mean", "rwi_within_city_percentile")
    out = ranked.withColumns({
        "rwi_label_available": F.coalesce(F.col("rwi_neighbor_count") > 0, F.lit(False)),
        "rwi_bottom_quantile_flag": F.coalesce(
            F.col("rwi_within_city_percentile") <= float(low_quantile), F.lit(False)
        ),
        "rwi_deprivation_proxy_0_100": (1.0 - F.col("rwi_within_city_percentile")) * 100.0,
    })
    return out, target_report(out, by, country, score)


def target_report(targets: DataFrame, by: str, country: str, score: str) -> DataFrame:
    rows = targets.where(F.col(by).isNotNull()).withColumn("__s", numeric(score))
    both = F.col("__s").isNotNull() & F.col("rwi_mean").isNotNull()
    rows = rows.withColumns({"__a": F.when(both, F.col("rwi_mean")), "__b": F.when(both, F.col("__s"))})
    rows = average_rank(average_rank(rows, [by], "__a", "__ra"), [by], "__b", "__rb")
    spearman = finite_corr(F.col("__ra"), F.col("__rb"))
    return rows.groupBy(by).agg(
        F.min(country).alias(country),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("rwi_mean").alias("rwi_mean_min"),
        F.max("rwi_mean").alias("rwi_mean_max"),
        spearman.alias("spearman_corr_rwi_vs_score"),
        (-spearman).alias("spearman_corr_rwi_vs_negative_score"),
        F.avg("rwi_max_neighbor_distance_m").alias("mean_max_neighbor_distance_m"),
        F.avg(F.col("rwi_label_available").cast("double")).alias("label_coverage_share"),
    )

"""Composite 0-100 index from weighted, direction-aligned, standardised features."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import drop_debug_columns, numeric, weighted_average
from tessera.operators.compare import finite_corr
from tessera.operators.order import dense_rank_desc
from tessera.operators.quantiles import quantile_table
from tessera.operators.transform import minmax_0_100, winsorize, zscore
from tessera.runtime import hot_group_rows, keep, require, require_columns


class IndexResult(NamedTuple):
    table: DataFrame
    features: DataFrame  # name, dimension, direction, median used, PCA loading


def impute_medians(df: DataFrame, columns: list[str], hot: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Fill missing values with the column median, or 0 if all are missing.
    Returns the filled rows and the one row of medians."""
    medians = quantile_table(df, [], columns, [0.5], hot=hot)
    used = keep(medians.select(*[F.coalesce(F.col(c)[0], F.lit(0.0)).alias(f"__med_{c}") for c in columns]))
    filled = df.crossJoin(F.broadcast(used)).withColumns({
        c: F.coalesce(F.col(c), F.col(f"__med_{c}")) for c in columns
    })
    return filled.drop(*used.columns), used


def pca_first(df: DataFrame, columns: list[str], reference: str, out: str) -> tuple[DataFrame, list[float]]:
    """Score of the first principal component of the standardised columns, its
    sign turned to agree with ``reference``."""
    standard = zscore(df, columns, suffix="__std")
    inputs = [f"{c}__std" for c in columns]
    vectors = keep(VectorAssembler(inputCols=inputs, outputCol="__vec").transform(standard).drop(*inputs))
    model = PCA(k=1, inputCol="__vec", outputCol="__pc").fit(vectors)
    scored = model.transform(vectors).withColumn(out, vector_to_array("__pc")[0]).drop("__vec", "__pc")
    agreement = scored.agg(finite_corr(F.col(out), F.col(reference)).alias("r")).first()["r"]
    sign = -1.0 if agreement is not None and agreement < 0 else 1.0
    loadings = [sign * float(v) for v in model.pc.toArray()[:, 0]]
    return scored.withColumn(out, F.col(out) * F.lit(sign)), loadings


def build_index(df: DataFrame, config: Mapping) -> IndexResult:
    features = list(config.get("features", []))
    names = [f["name"] for f in features]
    require_columns(df, names)
    scaling = config.get("output_scaling") or {}
    winsor_by = config.get("winsorize_group_col")
    z_by = config.get("feature_standardization_group_col")
    out_by = scaling.get("group_col")
    require_columns(df, [winsor_by, z_by, out_by])
    # A table that fits a task has no group that does not.
    hot = None if df.count() * len(names) > hot_group_rows(df.sparkSession) else False

    work = df.withColumns({f"{n}__aligned": numeric(n) for n in names})
    aligned = [f"{n}__aligned" for n in names]
    work, medians = impute_medians(work, aligned, hot)
    if config.get("winsorize_quantiles"):
        low, high = (float(q) for q in config["winsorize_quantiles"])
        work = winsorize(work, aligned, [low, high], winsor_by, hot)
    flipped = {
        f"{f['name']}__aligned": -F.col(f"{f['name']}__aligned")
        for f in features if not f.get("higher_is_more_deprived", True)
    }
    work = work.withColumns(flipped) if flipped else work
    bound = config.get("feature_zscore_clip")
    work = zscore(work, aligned, z_by, None if bound is None else float(bound), suffix="__std")
    work = work.withColumnsRenamed({f"{a}__std": a.replace("__aligned", "__z") for a in aligned})

    parts: dict[str, list[tuple[str, float]]] = {}
    for f in features:
        parts.setdefault(f["dimension"], []).append((f"{f['name']}__z", float(f.get("feature_weight", 1.0))))
    work = work.withColumns({f"{d}__score": weighted_average(p) for d, p in parts.items()})
    dimension_weights = config.get("dimension_weights") or {}
    work = keep(work.withColumn("deprivation_index_z", weighted_average(
        [(f"{d}__score", float(dimension_weights.get(d, 1.0))) for d in parts]
    )))
    ends = (scaling.get("lower_quantile"), scaling.get("upper_quantile"))
    work = minmax_0_100(work, {"deprivation_index_z": "deprivation_index_0_100"}, *ends, by=out_by, hot=hot)
    work = dense_rank_desc(work, "deprivation_index_z", "deprivation_rank_desc", hot=hot)
    loadings: list[float | None] = [None] * len(names)
    pca = config.get("pca") or {}
    if pca.get("enabled", False):
        require(int(pca.get("n_components", 1)) >= 1, "n_components must be at least 1")
        work, loadings = pca_first(work, aligned, "deprivation_index_z", "pca1_index_z")
        work = minmax_0_100(work, {"pca1_index_z": "pca1_index_0_100"}, *ends, by=out_by, hot=hot)
    if not config.get("keep_debug_columns", True):
        work = drop_debug_columns(work)
    summary = medians.select(F.explode(F.array(*[
        F.struct(
            F.lit(f["name"]).alias("name"),
            F.lit(f["dimension"]).alias("dimension"),
            F.lit(bool(f.get("higher_is_more_deprived", True))).alias("higher_is_more_deprived"),
            F.col(f"__med_{f['name']}__aligned").alias("median_used"),
            F.lit(loading).cast("double").alias("pca_loading"),
        )
        for f, loading in zip(features, loadings)
    ])).alias("f")).select("f.*")
    return IndexResult(work, summary)

"""Point samples of an external signal and array datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import numeric
from tessera.runtime import require_columns

SAMPLE_COLUMNS = ("latitude", "longitude", "rwi", "error")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of all countries in one scan; the country is the part of the name
    before the first underscore, of a csv file or a folder of its parts."""
    raw = spark.read.csv(path, header=True)
    require_columns(raw, SAMPLE_COLUMNS, "sample file")
    country = F.regexp_extract(F.col("_metadata.file_path"), r"([^/_]+)_[^/]*\.csv(?:/[^/]*)?$", 1)
    return raw.select(*[numeric(c).alias(c) for c in SAMPLE_COLUMNS], country.alias("country_iso"))


def array_dataset(
    df: DataFrame, features: Sequence[str], patch: str = "patch", id: str = "cell_id", by: str = "city",
    regression: str = "rwi_mean", classification: str = "rwi_bottom_quantile_flag", mask: str = "rwi_label_available",
) -> DataFrame:
    """Rows with the feature vector and patch as arrays, targets and label mask."""
    require_columns(df, [id, by, regression, classification, *features])
    held = F.col(mask).cast("boolean") if mask in df.columns else F.col(regression).isNotNull()
    columns = [
        F.col(id).cast("string").alias("cell_id"),
        F.col(by).cast("string").alias("city"),
        F.array(*[numeric(c).cast("float") for c in features]).alias("features"),
    ]
    if patch in df.columns:
        columns.append(F.col(patch).cast("array<float>").alias("patch"))
    return df.select(
        *columns,
        numeric(regression).cast("float").alias("regression_target"),
        F.col(classification).cast("boolean").cast("float").alias("classification_target"),
        held.alias("label_mask"),
    )


def write_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("city").parquet(path)


def read_arrays(spark: SparkSession, path: str, cities: Sequence[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("city").isin(*cities)) if cities else rows

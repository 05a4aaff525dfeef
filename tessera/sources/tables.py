"""Table readers and writers chosen by suffix."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tessera.functions.columns import select_available
from tessera.sources.geojson import read_geojson, to_features


class UnsupportedFormat(ValueError):
    """Raised for a path whose suffix names no known format."""


def _suffix(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


def _named_types(schema: StructType | str | None) -> dict[str, str] | None:
    if schema is None:
        return None
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return {f.name: f.dataType.simpleString() for f in fields}


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """csv, tsv, json, GeoJSON or parquet. Give a schema to spare the pass that
    infers one."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    infer = schema is None
    match _suffix(path):
        case ".csv":
            return reader.csv(path, header=True, inferSchema=infer)
        case ".tsv":
            return reader.csv(path, header=True, sep="\t", inferSchema=infer)
        case ".json":
            return reader.json(path, multiLine=True)
        case ".jsonl":
            return reader.json(path)
        case ".geojson":
            return read_geojson(spark, path, _named_types(schema))
        case ".parquet" | "":
            return reader.parquet(path)
        case other:
            raise UnsupportedFormat(f"no reader for {other or path}")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a folder of part files in the format of the suffix."""
    writer = df.write.mode(mode)
    match _suffix(path):
        case ".csv":
            flatten(df).write.mode(mode).csv(path, header=True)
        case ".tsv":
            flatten(df).write.mode(mode).csv(path, header=True, sep="\t")
        case ".json" | ".jsonl":
            writer.json(path, ignoreNullFields=False)
        case ".geojson":
            to_features(df).write.mode(mode).text(path)
        case ".parquet" | "":
            writer.parquet(path)
        case other:
            raise UnsupportedFormat(f"no writer for {other or path}")


def write_json(df: DataFrame, path: str, stamp: bool = True, mode: str = "overwrite") -> None:
    """Write a small nested table as JSON text, one document per row, with the
    time it was made."""
    row = df.withColumn("generated_at_utc", F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )) if stamp else df
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    row.select(text).write.mode(mode).text(path)


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for sinks that hold flat values only."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def read_layer(spark: SparkSession, root: str, layer: str, cities: list[str] | None = None) -> DataFrame:
    """A layer of a table partitioned by ``layer`` and ``city``; only the named
    partitions are read."""
    rows = spark.read.parquet(root).where(F.col("layer") == layer)
    return rows.where(F.col("city").isin(*cities)) if cities else rows


def write_layers(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("layer", "city").parquet(root)


# The tag columns kept of each map layer.
LAYER_COLUMNS: Mapping[str, tuple[str, ...]] = {
    "boundary": ("display_name", "osm_type", "osm_id", "geometry"),
    "road_nodes": ("osmid", "street_count", "highway", "geometry"),
    "roads": ("u", "v", "key", "osmid", "name", "highway", "oneway", "length", "geometry"),
    "amenities": ("element_type", "osmid", "amenity", "healthcare", "name", "geometry"),
}


def layer_columns(df: DataFrame, layer: str) -> DataFrame:
    return select_available(df, [*LAYER_COLUMNS[layer], "layer", "city"])


def study_counts(cells: DataFrame, by: str = "city", country: str = "country_iso") -> DataFrame:
    """Grid rows per city of a study built in one job."""
    return cells.groupBy(by, country).agg(F.count(F.lit(1)).alias("grid_rows"))

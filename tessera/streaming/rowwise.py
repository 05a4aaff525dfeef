"""Row-local operators on a stream. They hold no state, so the batch functions
are used as they are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.functions.columns import analysis_mask, composite_column, tag_scenario


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the parquet files arriving at ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def mask_and_label(
    stream: DataFrame,
    conditions: Sequence[Mapping],
    mode: str = "any",
    labels: Sequence[str] = (),
    out: str = "label",
    scenario: str | None = None,
) -> DataFrame:
    """Analysis mask, composite label and scenario tag of arriving rows."""
    rows = analysis_mask(stream, conditions, mode)
    if labels:
        rows = composite_column(rows, labels, out)
    return tag_scenario(rows, scenario)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet and stop once all present files are read. The stream's
    own checkpoint makes each file count once."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

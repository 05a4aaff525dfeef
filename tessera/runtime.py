"""Session helpers: lineage cuts, size checks and guarded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A group above this many rows is never put into one window task.
HOT_GROUP_CONF = "tessera.hotGroupRows"
HOT_GROUP_ROWS = 2_000_000
# A lookup side above this many rows is never broadcast.
BROADCAST_CONF = "tessera.broadcastRows"
BROADCAST_ROWS = 200_000
# The folder of the open scope of kept tables.
SCOPE_CONF = "tessera.scope"
# Bytes after which a batch on its way to Python is full.
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


class MissingColumns(ValueError):
    """Raised while a plan is built when an input lacks a needed column."""


def require_columns(df: DataFrame, columns: Iterable[str | None], what: str = "input") -> None:
    absent = [c for c in columns if c and c not in df.columns]
    if absent:
        raise MissingColumns(f"{what} lacks columns: {', '.join(absent)}")


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def hot_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_GROUP_CONF, str(HOT_GROUP_ROWS)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_CONF, str(BROADCAST_ROWS)))


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python by bytes, unless the session does so
    itself. By rows alone, 10,000 texts or sets are one batch, held several times
    over outside the heap. Plans read the setting when they run, so it stays."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def _shared_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints; only a local session, which has
    one machine, may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the shared folder, or in the open scope's part of it."""
    folder = spark.conf.get(SCOPE_CONF, None) or _shared_folder(spark)
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


@contextmanager
def kept_tables(spark: SparkSession) -> Iterator[str]:
    """A scope for kept tables: what is kept inside lies in a folder of its own,
    which is deleted at the end. Results must be written or collected before."""
    outer = spark.conf.get(SCOPE_CONF, None)
    folder = f"{outer or _shared_folder(spark)}/scope-{uuid.uuid4().hex}"
    spark.conf.set(SCOPE_CONF, folder)
    try:
        yield folder
    finally:
        if outer:
            spark.conf.set(SCOPE_CONF, outer)
        else:
            spark.conf.unset(SCOPE_CONF)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back. Later
    passes neither recompute it nor depend on the executors that made it, and
    read only the columns they use."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` wrote. No plan that is still to run may read
    them, so whatever depends on them must have been kept or collected."""
    for df in kept:
        spark = df.sparkSession
        root = _shared_folder(spark).rstrip("/")
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            require(f"/{root.rsplit('/', 1)[-1]}/" in folder, f"{folder} is not a kept table")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(kept: DataFrame) -> DataFrame:
    """Mark a materialised join side by its counted rows: broadcast if they are
    few, else a merge join. The merge hint also keeps Spark from broadcasting
    the other side, whose estimate knows nothing of an explode before the join."""
    if kept.count() <= broadcast_rows(kept.sparkSession):
        return F.broadcast(kept)
    return kept.hint("merge")


def lookup(small: DataFrame) -> DataFrame:
    """Materialise a lookup table. Its files tell Spark its size, so whether it
    is broadcast follows from that and needs no count."""
    return keep(small)


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group statistics to rows. With no keys ``stats`` is the one row
    of a global aggregate, the only cross join used."""
    if not by:
        return df.crossJoin(F.broadcast(keep(stats)))
    return df.join(lookup(stats), list(by), how)


def has_hot_group(df: DataFrame, by: Sequence[str], columns: int = 1) -> bool:
    """True if a group holds more rows, times the columns held of each, than one
    task should sort or keep in memory."""
    if by:
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = df.agg(F.count(F.lit(1)).alias("n"))
    return counted_hot(counts, "n", columns)


def counted_hot(counts: DataFrame, n: str, columns: int = 1) -> bool:
    """The same from a table that already has each group's row count."""
    top = counts.agg(F.max(n).alias("n")).first()["n"]
    return (top or 0) * columns > hot_group_rows(counts.sparkSession)

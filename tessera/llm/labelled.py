"""Labelled documents for the trained operators: all of them, or bounded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import keep


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def labelled_ids(labels: DataFrame, label: str, doc_id: str = "doc_id", learnable: Column | None = None) -> DataFrame:
    """(doc_id, label) of the labelled documents; one with several labels counts
    by their largest, rows with a null id or label are left out."""
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    if learnable is not None:
        usable = usable.where(learnable)
    return keep(usable.groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("label")))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text", learnable: Column | None = None,
) -> DataFrame:
    """(text, label, weight) of at most ``rows`` different texts of each label,
    those of smallest hash; the weights of a label's texts add up to its share
    of the labelled documents. A document with several labels counts by their
    largest; rows with a null id, text or label are left out. The chosen ids, at
    most 4 x ``rows``, are broadcast, so the texts are read once and not shuffled."""
    ids = labelled_ids(labels, label, doc_id, learnable)
    near = F.xxhash64(doc_id)
    # Twice as many ids as texts are wanted, as copies fall away.
    chosen = [ids.where(F.col("label") == v).orderBy(near, doc_id).limit(2 * rows) for v in (0, 1)]
    chosen = keep(chosen[0].unionByName(chosen[1]).select(F.col(doc_id).alias("__id"), "label"))
    found = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "__id")
    texts = keep(found.groupBy(F.xxhash64("text").alias("h")).agg(F.max_by("text", "label").alias("text"), F.max("label").alias("label")))
    both = keep(texts.where("label = 0").orderBy("h").limit(rows).unionByName(texts.where("label = 1").orderBy("h").limit(rows)).select("text", "label"))
    counted = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r["label"]: r["n"] for r in both.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = {k: counted[k] / sum(counted.values()) / n for k, n in got.items()}
    return both.withColumn("weight", F.when(F.col("label") == 1, weight.get(1, 0.0)).otherwise(weight.get(0, 0.0)))


def as_vector(columns: Sequence[str]) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.array(*columns))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))

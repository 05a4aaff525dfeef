"""From raw documents to a training mix: filter, deduplicate, decontaminate, redact, mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, labelled, mixing, secrets, setjoin, toxicity
from tessera.runtime import shared_path

# Near copies of the corpus: words of a shingle, and hundredths of the union that two texts share at least.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. The model learns from the labels, held-out ones left aside."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn_toxicity(docs, labels, learnable=~labelled.held_out(F.col("doc_id"), 5, 0))
    return toxicity.remove_toxic(docs, model)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked 5-word shingle sets stays."""
    return setjoin.keep_one(docs, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; all documents stay, n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their share of the mix: size, source_size, target, copies and taken."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_duplicates_out),
    ("benchmark_decontamination", benchmark_out),
    ("secret_scan", secrets_masked),
    ("source_mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = shared_path(spark)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


# Learned scores and components are not expressible; tests compare with a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}

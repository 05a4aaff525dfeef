"""Token counts as rollups maintained by deltas.

A change is a document version with a sign: an insert adds its counts, a delete takes
them away, and a revision is the old version taken away and the new one added. Counts
are additive, so a batch of changes is one small table of signed totals by source,
language and tokenizer version, and the rollup is the sum of all batches.

A batch is committed by writing the folder of its id. Writing it again, after a lost
driver or a replayed feed, replaces that folder, also by an empty one: no count enters
twice. Totals read committed batches only; ``compact`` folds those up to an id into one,
and may be repeated too.

Defined cases: a null text has no tokens but is a document; null sources and languages
are groups of their own; groups whose counts cancel out stay, with zeros, unless
``nonzero`` is asked for; a document repeated in a batch counts as often as it occurs;
an empty batch commits no rows; extra columns of the changes are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import require, require_columns

KEYS = ("source", "lang", "tokenizer")

# Tokenizer versions that are patterns: a token is a match.
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"}


def pattern_tokenizer(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def vocabulary_tokenizer(path: str) -> Callable[[Column], Column]:
    """Token counts by a vocabulary file of the tokenizers library; the file
    must lie at ``path`` on every executor."""

    @F.pandas_udf(T.LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for texts in parts:
            found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            yield pd.Series([len(x.ids) for x in found], dtype="int64")

    return lambda text: count(text)


TOKENIZERS: Mapping[str, Callable[[Column], Column]] = {n: pattern_tokenizer(p) for n, p in PATTERNS.items()}


def inserts(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sign", F.lit(1))


def deletes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes from the old to the new version of the same documents."""
    return deletes(old).unionByName(inserts(new))


def signed_totals(changes: DataFrame, tokenizers: Mapping[str, Callable[[Column], Column]] = TOKENIZERS, text: str = "text") -> DataFrame:
    """(source, lang, tokenizer, documents, tokens): the batch's delta. Every
    text is read once for all tokenizers and summed before anything is shuffled."""
    require_columns(changes, ["source", "lang", "sign", text], "changes")
    require(bool(tokenizers), "a rollup needs a tokenizer version")
    names = list(tokenizers)
    counted = changes.select("source", "lang", F.col("sign").cast("long").alias("sign"), *[tokenizers[n](F.col(text)).alias(f"__t{i}") for i, n in enumerate(names)])
    sums = counted.groupBy("source", "lang").agg(F.sum("sign").alias("documents"), *[F.sum(F.col("sign") * F.col(f"__t{i}")).alias(f"__t{i}") for i in range(len(names))])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(f"__t{i}").alias("tokens")) for i, n in enumerate(names)]))
    return sums.withColumn("x", each).select("source", "lang", F.col("x.tokenizer").alias("tokenizer"), "documents", F.col("x.tokens").alias("tokens"))


_STORED = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("tokenizer", T.StringType()), T.StructField("documents", T.LongType()),
    T.StructField("tokens", T.LongType()), T.StructField("batch", T.LongType()),
])


def commit(delta: DataFrame, path: str, batch: int) -> None:
    """Write the delta as batch ``batch``, in place of any earlier try, of which
    nothing is left even if the delta is empty. Its rows appear when the whole
    write has succeeded."""
    require(batch >= 0, "batches are numbered from 0")
    rows = delta.select(*[F.col(f.name).cast(f.dataType) for f in _STORED.fields[:-1]]).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path)


def totals(spark: SparkSession, path: str, upto: int | None = None, nonzero: bool = False) -> DataFrame:
    """The rollup, as of a batch if one is given; only its partitions are read."""
    known = batches(spark, path)
    if upto is not None:
        known = known.where(F.col("batch") <= upto)
    summed = known.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return summed.where("documents <> 0 OR tokens <> 0") if nonzero else summed


def compact(spark: SparkSession, path: str, upto: int, target: str) -> None:
    """Write the batches up to ``upto`` as one, and the later ones as they are,
    to another folder, in place of all that is there; readers move over when it is
    whole. Batches are small tables of totals, whatever the documents were."""
    folded = totals(spark, path, upto).withColumn("batch", F.lit(upto).cast("long"))
    later = batches(spark, path).where(F.col("batch") > upto)
    together = folded.unionByName(later).repartition("batch")
    together.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("batch").parquet(target)

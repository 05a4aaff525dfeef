"""Hold-out protocols and exact seeded splits as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import number_rows
from tessera.runtime import attach, keep, require, require_columns

STRATEGIES = ("auto", "pairwise", "leave_one_city_out", "all_pairs")


def _slug(column: str) -> Column:
    return F.replace(F.lower(F.col(column).cast("string")), F.lit(" "), F.lit("_"))


def seeded_share(
    df: DataFrame, strata: Sequence[str], share: float, id: str, seed: int, out: str
) -> DataFrame:
    """Mark an exact, seeded share of each stratum: the first
    ``round(n * share)`` rows in hash order."""
    strata = list(strata)
    # Several passes follow, and the input may be a join of large tables.
    df = keep(df)
    shuffled = df.withColumn("__h", F.xxhash64(F.col(id), F.lit(int(seed))))
    numbered = number_rows(shuffled, strata, [F.col("__h"), F.col(id)], "__r")
    n = F.count(F.lit(1)).alias("__n")
    sizes = df.groupBy(*strata).agg(n) if strata else df.agg(n)
    wanted = F.round(F.col("__n") * F.lit(float(share)))
    return attach(numbered, sizes, strata).withColumn(out, F.col("__r") <= wanted).drop("__h", "__r", "__n")


def can_stratify(df: DataFrame, strata: Sequence[str], share: float = 0.2) -> bool:
    """Whether each stratum can appear on both sides of a split."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.count(F.lit(1)).alias("s"), F.min("n").alias("low"), F.sum("n").alias("n")).first()
    if not row["s"]:
        return False
    test = round(row["n"] * share)
    return row["s"] >= 2 and row["low"] >= 2 and test >= row["s"] and row["n"] - test >= row["s"]


def pooled_split(df: DataFrame, by: str, cls: str, id: str = "cell_id", seed: int = 42) -> DataFrame:
    """80/20 split, by city and class where every stratum is large enough."""
    rows = df.withColumn("__c", F.col(cls).cast("int"))
    strata = [by, "__c"] if can_stratify(rows, [by, "__c"]) else []
    marked = seeded_share(rows, strata, 0.2, id, seed, "__test")
    return marked.select(id, by, F.lit("pooled_random").alias("protocol"), _role(F.col("__test")))


def _role(test: Column) -> Column:
    return F.when(test, "test").otherwise("train").alias("role")


def protocol_splits(
    df: DataFrame,
    by: str = "city",
    cls: str = "rwi_bottom_quantile_flag",
    mask: str = "label_mask",
    seed: int = 42,
    strategy: str = "auto",
    id: str = "cell_id",
) -> DataFrame:
    """Rows ``protocol, cell_id, role`` of the pooled split and the transfer
    protocols. A row appears once per protocol that uses it."""
    require_columns(df, [id, by, cls, mask])
    require(strategy in STRATEGIES, f"unknown strategy {strategy}")
    labelled = keep(df.where(F.col(mask)).select(id, by, cls))
    cities = keep(labelled.select(F.col(by).cast("string").alias("__city")).distinct())
    n = cities.count()
    if strategy == "auto":
        strategy = "pairwise" if n == 2 else "leave_one_city_out"
    require(n >= 2, "a transfer protocol needs at least two cities")
    out = pooled_split(labelled, by, cls, id, seed).select("protocol", id, "role")
    own = F.col(by).cast("string")
    if strategy == "leave_one_city_out":
        # Every labelled row takes part in every city's hold-out.
        listed = cities.agg(F.collect_set("__city").alias("__all"))
        spread = attach(labelled, listed, []).withColumn("__city", F.explode("__all"))
        rows = spread.select(
            F.concat(F.lit("holdout_"), _slug("__city")).alias("protocol"), id, _role(own == F.col("__city"))
        )
    else:
        rows = _pair_rows(labelled, _pairs(cities, strategy), by, id)
    return out.unionByName(rows)


def _pairs(cities: DataFrame, strategy: str) -> DataFrame:
    source = cities.select(F.col("__city").alias("__source"))
    target = cities.select(F.col("__city").alias("__target"))
    pairs = source.join(target, F.col("__source") != F.col("__target"))
    if strategy == "all_pairs" or cities.count() == 2:
        return keep(pairs)
    return keep(pairs.orderBy("__source", "__target").limit(1))


def _pair_rows(labelled: DataFrame, pairs: DataFrame, by: str, id: str) -> DataFrame:
    named = pairs.withColumn("protocol", F.concat(_slug("__source"), F.lit("_to_"), _slug("__target")))
    sides = named.select("protocol", F.col("__source").alias("__side"), F.lit("train").alias("role")).unionByName(
        named.select("protocol", F.col("__target").alias("__side"), F.lit("test").alias("role"))
    )
    return labelled.join(sides, F.col(by).cast("string") == F.col("__side")).select("protocol", id, "role")


def train_validation_split(
    df: DataFrame, cls: str, id: str = "cell_id", seed: int = 42, share: float = 0.15, smallest: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Stratified split of training rows; a tiny table is used for both sides."""
    df = keep(df)
    if df.limit(smallest).count() < smallest:
        return df, df
    marked = keep(seeded_share(df.withColumn("__c", F.col(cls).cast("int")), ["__c"], share, id, seed, "__v"))
    return marked.where(~F.col("__v")).drop("__c", "__v"), marked.where("__v").drop("__c", "__v")

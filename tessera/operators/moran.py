"""Spatial autocorrelation over nearest-neighbour weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import numeric
from tessera.functions.geo import normal_sf
from tessera.operators.near import knn_edges
from tessera.operators.order import number_rows
from tessera.operators.quantiles import quantile_table
from tessera.runtime import attach, keep, lookup, require, require_columns

# Cluster names by Moran quadrant, and the significance level.
QUADRANTS = {1: "high_high", 2: "low_high", 3: "low_low", 4: "high_low"}
SIGNIFICANCE = 0.05
# Random neighbour sets behind a pseudo p-value, and rows compared with all of them at once.
PERMUTATIONS = 999
_BLOCK = 1_024


def moran(
    df: DataFrame,
    score: str,
    x: str = "x",
    y: str = "y",
    k: int = 8,
    by: str | None = None,
    id: str = "cell_id",
    permutations: int | None = PERMUTATIONS,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Global and local Moran statistics with row-standardised kNN weights.

    Returns one row per group, and the rows with ``local_moran_i``, its pseudo
    p-value, quadrant and cluster label. The p-value is counted from
    ``permutations`` seeded random neighbour sets (``conditional_p``); without
    them it is the one-sided normal tail of the lag under conditional
    randomisation. The global p-value is the normal one.
    """
    keys = [by] if by else []
    require_columns(df, [score, x, y, id, *keys])
    rows = df.withColumn("__y", numeric(score))
    medians = quantile_table(rows, keys, ["__y"], [0.5])
    medians = medians.select(*keys, F.coalesce(F.col("__y")[0], F.lit(0.0)).alias("__med"))
    rows = attach(rows, medians, keys).withColumn("__y", F.coalesce("__y", "__med")).drop("__med")
    stats = rows.groupBy(*keys) if by else rows
    table = keep(stats.agg(
        F.count(F.lit(1)).alias("__n"), F.avg("__y").alias("__mean"), F.stddev_pop("__y").alias("__sd")
    ))
    require(table.where(F.col("__n") < 3).isEmpty(), "at least three rows are needed per group")
    rows = keep(attach(rows, table, keys).withColumn("__z", F.col("__y") - F.col("__mean")))
    edges = keep(knn_edges(rows, keys, k, id, x, y))
    scores = rows.select(*keys, F.col(id).alias("dst"), "__z")
    lags = edges.join(scores, [*keys, "dst"]).groupBy(*keys, F.col("src").alias(id)).agg(
        F.avg("__z").alias("__lag"), F.count(F.lit(1)).alias("__k")
    )
    local = rows.join(lags, [*keys, id])
    n, z, lag = F.col("__n"), F.col("__z"), F.col("__lag")
    m2 = n * F.col("__sd") * F.col("__sd")
    local = local.withColumns({
        "local_moran_i": F.when(m2 > 0, (n - 1) * z * lag / m2),
        "local_moran_quadrant": F.when(z > 0, F.when(lag > 0, 1).otherwise(4)).otherwise(
            F.when(lag > 0, 2).otherwise(3)
        ),
        "__p_normal": _conditional_p(n, z, lag, F.col("__k"), m2),
    })
    if permutations:
        local = _permuted(keep(local), rows, keys, id, permutations, seed)
    else:
        local = local.withColumn("local_moran_p", F.col("__p_normal"))
    label = F.when(F.col("local_moran_p") >= SIGNIFICANCE, "not_significant")
    for quadrant, name in QUADRANTS.items():
        label = label.when(F.col("local_moran_quadrant") == quadrant, name)
    local = local.withColumn("local_moran_cluster", label.otherwise("unknown"))
    summed = (local.groupBy(*keys) if by else local).agg(
        F.first("__n").alias("n_observations"),
        F.max("__k").alias("k_neighbors"),
        F.when(F.first(m2) > 0, F.sum(z * lag) / F.first(m2)).alias("moran_i"),
        F.first("__mean").alias("score_mean"),
        F.first("__sd").alias("score_std"),
    )
    weights = _weight_moments(edges, keys)
    overall = (summed.join(weights, keys) if by else summed.crossJoin(F.broadcast(weights))).withColumn(
        "moran_p", _global_p(F.col("moran_i"), F.col("n_observations"), F.col("__s1"), F.col("__s2"))
    ).drop("__s1", "__s2")
    dropped = ["__y", "__n", "__mean", "__sd", "__z", "__lag", "__k", "__p_normal"]
    return overall, local.drop(*dropped)


def _conditional_p(n: Column, z: Column, lag: Column, k: Column, m2: Column) -> Column:
    """One-sided tail of a lag of ``k`` draws without replacement from the
    other rows."""
    mean = -z / (n - 1)
    spread = (m2 - z * z) / (n - 1) - mean * mean
    variance = spread / k * (n - 1 - k) / (n - 2)
    deviate = F.abs(lag - mean) / F.sqrt(variance)
    return F.when(variance > 0, normal_sf(deviate)).otherwise(F.lit(1.0))


def _weight_moments(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Sums S1 and S2 of the row-standardised weights, per group."""
    w = edges.select(*keys, "src", "dst", (1.0 / F.count(F.lit(1)).over(_rows(keys))).alias("w"))
    pairs = w.unionByName(w.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    both = pairs.groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w"))
    incoming = w.groupBy(*keys, F.col("dst").alias("src")).agg(F.sum("w").alias("__in"))
    s2_terms = w.select(*keys, "src").distinct().join(incoming, [*keys, "src"], "left")
    s1, s2 = F.sum(F.col("w") * F.col("w")) / 2.0, F.sum(F.pow(1.0 + F.coalesce("__in", F.lit(0.0)), 2))
    if keys:
        return both.groupBy(*keys).agg(s1.alias("__s1")).join(s2_terms.groupBy(*keys).agg(s2.alias("__s2")), keys)
    return both.agg(s1.alias("__s1")).crossJoin(F.broadcast(s2_terms.agg(s2.alias("__s2"))))


def _rows(keys: Sequence[str]):
    # One row's own neighbours: at most k rows.
    return Window.partitionBy(*keys, "src")


def _global_p(i: Column, n: Column, s1: Column, s2: Column) -> Column:
    """One-sided normal tail of the global statistic under normality. The size
    enters to the fourth power, which no long holds above 55,000 rows."""
    n = n.cast("double")
    mean = -1.0 / (n - 1)
    variance = (n * n * s1 - n * s2 + 3 * n * n) / ((n - 1) * (n + 1) * n * n) - mean * mean
    return F.when(variance > 0, normal_sf(F.abs(i - mean) / F.sqrt(variance)))


def neighbour_draws(sizes: DataFrame, keys: Sequence[str], n: str, k: str, permutations: int, seed: int) -> DataFrame:
    """(keys, r, j, place) of ``permutations`` random sets of ``k`` different places
    in 0 to n - 2, the places of a row's other rows. ``sizes`` has n and k of each
    group. A set is drawn without replacement: the hash of (seed, r, j) picks one of
    the places that are left, counted from the lowest."""
    sets = sizes.select(*keys, n, k, F.explode(F.sequence(F.lit(1), F.lit(int(permutations)))).alias("r"))

    def added(drawn: Column, j: Column) -> Column:
        code = F.md5(F.concat_ws(":", F.lit(int(seed)), F.col("r"), j).cast("binary"))
        rank = F.pmod(F.conv(F.substring(code, 1, 12), 16, 10).cast("bigint"), F.col(n) - j)
        place = F.aggregate(F.array_sort(drawn), rank, lambda t, c: t + (t >= c).cast("bigint"))
        return F.array_append(drawn, place)

    drawn = F.aggregate(F.sequence(F.lit(1), F.col(k).cast("int")), F.array().cast("array<bigint>"), added)
    return sets.select(*keys, "r", F.posexplode(drawn).alias("j", "place"))


def _extreme(keys: list[str], id: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    names = [*keys, id, "local_moran_p"]

    def count(block: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if block.empty or drawn.empty:
            return pd.DataFrame(columns=names)
        own = block["__i"].to_numpy()[:, None]
        place, low, high = (np.stack(list(drawn[c].iloc[0])) for c in ("place", "low", "high"))
        sums = np.zeros((len(block), len(place)))
        for j in range(place.shape[1]):
            # Places behind the row's own move up by one.
            sums += np.where(place[:, j] + 1 < own, low[:, j], high[:, j])
        z = block["__z"].to_numpy()[:, None]
        larger = (z * (sums / place.shape[1]) >= z * block["__lag"].to_numpy()[:, None]).sum(axis=1)
        out = block[[*keys, id]].copy()
        out["local_moran_p"] = (np.minimum(larger, len(place) - larger) + 1.0) / (len(place) + 1.0)
        return out[names]

    return count


def _permuted(
    local: DataFrame, rows: DataFrame, keys: list[str], id: str, permutations: int, seed: int
) -> DataFrame:
    """Add pseudo p-values by conditional permutation: the share of random sets of
    other rows, drawn without replacement, whose mean is at least as extreme as the
    observed lag.

    The sets are places in the order of ``id`` and the same for all rows of a group.
    Only the values at those places, P x k of them and their neighbours, are looked up
    and put into arrays; rows meet them in blocks of bounded size, as matrices. So
    what is shuffled grows with the rows, not with rows x P x k.
    """
    dense = keep(number_rows(rows.select(*keys, id, "__z"), keys, [F.col(id)], "__i").withColumn("__i", F.col("__i").cast("bigint")))
    sizes = local.groupBy(*keys) if keys else local
    small = lookup(sizes.agg(F.first("__n").alias("n"), F.max("__k").alias("k")))
    draws = keep(neighbour_draws(small, keys, "n", "k", permutations, seed))
    both = draws.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("up")).withColumn("__i", F.col("place") + F.col("up"))
    # The highest place has no row above it, and is always met as the row above.
    found = both.join(dense.select(*keys, "__i", F.col("__z").alias("v")), [*keys, "__i"], "left")
    cells = found.groupBy(*keys, "r", "j", "place").agg(F.max(F.when(F.col("up") == 1, F.col("v"))).alias("low"), F.max(F.when(F.col("up") == 2, F.col("v"))).alias("high"))
    sets = cells.groupBy(*keys, "r").agg(F.sort_array(F.collect_list(F.struct("j", "place", "low", "high"))).alias("s"))
    grouped = sets.groupBy(*keys) if keys else sets.groupBy()
    # One row per group, of P x k entries whatever the group's rows.
    listed = grouped.agg(F.sort_array(F.collect_list(F.struct("r", "s"))).alias("a"))

    def matrix(name: str) -> Column:
        return F.transform("a", lambda x: F.transform(x["s"], lambda y: y[name])).alias(name)

    arrays = keep(listed.select(*keys, *[matrix(c) for c in ("place", "low", "high")]))
    observed = dense.drop("__z").join(local.select(*keys, id, F.col("__z").cast("double").alias("__z"), F.col("__lag").cast("double").alias("__lag")), [*keys, id])
    blocked = observed.withColumn("__block", F.floor(F.col("__i") / _BLOCK))
    each = arrays.join(small.select(*keys, "n"), keys) if keys else arrays.crossJoin(small.select("n"))
    sent = each.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / _BLOCK)))).drop("n")
    schema = T.StructType([*[local.schema[c] for c in (*keys, id)], T.StructField("local_moran_p", T.DoubleType())])
    on = [*keys, "__block"]
    p = blocked.groupBy(*on).cogroup(sent.groupBy(*on)).applyInPandas(_extreme(keys, id), schema)
    return local.join(p, [*keys, id])

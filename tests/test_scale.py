"""The forms for hot groups give what the forms for small groups give, and no
result depends on how rows are spread."""

import random

import pytest

from conftest import rows
from pyspark.sql import functions as F
from tessera.operators import compare, metrics, order, quantiles, report
from tessera.runtime import attach


@pytest.fixture(scope="module")
def skewed(spark):
    """Most rows in one group, a third of all rows on one value, NULLs."""
    rng = random.Random(11)
    data = []
    for i in range(1500):
        city = "big" if i % 10 else rng.choice(["b", "c", None])
        value = 5.0 if i % 3 == 0 else rng.choice([None, rng.uniform(0, 10), float(rng.randint(0, 20))])
        data.append((i, city, value, float(rng.randint(0, 4)), rng.uniform(0, 1)))
    return spark.createDataFrame(data, "cell_id int, city string, v double, w double, u double").repartition(6).cache()


def same(a, b, *key):
    x, y = rows(a, *key), rows(b, *key)
    assert len(x) == len(y) and len(x) > 0
    for left, right in zip(x, y):
        for c in left:
            if isinstance(left[c], float):
                assert right[c] is not None and abs(left[c] - right[c]) < 1e-9, (c, left, right)
            else:
                assert left[c] == right[c], (c, left, right)


def test_positions(skewed):
    how = [F.col("v").desc_nulls_last(), F.col("cell_id")]
    make = lambda hot: order.number_rows(skewed, ["city"], how, "r", hot=hot).select("cell_id", "r")
    same(make(False), make(True), "cell_id")
    whole = lambda hot: order.number_rows(skewed, [], how, "r", hot=hot).select("cell_id", "r")
    same(whole(False), whole(True), "cell_id")


def test_running_sums(skewed):
    how = [F.col("u"), F.col("cell_id")]
    make = lambda hot: order.running_sums(skewed, ["city"], how, {"s": "w"}, hot=hot).select("cell_id", "s")
    same(make(False), make(True), "cell_id")


@pytest.mark.parametrize("descending", [True, False])
def test_average_ranks(skewed, descending):
    make = lambda hot: order.average_rank(skewed, ["city"], "v", "r", descending, hot=hot).select("cell_id", "r")
    same(make(False), make(True), "cell_id")
    frame = skewed.where("city is not null").toPandas()
    want = frame.groupby("city")["v"].rank(ascending=not descending, method="average", na_option="keep")
    got = {r["cell_id"]: r["r"] for r in make(True).collect()}
    for cell, rank in zip(frame["cell_id"], want):
        assert got[cell] == (None if rank != rank else rank)


def test_quantiles(skewed):
    probs = [0.0, 0.1, 0.5, 0.925, 1.0]
    make = lambda hot: quantiles.quantile_table(skewed, ["city"], ["v", "w", "u"], probs, hot=hot)
    small, large = rows(make(False), "city"), rows(make(True), "city")
    frame = skewed.where("city is not null").toPandas()
    for a, b in zip(small, large):
        assert a["city"] == b["city"]
        for c in "vwu":
            assert all(abs(p - q) < 1e-9 for p, q in zip(a[c], b[c]))
            if a["city"]:
                want = frame[frame.city == a["city"]][c].quantile(probs)
                assert all(abs(p - q) < 1e-9 for p, q in zip(b[c], want))


def test_quantiles_of_both_forms_are_equal_doubles(spark):
    """Interpolation must round alike: ranks behind it are compared exactly."""
    rng = random.Random(5)
    df = spark.createDataFrame([(g, rng.uniform(0, 1)) for g in range(40) for _ in range(8)] + [(40, 0.1), (40, 0.7)], "g int, v double")
    probs = [0.02, 0.3, 0.5, 0.98]
    small, large = (rows(quantiles.quantile_table(df, ["g"], ["v"], probs, hot=hot), "g") for hot in (False, True))
    assert small == large and [r["v"][1] for r in large if r["g"] == 40] == [0.1 * 0.7 + 0.7 * 0.3]


def test_quantiles_by_full_sort(skewed):
    keyed = skewed.where("city is not null")
    groups = keyed.select("city").distinct()
    long = keyed.select("city", F.lit("v").alias("__f"), F.col("v").alias("__v")).where("__v is not null")
    full = quantiles._sorted(long, ["city"], ["v"], [0.25, 0.5], groups)
    same(full.select("city", F.col("v")[0].alias("a"), F.col("v")[1].alias("b")),
         quantiles.quantile_table(keyed, ["city"], ["v"], [0.25, 0.5], hot=False).select(
             "city", F.col("v")[0].alias("a"), F.col("v")[1].alias("b")), "city")


def test_reports_do_not_depend_on_the_form(spark, skewed):
    def all_reports():
        return [
            report.inequality(skewed, "city", "v", "w"),
            compare.alignment(skewed, "city", "v", "u"),
            metrics.classification_metrics(
                skewed.where("city is not null").withColumn("y", (F.col("w") > 2).cast("int")), ["city"], "y", "u"),
        ]

    spark.conf.unset("tessera.hotGroupRows")
    small = [rows(d, "city") for d in all_reports()]
    spark.conf.set("tessera.hotGroupRows", "0")
    spark.conf.set("tessera.broadcastRows", "0")
    try:
        large = all_reports()
        for a, b in zip(small, large):
            for x, y in zip(a, rows(b, "city")):
                for c in x:
                    assert x[c] == y[c] or abs(x[c] - y[c]) < 1e-9, c
    finally:
        spark.conf.unset("tessera.hotGroupRows")
        spark.conf.unset("tessera.broadcastRows")


def test_one_partition_equals_many(spark, skewed):
    one = report.score_summary(skewed.coalesce(1), "city", "v")
    many = report.score_summary(skewed.repartition(13), "city", "v")
    same(one, many, "city")


def test_wide_lookups_are_not_broadcast(spark, skewed):
    table = skewed.groupBy("cell_id").agg(F.max("v").alias("top"))
    spark.conf.set("tessera.broadcastRows", "10")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = attach(skewed, table, ["cell_id"])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("tessera.broadcastRows")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = attach(skewed, table, ["cell_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_a_scope_leaves_no_kept_table(spark):
    import os

    from tessera.runtime import keep, kept_tables, shared_path

    with kept_tables(spark) as folder:
        with kept_tables(spark) as inner:
            assert inner.startswith(folder) and keep(spark.range(3)).count() == 3 and os.path.isdir(inner)
        assert not os.path.exists(inner) and keep(spark.range(5)).count() == 5
        assert os.path.isdir(folder)
    assert not os.path.exists(folder) and not shared_path(spark).startswith(folder)

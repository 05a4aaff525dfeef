"""The supplied tables in the roles the operators need: cells, scores, points,
boundaries and pixels. Each role is given twice, as a DataFrame and as SQL.

Sums that feed ranks are made in whole cents, so both engines get equal doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import keep

CITIES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hash_x(key: Column) -> Column:
    return ((key * 7919) % 10007).cast("double")


def hash_y(key: Column) -> Column:
    return ((key * 104729) % 10009).cast("double")


def _cents(column: str) -> Column:
    return F.sum(F.round(F.col(column) * 100).cast("bigint"))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as cells of the market segments as cities."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    spend = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("population"), (_cents("o_totalprice") / F.lit(100.0)).alias("spend")
    )
    lines = (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum("l_quantity").alias("quantity"),
            (_cents("l_extendedprice") / F.lit(100.0) / F.count(F.lit(1))).alias("price"),
            (_cents("l_discount") / F.lit(100.0) / F.count(F.lit(1))).alias("discount"),
            (_cents("l_tax") / F.lit(100.0) / F.count(F.lit(1))).alias("tax"),
            (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("returned"),
        )
    )
    places = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "n_name", "r_name")
    key = F.col("c_custkey")
    balance = F.col("c_acctbal")
    return (
        table(spark, folder, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(spend.withColumnRenamed("o_custkey", "__s"), key == F.col("__s"), "left")
        .join(lines.withColumnRenamed("o_custkey", "__l"), key == F.col("__l"), "left")
        .select(
            key.alias("cell_id"),
            F.col("c_mktsegment").alias("city"),
            F.col("r_name").alias("country_iso"),
            F.col("n_name").alias("unit"),
            balance.alias("score"),
            F.col("spend"),
            F.coalesce("population", F.lit(0)).alias("population"),
            "lines", "quantity", "discount", "tax", "returned",
            F.when(balance >= 0, F.col("price")).alias("price"),
            F.when(balance >= 7500, "high_high").when(balance < 1000, "low_low")
            .when(balance < 7000, "not_significant").alias("hotspot"),
            hash_x(key).alias("x"),
            hash_y(key).alias("y"),
        )
    )


CELLS = """
spend AS (SELECT o_custkey, count(*) AS population,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS spend FROM orders GROUP BY 1),
line AS (SELECT o_custkey, count(*) AS lines, sum(l_quantity) AS quantity,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / count(*) AS price,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / count(*) AS discount,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / count(*) AS tax,
    CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS returned
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
cells AS (SELECT c_custkey AS cell_id, c_mktsegment AS city, r_name AS country_iso, n_name AS unit,
    c_acctbal AS score, spend, coalesce(population, 0) AS population, lines, quantity, discount, tax, returned,
    CASE WHEN c_acctbal >= 0 THEN price END AS price,
    CASE WHEN c_acctbal >= 7500 THEN 'high_high' WHEN c_acctbal < 1000 THEN 'low_low'
         WHEN c_acctbal < 7000 THEN 'not_significant' END AS hotspot,
    CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN spend ON c_custkey = spend.o_custkey LEFT JOIN line ON c_custkey = line.o_custkey)"""


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as scored rows, weighted by their quantity."""
    weight = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("population"))
    return table(spark, folder, "orders").join(
        weight, F.col("o_orderkey") == F.col("l_orderkey"), "left"
    ).select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("city"),
        F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("category"),
        F.coalesce("population", F.lit(0.0)).alias("population"), (F.col("o_custkey") % 97).alias("other"),
    )


ORDERS = """
weights AS (SELECT l_orderkey, sum(l_quantity) AS population FROM lineitem GROUP BY 1),
scored AS (SELECT o_orderkey AS cell_id, o_orderpriority AS city, o_totalprice AS score, o_orderstatus AS category,
    coalesce(population, 0.0) AS population, o_custkey % 97 AS other
    FROM orders LEFT JOIN weights ON o_orderkey = l_orderkey)"""


def _city(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CITIES]), (key % 5 + 1).cast("int"))


AMENITIES = ("school", "bench", "clinic", "Cafe", "pharmacy", "university", "shop", "PARKING")
HEALTHCARE = ("yes", "doctors", "none")


def amenities(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as tagged points."""
    key = F.col("p_partkey")
    kind = (F.floor(key / 5) % 9).cast("int")
    return table(spark, folder, "part").select(
        key.alias("poi_id"),
        _city(key).alias("city"),
        F.get(F.array(*[F.lit(a) for a in AMENITIES]), kind).alias("amenity"),
        F.get(F.array(*[F.lit(h) for h in HEALTHCARE]), (F.floor(key / 45) % 4).cast("int")).alias("healthcare"),
        (F.col("p_size") % 6).alias("street_count"),
        hash_x(key).alias("x"),
        hash_y(key).alias("y"),
    )


def _sql_pick(values: tuple[str, ...], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


AMENITY = f"""
amenities AS (SELECT p_partkey AS poi_id, {_sql_pick(CITIES, "p_partkey % 5")} AS city,
    {_sql_pick(AMENITIES, "(p_partkey // 5) % 9")} AS amenity,
    {_sql_pick(HEALTHCARE, "(p_partkey // 45) % 4")} AS healthcare, p_size % 6 AS street_count,
    CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 10009 AS DOUBLE) AS y FROM part)"""


def order_points(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as points of a city with a value and an error: the samples."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("sample_id"), _city(key).alias("city"),
        F.col("o_totalprice").alias("rwi"), (F.col("o_custkey") % 11 / F.lit(10.0)).alias("error"),
        hash_x(key * 3 + 1).alias("x"), hash_y(key * 3 + 1).alias("y"),
    )


POINTS = f"""
points AS (SELECT o_orderkey AS sample_id, {_sql_pick(CITIES, "o_orderkey % 5")} AS city, o_totalprice AS rwi,
    (o_custkey % 11) / 10.0::DOUBLE AS error, CAST(((o_orderkey * 3 + 1) * 7919) % 10007 AS DOUBLE) AS x,
    CAST(((o_orderkey * 3 + 1) * 104729) % 10009 AS DOUBLE) AS y FROM orders)"""


def roads(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as street segments."""
    key, long = F.col("o_orderkey"), F.col("o_custkey")
    x, y = hash_x(key * 5 + 2), hash_y(key * 5 + 2)
    return table(spark, folder, "orders").select(
        _city(key).alias("city"), x.alias("x1"), y.alias("y1"),
        (x + (long % 41) * 5.0 - 100.0).alias("x2"), (y + (long % 37) * 5.0 - 90.0).alias("y2"),
    )


ROADS = f"""
street AS (SELECT {_sql_pick(CITIES, "o_orderkey % 5")} AS city,
    CAST(((o_orderkey * 5 + 2) * 7919) % 10007 AS DOUBLE) AS x1,
    CAST(((o_orderkey * 5 + 2) * 104729) % 10009 AS DOUBLE) AS y1, o_custkey AS k FROM orders),
roads AS (SELECT city, x1, y1, x1 + (k % 41) * 5.0 - 100.0 AS x2, y1 + (k % 37) * 5.0 - 90.0 AS y2 FROM street)"""


def rectangle_edges(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Four edges of each box ``x0, y0, x1, y1``."""
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    edges = F.array(*[
        F.struct(
            F.lit(i).alias("seq"), F.col(a[0]).alias("x1"), F.col(a[1]).alias("y1"),
            F.col(b[0]).alias("x2"), F.col(b[1]).alias("y2"),
        )
        for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1]))
    ])
    return boxes.select(*keys, F.lit(0).alias("ring"), F.explode(edges).alias("e")).select(*keys, "ring", "e.*")


def units(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nations as rectangular units of their regions, and their edges."""
    col, row = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
    boxes = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        F.col("r_name").alias("country_iso"), F.col("n_nationkey").cast("string").alias("admin2_id"),
        F.col("n_name").alias("admin2_name"), F.lit(None).cast("string").alias("admin2_iso"),
        (col * 2002 - 0.5).cast("double").alias("x0"), (row * 2002 - 0.5).cast("double").alias("y0"),
        (col * 2002 + 1900.5).cast("double").alias("x1"), (row * 2002 + 1900.5).cast("double").alias("y1"),
    )
    return boxes, rectangle_edges(boxes, ["country_iso", "admin2_id"])


UNITS = """
units AS (SELECT r_name AS country_iso, CAST(n_nationkey AS VARCHAR) AS admin2_id, n_name AS admin2_name,
    (n_nationkey % 5) * 2002 - 0.5 AS x0, (n_nationkey // 5) * 2002 - 0.5 AS y0,
    (n_nationkey % 5) * 2002 + 1900.5 AS x1, (n_nationkey // 5) * 2002 + 1900.5 AS y1
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def parcels(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as rectangular boundaries, one city each."""
    key = F.col("s_suppkey")
    x, y = hash_x(key), hash_y(key)
    return table(spark, folder, "supplier").select(
        F.col("s_name").alias("city"), x.alias("x0"), y.alias("y0"),
        (x + 700.0 + (key % 13) * 90.0).alias("x1"), (y + 600.0 + (key % 7) * 130.0).alias("y1"),
    )


PARCELS = """
parcels AS (SELECT s_name AS city, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS x0,
    CAST((s_suppkey * 104729) % 10009 AS DOUBLE) AS y0, s_suppkey AS k FROM supplier),
boxes AS (SELECT city, x0, y0, x0 + 700.0 + (k % 13) * 90.0 AS x1, y0 + 600.0 + (k % 7) * 130.0 AS y1 FROM parcels),
gridded AS (SELECT city, ix, iy, x0 AS origin_x, y0 AS origin_y, x0 + ix * 500.0 AS cx0, y0 + iy * 500.0 AS cy0,
    least(x0 + ix * 500.0 + 500.0, x1) AS cx1, least(y0 + iy * 500.0 + 500.0, y1) AS cy1
    FROM boxes, generate_series(0, 8) AS a(ix), generate_series(0, 8) AS b(iy)
    WHERE x0 + ix * 500.0 < x1 AND y0 + iy * 500.0 < y1)"""


def lattice(spark: SparkSession, folder: str) -> DataFrame:
    """The 500 m squares that hold a customer."""
    key = F.col("c_custkey")
    ix, iy = F.floor(hash_x(key) / 500), F.floor(hash_y(key) / 500)
    return table(spark, folder, "customer").select(ix.alias("ix"), iy.alias("iy")).distinct().select(
        F.concat_ws("_", "ix", "iy").alias("cell_id"),
        (F.col("ix") * 500.0).alias("x0"), (F.col("iy") * 500.0).alias("y0"),
        (F.col("ix") * 500.0 + 500.0).alias("x1"), (F.col("iy") * 500.0 + 500.0).alias("y1"),
    )


LATTICE = """
squares AS (SELECT DISTINCT CAST(floor(((c_custkey * 7919) % 10007) / 500.0) AS BIGINT) AS ix,
    CAST(floor(((c_custkey * 104729) % 10009) / 500.0) AS BIGINT) AS iy FROM customer),
lattice AS (SELECT concat_ws('_', ix, iy) AS cell_id, ix * 500.0 AS x0, iy * 500.0 AS y0,
    ix * 500.0 + 500.0 AS x1, iy * 500.0 + 500.0 AS y1 FROM squares)"""


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as 8 m pixels; the quantity is the value, 13 means no data."""
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    x, y = hash_x(key), hash_y(key)
    return table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("value"), ((F.col("l_partkey") % 10) * 10).cast("double").alias("cover"),
        x.alias("px"), y.alias("py"),
        (x - 4.0).alias("px0"), (y - 4.0).alias("py0"), (x + 4.0).alias("px1"), (y + 4.0).alias("py1"),
    )


PIXELS = """
spots AS (SELECT l_quantity AS value, CAST((l_partkey % 10) * 10 AS DOUBLE) AS cover,
    CAST(((l_orderkey * 7 + l_linenumber) * 7919) % 10007 AS DOUBLE) AS px,
    CAST(((l_orderkey * 7 + l_linenumber) * 104729) % 10009 AS DOUBLE) AS py FROM lineitem),
pixels AS (SELECT value, cover, px, py, px - 4.0 AS px0, py - 4.0 AS py0, px + 4.0 AS px1, py + 4.0 AS py1 FROM spots)"""

TOUCH = "px0 < x1 AND px1 > x0 AND py0 < y1 AND py1 > y0"


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Document lengths as predictions of the labels, per language."""
    length = F.col("n_chars")
    return table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select(
        F.col("lang").alias("protocol"), F.lit("length").alias("model"),
        F.col("quality").cast("double").alias("rwi_true"), (F.least(length, F.lit(2000)) / 2000.0).alias("rwi_pred"),
        F.col("quality").alias("low_wealth_true"),
        (F.floor(F.least(length, F.lit(3000)) / 100) / 30.0).alias("low_wealth_prob"),
    )


PREDICTIONS = """
predictions AS (SELECT lang AS protocol, 'length' AS model, CAST(quality AS DOUBLE) AS rwi_true,
    least(n_chars, 2000) / 2000.0::DOUBLE AS rwi_pred, quality AS low_wealth_true,
    (least(n_chars, 3000) // 100) / 30.0::DOUBLE AS low_wealth_prob
    FROM labels JOIN documents USING (doc_id))"""


def model_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Six metrics of the order statuses as models, per customer segment and
    month as protocols; one protocol is the pooled one."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.when(F.col("c_mktsegment") == "BUILDING", "pooled_random").otherwise(
            F.concat(F.lit("holdout_"), F.lower("c_mktsegment"))
        ).alias("protocol"),
        F.concat(F.lit("model_"), F.lower("o_orderpriority")).alias("model"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v"),
    )
    names = ("rmse", "mae", "spearman_corr", "roc_auc", "average_precision", "balanced_accuracy")
    wide = rows.groupBy("protocol", "model").agg(*[
        (F.sum(F.col("v") % (101 + 6 * i)) / F.count(F.lit(1))).alias(n) for i, n in enumerate(names)
    ])
    return keep(wide.unpivot(["protocol", "model"], list(names), "metric", "value"))


METRICS = """
priced AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'pooled_random'
    ELSE 'holdout_' || lower(c_mktsegment) END AS protocol, 'model_' || lower(o_orderpriority) AS model,
    CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey),
kinds AS (SELECT * FROM (VALUES ('rmse', 101), ('mae', 107), ('spearman_corr', 113), ('roc_auc', 119),
    ('average_precision', 125), ('balanced_accuracy', 131)) AS t(metric, m)),
metrics AS (SELECT protocol, model, metric, CAST(sum(v % m) AS DOUBLE) / count(*) AS value
    FROM priced, kinds GROUP BY 1, 2, 3),
ranked AS (SELECT *, CASE WHEN metric IN ('rmse', 'mae') THEN 'min' ELSE 'max' END AS direction,
    row_number() OVER (PARTITION BY protocol, metric ORDER BY
    CASE WHEN metric IN ('rmse', 'mae') THEN value ELSE -value END, model) AS rank FROM metrics)"""

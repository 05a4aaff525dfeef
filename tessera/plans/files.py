"""Queries of the sources, sinks and the streaming form: supplied tables are
written to the shared folder in another format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import roles
from tessera.plans.registry import query
from tessera.plans.spatial import CUSTOMER, spots
from tessera.runtime import shared_path
from tessera.sources import geojson, points, tables
from tessera.streaming import rowwise


def _orders(spark, sf):
    return roles.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")


def _round_trip(df, suffix, schema=None):
    path = shared_path(df.sparkSession, suffix)
    tables.write_table(df, path)
    return tables.read_table(df.sparkSession, path, schema)


ORDERS = "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders"
SCHEMA = "o_orderkey bigint, o_totalprice double, o_orderstatus string"


@query("parquet_scan", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", ["o_totalprice"])
def _(spark, sf):
    return tables.read_table(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus").where(
        "o_orderstatus = 'F'"
    )


@query("csv_round_trip", ORDERS, ["o_totalprice"])
def _(spark, sf):
    return _round_trip(_orders(spark, sf), ".csv", SCHEMA)


@query("tsv_inferred_schema", ORDERS, ["o_totalprice"])
def _(spark, sf):
    return _round_trip(_orders(spark, sf), ".tsv")


@query("jsonl_round_trip", ORDERS, ["o_totalprice"])
def _(spark, sf):
    return _round_trip(_orders(spark, sf), ".jsonl", SCHEMA)


@query("geojson_features", "SELECT cell_id, city, x AS lon, y AS lat FROM spot", ["lon", "lat"], CUSTOMER)
def _(spark, sf):
    """Points written as GeoJSON features, one a line, and parsed again."""
    path = shared_path(spark, ".geojson")
    tables.write_table(spots(spark, sf).select("cell_id", "city", F.col("x").alias("lon"), F.col("y").alias("lat")), path)
    rows = geojson.read_feature_lines(spark, path, {"cell_id": "bigint", "city": "string"})
    return geojson.feature_points(rows).drop("geometry_type", "coordinates")


@query("geojson_table_round_trip", "SELECT cell_id, city, score, x AS lon, y AS lat FROM spot", ["score", "lon", "lat"], CUSTOMER)
def _(spark, sf):
    """A table written and read as GeoJSON by its suffix, its properties typed as they were."""
    rows = spots(spark, sf).select("cell_id", "city", "score", F.col("x").alias("lon"), F.col("y").alias("lat"))
    back = _round_trip(rows, ".geojson")
    return geojson.feature_points(back).select("cell_id", "city", F.col("score").cast("double").alias("score"), "lon", "lat")


@query("boundary_scan", """
    SELECT country_iso, u.admin2_id, admin2_name, CAST(NULL AS VARCHAR) AS admin2_iso, CAST(4 AS BIGINT) AS n_edges, x0, y0, x1, y1 FROM units u""",
       ["x0", "y0", "x1", "y1"], roles.UNITS)
def _(spark, sf):
    """Units written as one GeoJSON file of boundaries per country, and scanned together."""
    boxes, _ = roles.units(spark, sf)
    corners = F.array(*[F.array(a, b) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    shapes = boxes.select(
        "country_iso", F.col("admin2_id").alias("shapeID"), F.col("admin2_name").alias("shapeName"),
        F.lit("Polygon").alias("geometry_type"), F.to_json(F.array(corners)).alias("coordinates"),
    )
    folder = shared_path(spark)
    for country in [r[0] for r in roles.table(spark, sf, "region").select("r_name").collect()]:  # a file each
        tables.write_table(shapes.where(F.col("country_iso") == country).drop("country_iso"), f"{folder}/{country}_adm2.geojson")
    found, edges = geojson.read_boundaries(spark, folder)
    box = edges.groupBy("admin2_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.min("x1").alias("x0"), F.min("y1").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    # A blank in a country's name is written into the path as it is.
    return found.withColumn("country_iso", F.url_decode("country_iso")).join(box, "admin2_id")


@query("sample_scan", """
    SELECT CAST(c_acctbal AS DOUBLE) AS rwi, y / 200 AS latitude, x / 100 AS longitude, CAST(NULL AS DOUBLE) AS error, city AS country_iso
    FROM spot JOIN customer ON cell_id = c_custkey""", ["rwi", "latitude", "longitude"], CUSTOMER)
def _(spark, sf):
    """Samples in one csv file per country; the error is unreadable and becomes NULL."""
    rows = spots(spark, sf).select((F.col("y") / 200).alias("latitude"), (F.col("x") / 100).alias("longitude"), F.col("score").alias("rwi"), F.lit("n/a").alias("error"), "city")
    folder = shared_path(spark)
    for country in [r[0] for r in rows.select("city").distinct().collect()]:  # five segments
        rows.where(F.col("city") == country).drop("city").write.csv(f"{folder}/{country}_samples.csv", header=True)
    return points.read_samples(spark, f"{folder}/*.csv").withColumn("country_iso", F.url_decode("country_iso"))


@query("json_documents", "SELECT c_mktsegment AS city, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1", ["top"])
def _(spark, sf):
    rows = roles.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("city")).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("top")).alias("stats")
    )
    path = shared_path(spark)
    tables.write_json(rows, path)
    back = spark.read.schema("city string, stats struct<n: bigint, top: double>, generated_at_utc string").json(path)
    return back.where("generated_at_utc IS NOT NULL").select("city", "stats.n", "stats.top")


@query("layer_scan", """
    SELECT poi_id, city, amenity FROM amenities WHERE city IN ('BUILDING', 'MACHINERY')""", base=roles.AMENITY)
def _(spark, sf):
    rows = roles.amenities(spark, sf).withColumn("layer", F.lit("amenities"))
    path = shared_path(spark)
    tables.write_layers(rows, path)
    return tables.read_layer(spark, path, "amenities", ["BUILDING", "MACHINERY"]).select("poi_id", "city", "amenity")


@query("layer_columns", "SELECT amenity, healthcare, city FROM amenities", base=roles.AMENITY)
def _(spark, sf):
    return tables.layer_columns(roles.amenities(spark, sf), "amenities")


@query("array_round_trip", """
    SELECT CAST(cell_id AS VARCHAR) AS cell_id, CAST(x AS REAL) + CAST(y AS REAL) AS total, CAST(score AS REAL) AS target
    FROM spot WHERE city = 'BUILDING'""", ["total:1", "target:2"], CUSTOMER)
def _(spark, sf):
    rows = spots(spark, sf).withColumn("label", F.col("score") < 1000)
    path = shared_path(spark)
    points.write_arrays(points.array_dataset(rows, ["x", "y"], regression="score", classification="label"), path)
    back = points.read_arrays(spark, path, ["BUILDING"])
    return back.select("cell_id", (F.col("features")[0] + F.col("features")[1]).alias("total"),
                       F.col("regression_target").alias("target"))


@query("stream_mask", """
    SELECT 'live' AS scenario, event_id, coalesce(event_type, 'missing') || '__' || CAST(user_id AS VARCHAR) AS label
    FROM events WHERE value > 50 OR user_id < 5""")
def _(spark, sf):
    """Row-local operators on a stream of the events file."""
    folder, out = shared_path(spark), shared_path(spark)
    schema = roles.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    conditions = [{"column": "value", "op": ">", "value": 50}, {"column": "user_id", "op": "<", "value": 5}]
    labelled = rowwise.mask_and_label(stream, conditions, "any", ["event_type", "user_id"], scenario="live")
    rowwise.write_stream(labelled.select("scenario", "event_id", "label"), out, folder).awaitTermination()
    return spark.read.schema("scenario string, event_id bigint, label string").parquet(out)

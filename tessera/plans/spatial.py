"""Queries of the spatial operators, checked against brute force in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import areas, features, moran, near, raster, targets
from tessera.plans import roles
from tessera.plans.registry import query
from tessera.runtime import keep
from tessera.sources import geojson

D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
CUSTOMER = """
spot AS (SELECT c_custkey AS cell_id, c_mktsegment AS city, c_acctbal AS score, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x,
    CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y FROM customer)"""


def spots(spark, sf):
    key = F.col("c_custkey")
    return roles.table(spark, sf, "customer").select(
        key.alias("cell_id"), F.col("c_mktsegment").alias("city"), F.col("c_acctbal").alias("score"),
        roles.hash_x(key).alias("x"), roles.hash_y(key).alias("y"),
    )


@query("count_within", f"""
    SELECT cell_id, count(b.city) AS n FROM spot a LEFT JOIN points b ON a.city = b.city AND {D2} < 1000000.0 GROUP BY 1""",
       base=CUSTOMER + "," + roles.POINTS)
def _(spark, sf):
    return near.count_within(spots(spark, sf), roles.order_points(spark, sf), 1000.0, "n").select("cell_id", "n")


@query("nearest_point", f"""
    SELECT cell_id, sqrt(min({D2})) AS d FROM spot a LEFT JOIN
    (SELECT * FROM amenities WHERE lower(amenity) IN ('school', 'university')) b ON a.city = b.city GROUP BY 1""",
       ["d"], CUSTOMER + "," + roles.AMENITY)
def _(spark, sf):
    schools = C.school_points(roles.amenities(spark, sf))
    return near.nearest_distance(spots(spark, sf), schools, "d").select("cell_id", "d")


@query("nearest_road", """
    SELECT cell_id, sqrt(min(ex * ex + ey * ey)) AS d FROM (SELECT cell_id, x1 + t * (x2 - x1) - x AS ex, y1 + t * (y2 - y1) - y AS ey FROM (
    SELECT *, CASE WHEN l2 > 0 THEN greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2)) ELSE 0.0 END AS t FROM (
    SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l2 FROM spot JOIN roads USING (city)))) GROUP BY 1""",
       ["d"], CUSTOMER + "," + roles.ROADS)
def _(spark, sf):
    return near.nearest_distance(spots(spark, sf), roles.roads(spark, sf), "d").select("cell_id", "d")


HUB = """
hub AS (SELECT city, 5003.5 AS x1, 5004.5 AS y1, 5003.5 + (x - 5003.5) * f AS x2, 5004.5 + (y - 5004.5) * f AS y2
    FROM (SELECT *, CASE WHEN score < 0 THEN 20.0 ELSE 1.0 END AS f FROM spot))"""


@query("nearest_hub", """
    SELECT cell_id, sqrt(min(ex * ex + ey * ey)) AS d FROM (SELECT cell_id, x1 + t * (x2 - x1) - x AS ex, y1 + t * (y2 - y1) - y AS ey FROM (
    SELECT *, CASE WHEN l2 > 0 THEN greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2)) ELSE 0.0 END AS t FROM (
    SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l2 FROM (SELECT cell_id, city, x + 3 AS x, y - 2 AS y FROM spot) JOIN hub USING (city)))) GROUP BY 1""",
       ["d"], CUSTOMER + "," + HUB)
def _(spark, sf):
    """All roads of a city meet in one point, and some are far longer than the rest."""
    rows = spots(spark, sf)
    far = F.when(F.col("score") < 0, 20.0).otherwise(1.0)
    roads = rows.select(
        "city", F.lit(5003.5).alias("x1"), F.lit(5004.5).alias("y1"),
        (5003.5 + (F.col("x") - 5003.5) * far).alias("x2"), (5004.5 + (F.col("y") - 5004.5) * far).alias("y2"),
    )
    cells = rows.withColumns({"x": F.col("x") + 3, "y": F.col("y") - 2})
    return near.nearest_distance(cells, roads, "d").select("cell_id", "d")


@query("knn_samples", f"""
    SELECT cell_id, sample_id, distance, seq FROM (SELECT a.cell_id, b.sample_id, sqrt({D2}) AS distance,
    row_number() OVER (PARTITION BY a.cell_id ORDER BY {D2}, b.sample_id) AS seq FROM spot a JOIN points b ON a.city = b.city) WHERE seq <= 4""",
       ["distance"], CUSTOMER + "," + roles.POINTS)
def _(spark, sf):
    hits = near.knn(spots(spark, sf), roles.order_points(spark, sf), ["city"], 4, "cell_id", "sample_id")
    return hits.drop("city")


KNN = f"""
pairs AS (SELECT a.city, a.cell_id AS src, b.cell_id AS dst, {D2} AS d2, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D2}, b.cell_id) AS seq
    FROM spot a JOIN spot b ON a.city = b.city AND a.cell_id <> b.cell_id),
near AS (SELECT * FROM pairs WHERE seq <= 8)"""


@query("knn_edges", "SELECT city, src, dst, sqrt(d2) AS distance, seq FROM near", ["distance"], CUSTOMER + "," + KNN)
def _(spark, sf):
    return near.knn_edges(spots(spark, sf), ["city"], 8, "cell_id")


@query("embedding_neighbors", """
    SELECT label, src, dst FROM (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY
    (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.vec_id) AS seq
    FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE seq <= 3""",
       base="e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)")
def _(spark, sf):
    rows = roles.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")
    )
    return near.knn_edges(rows, ["label"], 3, "vec_id").select("label", "src", "dst")


@query("embedding_neighbors_whole", """
    SELECT label, src, dst FROM (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY
    list_distance(a.v, b.v), b.vec_id) AS seq FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE seq <= 3""",
       base="e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def _(spark, sf):
    """On all elements; ``embedding_neighbors`` reads the first two, as its SQL does."""
    return near.vector_edges(roles.table(spark, sf, "embeddings"), ["label"], 3, "vec_id", "embedding").select("label", "src", "dst")


GRAPH = KNN + """,
links AS (SELECT city, src, dst FROM near UNION SELECT city, dst, src FROM near UNION SELECT city, cell_id, cell_id FROM spot),
deg AS (SELECT src, count(*) AS d FROM links GROUP BY 1),
graph AS (SELECT l.city, l.src, l.dst, 1.0 / sqrt(a.d * b.d) AS weight FROM links l JOIN deg a ON l.src = a.src JOIN deg b ON l.dst = b.src)"""


@query("knn_graph", "SELECT * FROM graph", ["weight"], CUSTOMER + "," + GRAPH)
def _(spark, sf):
    return near.knn_graph(spots(spark, sf))


@query("neighbor_aggregate", """
    SELECT g.city, g.src AS cell_id, sum(weight * score) AS score FROM graph g JOIN spot ON dst = cell_id GROUP BY 1, 2""",
       ["score:4"], CUSTOMER + "," + GRAPH)
def _(spark, sf):
    rows = spots(spark, sf)
    return near.neighbor_aggregate(near.knn_graph(rows), rows, "city", "cell_id", ["score"])


@query("filled_coordinates", """
    SELECT cell_id, CASE WHEN score < 0 THEN mx ELSE x END AS x, CASE WHEN score < 0 THEN my ELSE y END AS y FROM spot JOIN (
    SELECT city, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM spot WHERE score >= 0 GROUP BY 1) USING (city)""",
       ["x", "y"], CUSTOMER)
def _(spark, sf):
    rows = spots(spark, sf).withColumns({c: F.when(F.col("score") >= 0, F.col(c)) for c in ("x", "y")})
    return near.filled_coordinates(rows, "city", "x", "y").select("cell_id", "x", "y")


WEAK = f"""
cand AS (SELECT a.cell_id, b.rwi, b.error, sqrt({D2}) AS d, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D2}, b.sample_id) AS seq
    FROM spot a JOIN points b ON a.city = b.city),
sig AS (SELECT cell_id, sum(rwi / greatest(d, 25.0)) / sum(1 / greatest(d, 25.0)) AS rwi_mean, sum(error / greatest(d, 25.0)) / sum(1 / greatest(d, 25.0)) AS rwi_error_weighted_mean,
    max(d) AS rwi_max_neighbor_distance_m, count(*) AS rwi_neighbor_count FROM cand WHERE seq <= 4 AND (d <= 150.0 OR seq = 1) GROUP BY 1),
lab AS (SELECT spot.cell_id, city, score, rwi_mean, rwi_error_weighted_mean, rwi_max_neighbor_distance_m, rwi_neighbor_count,
    (rank() OVER (PARTITION BY city ORDER BY rwi_mean) + (count(*) OVER (PARTITION BY city, rwi_mean) - 1) / 2.0) / count(*) OVER (PARTITION BY city) AS p
    FROM spot JOIN sig USING (cell_id))"""


def _weak(spark, sf):
    cells = spots(spark, sf).withColumn("country_iso", F.col("city"))
    samples = roles.order_points(spark, sf).withColumnRenamed("city", "country_iso")
    return targets.weak_targets(cells, samples, score="score", max_distance=150.0)


@query("weighted_knn", """
    SELECT cell_id, rwi_mean AS rwi, rwi_error_weighted_mean AS error, rwi_max_neighbor_distance_m AS max_neighbor_distance, rwi_neighbor_count AS neighbor_count FROM sig""",
       ["rwi:3", "error", "max_neighbor_distance"], CUSTOMER + "," + roles.POINTS + "," + WEAK)
def _(spark, sf):
    return near.weighted_knn(
        spots(spark, sf), roles.order_points(spark, sf), ["city"], ["rwi", "error"], 4, 150.0
    ).drop("city")


@query("weak_targets", """
    SELECT cell_id, rwi_mean, rwi_error_weighted_mean, rwi_max_neighbor_distance_m, rwi_neighbor_count, true AS rwi_label_available,
    p AS rwi_within_city_percentile, p <= 0.2 AS rwi_bottom_quantile_flag, (1 - p) * 100 AS rwi_deprivation_proxy_0_100 FROM lab""",
       ["rwi_mean:3", "rwi_error_weighted_mean", "rwi_max_neighbor_distance_m", "rwi_within_city_percentile",
        "rwi_deprivation_proxy_0_100"], CUSTOMER + "," + roles.POINTS + "," + WEAK)
def _(spark, sf):
    return _weak(spark, sf)[0].drop("city", "country_iso", "score", "x", "y")


@query("weak_target_report", """
    SELECT city, city AS country_iso, count(*) AS n_rows, min(rwi_mean) AS rwi_mean_min, max(rwi_mean) AS rwi_mean_max, corr(ra, rb) AS spearman_corr_rwi_vs_score,
    -corr(ra, rb) AS spearman_corr_rwi_vs_negative_score, avg(rwi_max_neighbor_distance_m) AS mean_max_neighbor_distance_m, 1.0 AS label_coverage_share
    FROM (SELECT *, p AS ra, rank() OVER (PARTITION BY city ORDER BY score) + (count(*) OVER (PARTITION BY city, score) - 1) / 2.0 AS rb FROM lab) GROUP BY 1""",
       ["rwi_mean_min:3", "rwi_mean_max:3", "spearman_corr_rwi_vs_score", "spearman_corr_rwi_vs_negative_score",
        "mean_max_neighbor_distance_m", "label_coverage_share"], CUSTOMER + "," + roles.POINTS + "," + WEAK)
def _(spark, sf):
    return _weak(spark, sf)[1]


MORAN = KNN + """,
mz AS (SELECT cell_id, city, score - avg(score) OVER (PARTITION BY city) AS z, count(*) OVER (PARTITION BY city) AS n,
    stddev_pop(score) OVER (PARTITION BY city) AS sd, avg(score) OVER (PARTITION BY city) AS m FROM spot),
lagged AS (SELECT src AS cell_id, avg(z) AS lag FROM near JOIN mz ON dst = cell_id GROUP BY 1),
ml AS (SELECT *, n * sd * sd AS m2 FROM mz JOIN lagged USING (cell_id)),
mp AS (SELECT *, -z / (n - 1) AS mu, ((m2 - z * z) / (n - 1) - (z / (n - 1)) ^ 2) / 8 * (n - 1 - 8) / (n - 2)::DOUBLE AS var FROM ml),
mt AS (SELECT *, abs(lag - mu) / sqrt(var) AS dev, 1.0 / (1.0 + 0.2316419::DOUBLE * abs(lag - mu) / sqrt(var)) AS t FROM mp),
lm AS (SELECT cell_id, city, n, m, sd, z, lag, m2, (n - 1) * z * lag / m2 AS local_moran_i,
    CASE WHEN z > 0 THEN CASE WHEN lag > 0 THEN 1 ELSE 4 END ELSE CASE WHEN lag > 0 THEN 2 ELSE 3 END END AS local_moran_quadrant,
    exp(-dev * dev / 2) / sqrt(2 * pi()) * (0.319381530::DOUBLE * t - 0.356563782::DOUBLE * t ^ 2 + 1.781477937::DOUBLE * t ^ 3 - 1.821255978::DOUBLE * t ^ 4 + 1.330274429::DOUBLE * t ^ 5) AS local_moran_p FROM mt)"""


@query("moran_local", """
    SELECT cell_id, local_moran_i, local_moran_p, local_moran_quadrant, CASE WHEN local_moran_p >= 0.05 THEN 'not_significant'
    WHEN local_moran_quadrant = 1 THEN 'high_high' WHEN local_moran_quadrant = 2 THEN 'low_high' WHEN local_moran_quadrant = 3 THEN 'low_low' ELSE 'high_low' END
    AS local_moran_cluster FROM lm""", ["local_moran_i", "local_moran_p"], CUSTOMER + "," + MORAN)
def _(spark, sf):
    return moran.moran(spots(spark, sf), "score", by="city", permutations=None)[1].select(
        "cell_id", "local_moran_i", "local_moran_p", "local_moran_quadrant", "local_moran_cluster"
    )


_NORMAL_TAIL = """exp(-dev * dev / 2) / sqrt(2 * pi()) * (0.319381530::DOUBLE * t - 0.356563782::DOUBLE * t ^ 2 + 1.781477937::DOUBLE * t ^ 3 - 1.821255978::DOUBLE * t ^ 4 + 1.330274429::DOUBLE * t ^ 5)"""


@query("moran_global", f"""
    SELECT city, n_observations, k_neighbors, moran_i, score_mean, score_std, {_NORMAL_TAIL} AS moran_p FROM (
        SELECT *, 1.0 / (1.0 + 0.2316419::DOUBLE * dev) AS t FROM (SELECT *, abs(moran_i + 1.0 / (n - 1)) / sqrt((n * n * s1 - n * s2 + 3 * n * n) / ((n - 1) * (n + 1) * n * n) - 1.0 / (n - 1) ^ 2) AS dev FROM (
            SELECT city, any_value(n) AS n_observations, any_value(n)::DOUBLE AS n, CAST(8 AS BIGINT) AS k_neighbors, sum(z * lag) / any_value(m2) AS moran_i, any_value(m) AS score_mean, any_value(sd) AS score_std
            FROM lm GROUP BY 1) JOIN sym USING (city) JOIN ins USING (city)))""",
       ["moran_i", "moran_p", "score_mean", "score_std"], CUSTOMER + "," + MORAN + """,
sym AS (SELECT city, sum(w * w) / 2 AS s1 FROM (SELECT city, src, dst, sum(0.125::DOUBLE) AS w FROM (SELECT city, src, dst FROM near UNION ALL SELECT city, dst, src FROM near) GROUP BY ALL) GROUP BY 1),
ins AS (SELECT city, sum((1 + coalesce(c, 0) / 8.0::DOUBLE) ^ 2) AS s2 FROM spot LEFT JOIN (SELECT dst AS cell_id, count(*) AS c FROM near GROUP BY 1) USING (cell_id) GROUP BY 1)""")
def _(spark, sf):
    return moran.moran(spots(spark, sf), "score", by="city", permutations=None)[0]


@query("moran_permutation", """
    SELECT cell_id, (least(larger, 999 - larger) + 1) / 1000.0::DOUBLE AS local_moran_p, local_moran_i,
    CASE WHEN (least(larger, 999 - larger) + 1) / 1000.0::DOUBLE >= 0.05 THEN 'not_significant' WHEN local_moran_quadrant = 1 THEN 'high_high'
    WHEN local_moran_quadrant = 2 THEN 'low_high' WHEN local_moran_quadrant = 3 THEN 'low_low' ELSE 'high_low' END AS local_moran_cluster
    FROM (SELECT cell_id, count(*) FILTER (sim >= z * lag) AS larger FROM sims GROUP BY 1) JOIN lm USING (cell_id)""",
       ["local_moran_i"], CUSTOMER + "," + MORAN + """,
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY city ORDER BY cell_id) AS i FROM lm),
coded AS (SELECT city, n, r, list_transform(range(1, 9), lambda j: [('0x' || substr(md5('42:' || r || ':' || j), 1, 12))::BIGINT]) AS h FROM (SELECT DISTINCT city, n FROM lm), range(1, 1000) x(r)),
drawn AS MATERIALIZED (SELECT city, r, unnest(list_reduce(list_prepend([]::BIGINT[], h), lambda a, x: list_append(a, list_reduce(list_prepend(x[1] % (n - 1 - len(a)), list_sort(a)), lambda t, c: t + (t >= c)::BIGINT)))) AS q FROM coded),
known AS MATERIALIZED (SELECT d.city, r, q, lo.z AS low, hi.z AS high FROM drawn d JOIN placed lo ON lo.city = d.city AND lo.i = q + 1 LEFT JOIN placed hi ON hi.city = d.city AND hi.i = q + 2),
sims AS (SELECT cell_id, r, any_value(z) * avg(CASE WHEN q + 1 < i THEN low ELSE high END) AS sim, any_value(z) AS z, any_value(lag) AS lag FROM placed JOIN known USING (city) GROUP BY ALL)""")
def _(spark, sf):
    return moran.moran(spots(spark, sf), "score", by="city")[1].select(
        "cell_id", "local_moran_i", "local_moran_p", "local_moran_cluster"
    )


# ------------------------------------------------------------------ polygons

ATTACH = """
held AS (SELECT cell_id, cells.country_iso, x, y, admin2_id, admin2_name FROM cells JOIN units ON cells.country_iso = units.country_iso
    AND x > x0 AND x < x1 AND y > y0 AND y < y1),
far AS (SELECT cell_id, c.country_iso, u.admin2_id, u.admin2_name, row_number() OVER (PARTITION BY cell_id ORDER BY
    greatest(x0 - x, x - x1, 0) ^ 2 + greatest(y0 - y, y - y1, 0) ^ 2, u.admin2_id) AS r FROM cells c JOIN units u ON c.country_iso = u.country_iso
    WHERE cell_id NOT IN (SELECT cell_id FROM held)),
attached AS (SELECT cell_id, country_iso, admin2_id, admin2_name, 1 AS w FROM held UNION ALL
    SELECT cell_id, country_iso, admin2_id, admin2_name, 0 FROM far WHERE r = 1)"""
BASE_ATTACH = roles.CELLS + "," + roles.UNITS + "," + ATTACH


@query("attach_units", "SELECT cell_id, country_iso, admin2_name, admin2_id FROM attached", base=BASE_ATTACH)
def _(spark, sf):
    units, edges = roles.units(spark, sf)
    out, _ = areas.attach_units(roles.cells(spark, sf).select("cell_id", "country_iso", "x", "y"), units, edges)
    return out.select("cell_id", "country_iso", "admin2_name", "admin2_id")


@query("attach_units_report", """
    SELECT country_iso, count(*) AS n_rows, CAST(sum(w) AS BIGINT) AS matched_within_count, CAST(sum(1 - w) AS BIGINT) AS matched_nearest_count,
    CAST(0 AS BIGINT) AS unmatched_count FROM attached GROUP BY 1""", base=BASE_ATTACH)
def _(spark, sf):
    units, edges = roles.units(spark, sf)
    return areas.attach_units(roles.cells(spark, sf).select("cell_id", "country_iso", "x", "y"), units, edges)[1]


@query("point_in_polygon", "SELECT cell_id, admin2_id FROM held", base=BASE_ATTACH)
def _(spark, sf):
    _, edges = roles.units(spark, sf)
    cells = roles.cells(spark, sf).select("cell_id", "country_iso", F.col("x").alias("qx"), F.col("y").alias("qy"))
    hits = areas.containing_units(cells.drop("cell_id").distinct(), edges, "country_iso", "admin2_id")
    return cells.join(hits, ["country_iso", "qx", "qy"]).select("cell_id", "admin2_id")


@query("unmatched_points", "SELECT cell_id, country_iso, x, y FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM held)",
       base=BASE_ATTACH)
def _(spark, sf):
    _, edges = roles.units(spark, sf)
    cells = roles.cells(spark, sf).select("cell_id", "country_iso", "x", "y")
    held = areas.inside(cells, edges.withColumnRenamed("admin2_id", "unit"), "country_iso")
    return areas.unmatched(cells, held, ["cell_id"])


@query("nearest_unit", """
    SELECT cell_id, admin2_id FROM (SELECT cell_id, u.admin2_id, row_number() OVER (PARTITION BY cell_id ORDER BY
    CASE WHEN x > x0 AND x < x1 AND y > y0 AND y < y1 THEN least(x - x0, x1 - x, y - y0, y1 - y) ^ 2
    ELSE greatest(x0 - x, x - x1, 0) ^ 2 + greatest(y0 - y, y - y1, 0) ^ 2 END, u.admin2_id) AS r
    FROM cells c JOIN units u ON c.country_iso = u.country_iso) WHERE r = 1""", base=BASE_ATTACH)
def _(spark, sf):
    _, edges = roles.units(spark, sf)
    cells = roles.cells(spark, sf).select("cell_id", "country_iso", F.col("x").alias("qx"), F.col("y").alias("qy"))
    hits = areas.nearest_units(cells.drop("cell_id").distinct(), edges, "country_iso", "admin2_id")
    return cells.join(hits, ["country_iso", "qx", "qy"]).select("cell_id", "admin2_id")


@query("polygon_centroids", """
    SELECT city, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM boxes""",
       ["area:3", "x", "y"], roles.PARCELS)
def _(spark, sf):
    return areas.centroids(roles.rectangle_edges(roles.parcels(spark, sf), ["city"]), ["city"])


# Two parts side by side, the second turned the other way, the first with a hole.
RECTS = roles.PARCELS + """,
rects AS (
    SELECT city, 1.0 AS sign, x0 AS a0, y0 AS b0, x0 + 0.4 * (x1 - x0) AS a1, y1 AS b1, x0, y0, x1, y1 FROM boxes
    UNION ALL SELECT city, 1.0, x0 + 0.6 * (x1 - x0), y0, x1, y1, x0, y0, x1, y1 FROM boxes
    UNION ALL SELECT city, -1.0, x0 + 0.1 * (x1 - x0), y0 + 0.25 * (y1 - y0), x0 + 0.3 * (x1 - x0), y0 + 0.75 * (y1 - y0), x0, y0, x1, y1 FROM boxes)"""


def multipart(spark, sf):
    boxes = roles.parcels(spark, sf)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    shapes = []
    for part, ring, (a, b, c, d), turned in ((0, 0, (0.0, 0.0, 0.4, 1.0), False), (1, 0, (0.6, 0.0, 1.0, 1.0), True), (0, 1, (0.1, 0.25, 0.3, 0.75), False)):
        box = boxes.select("city", (F.col("x0") + a * w).alias("x0"), (F.col("y0") + b * h).alias("y0"), (F.col("x0") + c * w).alias("x1"), (F.col("y0") + d * h).alias("y1"))
        edges = roles.rectangle_edges(box, ["city"]).withColumns({"part": F.lit(part), "ring": F.lit(ring)})
        if turned:
            edges = edges.selectExpr("city", "ring", "seq", "x2 AS x1", "y2 AS y1", "x1 AS x2", "y1 AS y2", "part")
        shapes.append(edges.select("city", "part", "ring", "seq", "x1", "y1", "x2", "y2"))
    return shapes[0].unionByName(shapes[1]).unionByName(shapes[2])


@query("centroids_multipart", """
    SELECT city, sum(m) AS area, sum(m * (a0 + a1) / 2) / sum(m) AS x, sum(m * (b0 + b1) / 2) / sum(m) AS y
    FROM (SELECT *, sign * (a1 - a0) * (b1 - b0) AS m FROM rects) GROUP BY city""", ["area:3", "x", "y"], RECTS)
def _(spark, sf):
    return areas.centroids(multipart(spark, sf), ["city"])


@query("grid_multipart", """
    SELECT city, ix, iy, sum(m) AS area_m2 FROM (
        SELECT city, ix, iy, sign * greatest(0.0, least(a1, x0 + ix * 500.0 + 500.0) - greatest(a0, x0 + ix * 500.0))
            * greatest(0.0, least(b1, y0 + iy * 500.0 + 500.0) - greatest(b0, y0 + iy * 500.0)) AS m
        FROM (SELECT *, unnest(range(0, CAST(ceil((y1 - y0) / 500.0) AS BIGINT))) AS iy
            FROM (SELECT *, unnest(range(0, CAST(ceil((x1 - x0) / 500.0) AS BIGINT))) AS ix FROM rects)))
    GROUP BY 1, 2, 3 HAVING sum(m) > 1e-6""", ["area_m2:3"], RECTS)
def _(spark, sf):
    return areas.grid(multipart(spark, sf)).select("city", "ix", "iy", "area_m2")


@query("interior_points", """
    SELECT city, ix, iy, true AS in_cell, true AS in_boundary FROM (
        SELECT city, ix, iy, sum(m) AS area_m2 FROM (
            SELECT city, ix, iy, sign * greatest(0.0, least(a1, x0 + ix * 500.0 + 500.0) - greatest(a0, x0 + ix * 500.0))
                * greatest(0.0, least(b1, y0 + iy * 500.0 + 500.0) - greatest(b0, y0 + iy * 500.0)) AS m
            FROM (SELECT *, unnest(range(0, CAST(ceil((y1 - y0) / 500.0) AS BIGINT))) AS iy
                FROM (SELECT *, unnest(range(0, CAST(ceil((x1 - x0) / 500.0) AS BIGINT))) AS ix FROM rects)))
        GROUP BY 1, 2, 3 HAVING sum(m) > 1e-6)""", base=RECTS)
def _(spark, sf):
    edges = multipart(spark, sf)
    found = keep(areas.interior_points(edges, areas.grid(edges)))
    held = F.col("inner_x").between(F.col("x0"), F.col("x1")) & F.col("inner_y").between(F.col("y0"), F.col("y1"))
    points = found.select("city", F.col("inner_x").alias("qx"), F.col("inner_y").alias("qy"))
    hits = areas.containing_units(points.distinct(), edges.withColumn("unit", F.lit(0)), "city", "unit")
    named = keep(hits.select("city", F.col("qx").alias("inner_x"), F.col("qy").alias("inner_y"), F.lit(True).alias("hit")))
    joined = found.join(named, ["city", "inner_x", "inner_y"], "left")
    return joined.select("city", "ix", "iy", held.alias("in_cell"), F.coalesce("hit", F.lit(False)).alias("in_boundary"))


@query("grid_cells", """
    SELECT city, regexp_replace(lower(city), '[^a-z0-9]+', '_', 'g') || '_' || lpad(CAST(row_number() OVER (PARTITION BY city ORDER BY ix, iy) AS VARCHAR), 5, '0') AS cell_id,
    ix, iy, cx0 AS x0, cy0 AS y0, (cx1 - cx0) * (cy1 - cy0) AS area_m2, (cx1 - cx0) * (cy1 - cy0) / 1000000.0 AS area_km2,
    (cx0 + cx1) / 2 AS x, (cy0 + cy1) / 2 AS y FROM gridded""", ["x0", "y0", "area_m2:3", "area_km2", "x", "y"], roles.PARCELS)
def _(spark, sf):
    edges = roles.rectangle_edges(roles.parcels(spark, sf), ["city"])
    return areas.grid(edges, 500.0).drop("origin_x", "origin_y", "x1", "y1")


@query("contains_count", """
    SELECT g.city, ix, iy, count(c_custkey) AS n, count(c_custkey) / any_value((cx1 - cx0) * (cy1 - cy0) / 1000000.0) AS n_per_km2
    FROM gridded g LEFT JOIN (SELECT c_custkey, CAST((c_custkey * 7919) % 10007 AS DOUBLE) + 0.25 AS x, CAST((c_custkey * 104729) % 10009 AS DOUBLE) + 0.25 AS y FROM customer)
    ON x > cx0 AND x < cx1 AND y > cy0 AND y < cy1 GROUP BY 1, 2, 3""", ["n_per_km2"], roles.PARCELS)
def _(spark, sf):
    parcels = roles.parcels(spark, sf)
    edges = roles.rectangle_edges(parcels, ["city"])
    cells = areas.grid(edges, 500.0)
    # Parcels overlap, so a customer is a node of every parcel it lies in.
    key = F.col("c_custkey")
    nodes = roles.table(spark, sf, "customer").select((roles.hash_x(key) + 0.25).alias("x"), (roles.hash_y(key) + 0.25).alias("y"))
    out = areas.contains_count(cells, nodes, 500.0, "n", edges=edges)
    return out.select("city", "ix", "iy", "n", "n_per_km2")


@query("geojson_polygon_edges", """
    SELECT s_suppkey, seq, CASE seq WHEN 0 THEN x ELSE CASE seq WHEN 1 THEN x + 10 WHEN 2 THEN x + 10 ELSE x END END AS x1,
    CASE seq WHEN 0 THEN y WHEN 1 THEN y ELSE y + 10 END AS y1, CASE seq WHEN 0 THEN x + 10 WHEN 1 THEN x + 10 ELSE x END AS x2,
    CASE seq WHEN 0 THEN y WHEN 3 THEN y ELSE y + 10 END AS y2 FROM (SELECT s_suppkey, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS x,
    CAST((s_suppkey * 104729) % 10009 AS DOUBLE) AS y FROM supplier), generate_series(0, 3) AS t(seq)""", ["x1", "y1", "x2", "y2"])
def _(spark, sf):
    key = F.col("s_suppkey")
    x, y = roles.hash_x(key), roles.hash_y(key)
    corner = [(x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10), (x, y)]
    rings = F.to_json(F.array(F.array(*[F.array(a, b) for a, b in corner])))
    rows = roles.table(spark, sf, "supplier").select(
        "s_suppkey", F.lit("Polygon").alias("geometry_type"), rings.alias("coordinates")
    )
    return geojson.polygon_edges(rows, ["s_suppkey"]).drop("part", "ring")


@query("tile_codes", """
    SELECT s_suppkey, CASE WHEN s >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(s) AS VARCHAR), 2, '0') || CASE WHEN w >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(w) AS VARCHAR), 3, '0') AS tile
    FROM (SELECT s_suppkey, unnest(generate_series(CAST(floor(lat / 3) * 3 AS BIGINT), CAST(floor((lat + 2) / 3) * 3 AS BIGINT), 3)) AS s, lon FROM
    (SELECT s_suppkey, (s_suppkey * 7919) % 120 - 60.5 AS lat, (s_suppkey * 104729) % 340 - 170.25 AS lon FROM supplier)) ,
    LATERAL (SELECT unnest(generate_series(CAST(floor(lon / 3) * 3 AS BIGINT), CAST(floor((lon + 4) / 3) * 3 AS BIGINT), 3)) AS w)""")
def _(spark, sf):
    key = F.col("s_suppkey")
    lat, lon = (key * 7919) % 120 - 60.5, (key * 104729) % 340 - 170.25
    bounds = roles.table(spark, sf, "supplier").select(
        "s_suppkey", lon.alias("minx"), lat.alias("miny"), (lon + 4).alias("maxx"), (lat + 2).alias("maxy")
    )
    cities = bounds.select("s_suppkey")
    return features.city_tiles(cities, bounds, "s_suppkey")


@query("utm_round_trip", """
    SELECT c_custkey AS cell_id, CAST(floor((m + 180) / 6) + 1 AS BIGINT) AS utm_zone, CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 250 + c_nationkey * 6 - 60 AS lon,
    CAST((c_custkey * 104729) % 1000 AS DOUBLE) / 20 - 25 AS lat FROM customer JOIN (SELECT c_nationkey, avg(CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 250 + c_nationkey * 6 - 60) AS m
    FROM customer GROUP BY 1) USING (c_nationkey)""", ["lon", "lat"])
def _(spark, sf):
    key = F.col("c_custkey")
    rows = roles.table(spark, sf, "customer").select(
        key.alias("cell_id"), "c_nationkey",
        (((key * 7919) % 1000).cast("double") / 250 + F.col("c_nationkey") * 6 - 60).alias("lon"),
        (((key * 104729) % 1000).cast("double") / 20 - 25).alias("lat"),
    )
    projected = areas.project(rows, "c_nationkey").drop("lon", "lat")
    return areas.unproject(projected).select("cell_id", "utm_zone", "lon", "lat")


# -------------------------------------------------------------------- pixels

BASE_PIXELS = roles.LATTICE + "," + roles.PIXELS


@query("pixel_scan", "SELECT value, count(*) AS n FROM pixels WHERE value <> 13 GROUP BY 1", ["value"], roles.PIXELS)
def _(spark, sf):
    return raster.scan_pixels(roles.pixels(spark, sf), 13.0).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("pick_raster", """
    SELECT l_returnflag, l_shipmode, count(*) AS n FROM (SELECT l_returnflag, l_linenumber AS l_shipmode, max(l_linenumber) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)
    WHERE l_shipmode = m GROUP BY 1, 2""")
def _(spark, sf):
    rows = roles.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("l_shipmode"))
    return raster.pick_raster(rows, "l_returnflag", "l_shipmode").groupBy("l_returnflag", "l_shipmode").agg(
        F.count(F.lit(1)).alias("n")
    )


MOSAIC = """SELECT row, col, value FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY tile_seq {way}) AS r FROM (
    SELECT o_orderkey % 100 AS row, o_custkey % 100 AS col, o_orderkey AS tile_seq, o_totalprice AS value FROM orders)) WHERE r = 1"""


def _tiles(spark, sf):
    return roles.table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 100).alias("row"), (F.col("o_custkey") % 100).alias("col"),
        F.col("o_orderkey").alias("tile_seq"), F.col("o_totalprice").alias("value"),
    )


@query("mosaic_first", MOSAIC.format(way="ASC"), ["value"])
def _(spark, sf):
    return raster.mosaic(_tiles(spark, sf))


@query("mosaic_last", MOSAIC.format(way="DESC"), ["value"])
def _(spark, sf):
    return raster.mosaic(_tiles(spark, sf), first=False)


ZONAL = [
    "count", "min", "max", "mean", "sum", "std", "range", "median", "percentile_90", "majority", "minority", "unique",
]


@query("zonal_stats", f"""
    SELECT cell_id, coalesce(n, 0) > 0 AS v_available, n AS v_count, v_min, v_max, v_mean, v_sum, v_std, v_max - v_min AS v_range, v_median, v_percentile_90, v_majority, v_minority, v_unique
    FROM lattice LEFT JOIN (SELECT cell_id, count(*) AS n, min(value) AS v_min, max(value) AS v_max, avg(value) AS v_mean, sum(value) AS v_sum, stddev_pop(value) AS v_std,
    quantile_cont(value, 0.5) AS v_median, quantile_cont(value, 0.9) AS v_percentile_90 FROM touched GROUP BY 1) USING (cell_id) LEFT JOIN (
    SELECT cell_id, arg_min(value, struct_pack(a := -c, b := value)) AS v_majority, arg_min(value, struct_pack(a := c, b := value)) AS v_minority, count(*) AS v_unique
    FROM (SELECT cell_id, value, count(*) AS c FROM touched GROUP BY 1, 2) GROUP BY 1) USING (cell_id)""",
       ["v_min", "v_max", "v_mean", "v_sum", "v_std", "v_range", "v_median", "v_percentile_90", "v_majority", "v_minority"],
       BASE_PIXELS + f", touched AS (SELECT cell_id, value FROM lattice JOIN pixels ON {roles.TOUCH} WHERE value <> 13)")
def _(spark, sf):
    pixels = raster.scan_pixels(roles.pixels(spark, sf), 13.0)
    out = raster.zonal_stats(roles.lattice(spark, sf), pixels, ZONAL, "v", bucket=500.0)
    return out.drop("x0", "y0", "x1", "y1")


@query("zonal_coverage", f"""
    SELECT count(*) AS n_rows, CAST(sum(h) AS BIGINT) AS n_available_rows, avg(h) AS coverage_share FROM (
    SELECT cell_id, max(CASE WHEN value IS NULL THEN 0 ELSE 1 END) AS h FROM lattice LEFT JOIN (SELECT * FROM pixels WHERE value >= 48) ON {roles.TOUCH} GROUP BY 1)""",
       ["coverage_share"], BASE_PIXELS)
def _(spark, sf):
    pixels = roles.pixels(spark, sf).where(F.col("value") >= 48)
    return raster.coverage(raster.zonal_stats(roles.lattice(spark, sf), pixels, ["mean"], "v", bucket=500.0), "v")


@query("population_sum", f"""
    SELECT cell_id, coalesce(sum(value), 0) AS population FROM lattice LEFT JOIN pixels ON {roles.TOUCH} GROUP BY 1""",
       ["population"], BASE_PIXELS)
def _(spark, sf):
    return raster.population_sum(roles.lattice(spark, sf), roles.pixels(spark, sf)).select("cell_id", "population")


@query("class_shares", f"""
    SELECT cell_id, count(*) FILTER (WHERE cover = 50) / count(*)::DOUBLE AS building_coverage_ratio,
    count(*) FILTER (WHERE cover IN (10, 20, 30, 60, 90)) / count(*)::DOUBLE AS open_space_share
    FROM lattice JOIN pixels ON {roles.TOUCH} WHERE cover <> 0 GROUP BY 1 UNION ALL SELECT cell_id, NULL, NULL FROM lattice WHERE cell_id NOT IN
    (SELECT cell_id FROM lattice JOIN pixels ON {roles.TOUCH} WHERE cover <> 0)""",
       ["building_coverage_ratio", "open_space_share"], BASE_PIXELS)
def _(spark, sf):
    cover = raster.scan_pixels(roles.pixels(spark, sf).withColumn("value", F.col("cover")), 0.0)
    return raster.class_shares(roles.lattice(spark, sf), cover, bucket=500.0).select(
        "cell_id", "building_coverage_ratio", "open_space_share"
    )


@query("patch_features", """
    SELECT cell_id, sum(v) FILTER (WHERE ch = 4) AS amenities, sum(v) FILTER (WHERE ch = 5) AS schools, count(*) AS filled FROM (
    SELECT a.cell_id, ch, floor((b.x - (a.x - 750)) / 187.5) AS c, floor((b.y - (a.y - 750)) / 187.5) AS r, ln(1 + count(*)) AS v
    FROM spot a JOIN (SELECT city, x, y, CASE WHEN lower(amenity) IN ('school', 'university') THEN 5 ELSE 4 END AS ch FROM amenities
    WHERE coalesce(lower(amenity) NOT IN ('bench', 'parking'), true)) b
    ON a.city = b.city AND b.x >= a.x - 750 AND b.x < a.x + 750 AND b.y >= a.y - 750 AND b.y < a.y + 750 GROUP BY ALL) GROUP BY 1""",
       ["amenities", "schools"], CUSTOMER + "," + roles.AMENITY)
def _(spark, sf):
    points = C.service_points(roles.amenities(spark, sf)).select(
        "city", F.when(C.is_school(), "schools").otherwise("amenities").alias("channel"), "x", "y"
    )
    empty = points.select("city", F.lit("cover").alias("channel"), "x", "y", F.lit(0.0).alias("value")).limit(0)
    rows = raster.patch_features(spots(spark, sf), empty, points, patch_size=8)

    def channel(i: int):
        part = F.slice("patch", i * 64 + 1, 64)
        return F.aggregate(part, F.lit(0.0), lambda a, v: a + v.cast("double"))

    filled = F.size(F.filter("patch", lambda v: v != 0))
    out = rows.select("cell_id", channel(4).alias("amenities"), channel(5).alias("schools"), filled.alias("filled"))
    # Sums of single-precision slots are good to about six digits.
    return out.where(F.col("filled") > 0).select(
        "cell_id", F.when(F.col("amenities") > 0, F.col("amenities")).alias("amenities"),
        F.when(F.col("schools") > 0, F.col("schools")).alias("schools"), "filled",
    )


WINDOW_BASE = CUSTOMER + "," + roles.AMENITY + "," + roles.ROADS + "," + roles.PIXELS + """,
raster AS (SELECT CAST(floor(px / 100) AS BIGINT) AS gx, CAST(floor(py / 100) AS BIGINT) AS gy, max(value) AS pop, CAST(sum(cover / 10) AS BIGINT) % 10 * 10 AS cls
    FROM pixels GROUP BY 1, 2),
steps AS (SELECT r, c FROM range(64) a(r), range(64) b(c)),
looks AS (SELECT cell_id, r, c, (x - 750 + (c + 0.5::DOUBLE) * 23.4375::DOUBLE) / 100 AS u, (y + 750 - (r + 0.5::DOUBLE) * 23.4375::DOUBLE) / 100 AS v FROM spot, steps),
bases AS (SELECT cell_id, r, c, CAST(floor(u - 0.5) AS BIGINT) AS gx, CAST(floor(v - 0.5) AS BIGINT) AS gy, u - 0.5 - floor(u - 0.5) AS fx, v - 0.5 - floor(v - 0.5) AS fy FROM looks),
shares AS (SELECT cell_id, r, c, s.pop AS a, t.pop AS b, p.pop AS d, q.pop AS e, (1 - fx) * (1 - fy) AS wa, (1 - fx) * fy AS wb, fx * (1 - fy) AS wd, fx * fy AS we FROM bases k
    LEFT JOIN raster s ON s.gx = k.gx AND s.gy = k.gy LEFT JOIN raster t ON t.gx = k.gx AND t.gy = k.gy + 1
    LEFT JOIN raster p ON p.gx = k.gx + 1 AND p.gy = k.gy LEFT JOIN raster q ON q.gx = k.gx + 1 AND q.gy = k.gy + 1),
people AS (SELECT cell_id, 0 AS ch, r, c, ln(1 + (coalesce(wa * a, 0) + coalesce(wb * b, 0) + coalesce(wd * d, 0) + coalesce(we * e, 0)) / w) AS v FROM (SELECT *,
    CASE WHEN a IS NULL THEN 0 ELSE wa END + CASE WHEN b IS NULL THEN 0 ELSE wb END + CASE WHEN d IS NULL THEN 0 ELSE wd END + CASE WHEN e IS NULL THEN 0 ELSE we END AS w
    FROM shares) WHERE w > 0),
classes AS (SELECT cell_id, CASE WHEN cls = 50 THEN 1 ELSE 2 END AS ch, r, c, 1.0 AS v FROM looks JOIN raster
    ON CAST(floor(u) AS BIGINT) = gx AND CAST(floor(v) AS BIGINT) = gy WHERE cls IN (10, 20, 30, 50, 60, 90, 95)),
near AS (SELECT cell_id, x1 - (x - 750) AS x1, y1 - (y - 750) AS y1, x2 - (x - 750) AS x2, y2 - (y - 750) AS y2 FROM spot JOIN roads USING (city)
    WHERE least(x1, x2) < x + 750 AND greatest(x1, x2) >= x - 750 AND least(y1, y2) < y + 750 AND greatest(y1, y2) >= y - 750),
touched AS (SELECT n.*, i, j FROM near n, LATERAL (SELECT unnest(range(greatest(0, CAST(floor(least(x1, x2) / 23.4375) AS BIGINT)), least(63, CAST(floor(greatest(x1, x2) / 23.4375) AS BIGINT)) + 1)) AS i),
    LATERAL (SELECT unnest(range(greatest(0, CAST(floor(least(y1, y2) / 23.4375) AS BIGINT)), least(63, CAST(floor(greatest(y1, y2) / 23.4375) AS BIGINT)) + 1)) AS j)),
spanned AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len,
    CASE WHEN x1 = x2 THEN 0 ELSE least((i * 23.4375 - x1) / (x2 - x1), ((i + 1) * 23.4375 - x1) / (x2 - x1)) END AS low_x, CASE WHEN x1 = x2 THEN 1 ELSE greatest((i * 23.4375 - x1) / (x2 - x1), ((i + 1) * 23.4375 - x1) / (x2 - x1)) END AS high_x,
    CASE WHEN y1 = y2 THEN 0 ELSE least((j * 23.4375 - y1) / (y2 - y1), ((j + 1) * 23.4375 - y1) / (y2 - y1)) END AS low_y, CASE WHEN y1 = y2 THEN 1 ELSE greatest((j * 23.4375 - y1) / (y2 - y1), ((j + 1) * 23.4375 - y1) / (y2 - y1)) END AS high_y
    FROM touched),
lanes AS (SELECT DISTINCT cell_id, 3 AS ch, 63 - j AS r, i AS c, 1.0 AS v FROM spanned WHERE len = 0 OR (least(1, high_x, high_y) - greatest(0, low_x, low_y)) * len > 1e-6),
marks AS (SELECT city, x, y, 4 AS ch FROM amenities WHERE coalesce(lower(amenity) NOT IN ('bench', 'parking'), true)
    UNION ALL SELECT city, x, y, 5 FROM amenities WHERE lower(amenity) IN ('school', 'university')
    UNION ALL SELECT city, x, y, 6 FROM amenities WHERE coalesce(lower(amenity) IN ('clinic', 'pharmacy'), false) OR coalesce(healthcare IN ('yes', 'doctors'), false)
    UNION ALL SELECT city, x, y, 7 FROM amenities WHERE street_count >= 3),
counted AS (SELECT cell_id, ch, r, c, ln(1 + count(*)) AS v FROM (SELECT cell_id, ch, 63 - CAST(floor((m.y - (s.y - 750)) / 23.4375) AS BIGINT) AS r, CAST(floor((m.x - (s.x - 750)) / 23.4375) AS BIGINT) AS c
    FROM spot s JOIN marks m USING (city) WHERE m.x >= s.x - 750 AND m.x < s.x + 750 AND m.y >= s.y - 750 AND m.y < s.y + 750) GROUP BY 1, 2, 3, 4),
filled AS (SELECT cell_id, ch, r * 64 + c AS slot, CAST(floor(CAST(CAST(v AS FLOAT) AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS v FROM (
    FROM people UNION ALL FROM classes UNION ALL FROM lanes UNION ALL FROM counted) WHERE CAST(v AS FLOAT) <> 0)"""


@query("patch_channels", """
    SELECT cell_id, CAST(ch AS BIGINT) AS channel, count(slot) AS n_filled, sha256(coalesce(string_agg(slot || ':' || v, ',' ORDER BY slot), '')) AS slots_sha256
    FROM (SELECT cell_id, ch FROM spot, range(8) t(ch)) LEFT JOIN filled USING (cell_id, ch) GROUP BY 1, 2""", base=WINDOW_BASE)
def _(spark, sf):
    """All slots of all channels: 64 x 64 patches over filled rasters and roads,
    a digest of the filled slots of each channel in thousandths."""
    pois = roles.amenities(spark, sf)
    channels = F.array(
        F.when(C.is_service(), F.lit("amenities")), F.when(C.is_school(), F.lit("schools")), F.when(C.is_clinic(pois), F.lit("clinics")),
        F.when(F.col("street_count") >= 3, F.lit("intersections")),
    )
    points = pois.select("city", F.explode(channels).alias("channel"), "x", "y")
    raster_cells = roles.pixels(spark, sf).groupBy(F.floor(F.col("px") / 100).alias("gx"), F.floor(F.col("py") / 100).alias("gy")).agg(
        F.max("value").cast("double").alias("pop"), (F.sum(F.col("cover") / 10).cast("bigint") % 10 * 10).cast("double").alias("cls")
    )
    layers = F.array(F.struct(F.lit("population").alias("channel"), F.col("pop").alias("value")), F.struct(F.lit("cover").alias("channel"), F.col("cls").alias("value")))
    pixels = raster_cells.withColumn("l", F.explode(layers)).select(
        F.explode(F.array(*[F.lit(c) for c in roles.CITIES])).alias("city"), "l.channel", "l.value",
        ((F.col("gx") + 0.5) * 100).alias("x"), ((F.col("gy") + 0.5) * 100).alias("y"),
    )
    rows = raster.patch_features(
        spots(spark, sf), pixels, points, roles.roads(spark, sf), summary=(raster.SLOT_DIGESTS, raster.slot_digests())
    )
    return rows.select("cell_id", F.posexplode(F.arrays_zip("n_filled", "slots_sha256")).alias("channel", "s")).select(
        "cell_id", F.col("channel").cast("bigint").alias("channel"), "s.n_filled", "s.slots_sha256"
    )


def _sql_nearest(layer: str, where: str, out: str) -> str:
    return f"""{out} AS (SELECT g.city, ix, iy, sqrt(min((g.x - b.x) * (g.x - b.x) + (g.y - b.y) * (g.y - b.y))) AS d
    FROM cellz g JOIN {layer} b ON g.z = b.z WHERE {where} GROUP BY 1, 2, 3)"""


def _sql_within(where: str, out: str) -> str:
    return f"""{out} AS (SELECT g.city, ix, iy, count(*) AS n FROM cellz g JOIN poiz b ON g.z = b.z
    AND (g.x - b.x) * (g.x - b.x) + (g.y - b.y) * (g.y - b.y) < 1000000.0 WHERE {where} GROUP BY 1, 2, 3)"""


IS_SCHOOL = "lower(amenity) IN ('school', 'university')"
IS_CLINIC = "(coalesce(lower(amenity) IN ('clinic', 'pharmacy'), false) OR coalesce(healthcare IN ('yes', 'doctors'), false))"
STUDY = f"""
cellz AS (SELECT g.*, (g.cx0 + g.cx1) / 2 AS x, (g.cy0 + g.cy1) / 2 AS y, (g.cx1 - g.cx0) * (g.cy1 - g.cy0) / 1000000.0 AS km2,
    s_suppkey % 5 AS z FROM gridded g JOIN supplier ON s_name = city),
poiz AS (SELECT *, poi_id % 5 AS z FROM amenities),
roadz AS (SELECT r.*, k.z FROM roads r JOIN (SELECT DISTINCT city, poi_id % 5 AS z FROM amenities) k USING (city)),
rd AS (SELECT city, ix, iy, sqrt(min(ex * ex + ey * ey)) AS d FROM (SELECT city, ix, iy, x1 + t * (x2 - x1) - x AS ex, y1 + t * (y2 - y1) - y AS ey FROM (
    SELECT *, CASE WHEN l2 > 0 THEN greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2)) ELSE 0.0 END AS t FROM (
    SELECT g.city, ix, iy, x, y, x1, y1, x2, y2, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l2 FROM cellz g JOIN roadz r ON g.z = r.z))) GROUP BY 1, 2, 3),
{_sql_nearest("poiz", IS_SCHOOL, "sd")},
{_sql_nearest("poiz", IS_CLINIC, "cd")},
{_sql_within("coalesce(lower(amenity) NOT IN ('bench', 'parking'), true)", "am")},
sv AS (SELECT city, ix, iy, sum(n) AS n FROM (SELECT g.city, ix, iy, CAST({IS_SCHOOL} IS TRUE AS INT) + CAST({IS_CLINIC} AS INT) AS n FROM cellz g JOIN poiz b ON g.z = b.z
    AND (g.x - b.x) * (g.x - b.x) + (g.y - b.y) * (g.y - b.y) < 1000000.0) GROUP BY 1, 2, 3),
nd AS (SELECT g.city, ix, iy, count(*) AS n FROM cellz g JOIN poiz b ON g.z = b.z AND b.x >= cx0 AND b.x < cx1 AND b.y >= cy0 AND b.y < cy1
    WHERE street_count >= 3 GROUP BY 1, 2, 3),
pz AS (SELECT g.city, ix, iy, sum(value) AS pop, count(*) FILTER (WHERE cover = 50) AS built, count(*) FILTER (WHERE cover IN (10, 20, 30, 60, 90)) AS op,
    count(*) FILTER (WHERE cover <> 0) AS n FROM cellz g JOIN pixels p ON g.z = CAST(px AS BIGINT) % 5
    AND px0 < cx1 AND px1 > cx0 AND py0 < cy1 AND py1 > cy0 GROUP BY 1, 2, 3)"""


@query("build_features", """
    SELECT g.city, ix, iy, km2 AS area_km2, coalesce(pop, 0) AS population, rd.d AS road_distance_m, sd.d AS school_distance_m, cd.d AS clinic_distance_m,
    coalesce(am.n, 0) AS amenity_count_1km, CAST(coalesce(sv.n, 0) AS BIGINT) AS service_count_1km, coalesce(pop, 0) / greatest(coalesce(sv.n, 0), 1) AS population_per_service,
    built / nullif(pz.n, 0)::DOUBLE AS building_coverage_ratio, op / nullif(pz.n, 0)::DOUBLE AS open_space_share, coalesce(nd.n, 0) / km2 AS intersection_density_km2,
    CAST(500 AS BIGINT) AS grid_cell_size_m
    FROM cellz g LEFT JOIN rd USING (city, ix, iy) LEFT JOIN sd USING (city, ix, iy) LEFT JOIN cd USING (city, ix, iy) LEFT JOIN am USING (city, ix, iy)
    LEFT JOIN sv USING (city, ix, iy) LEFT JOIN nd USING (city, ix, iy) LEFT JOIN pz USING (city, ix, iy)""",
       ["area_km2", "population", "road_distance_m", "school_distance_m", "clinic_distance_m", "population_per_service",
        "building_coverage_ratio", "open_space_share", "intersection_density_km2:4"],
       roles.PARCELS + "," + roles.AMENITY + "," + roles.ROADS + "," + roles.PIXELS + "," + STUDY)
def _(spark, sf):
    """All suppliers' parcels at once; the parcels of a zone share its layers."""
    parcels = roles.keep(roles.parcels(spark, sf))
    edges = roles.rectangle_edges(parcels, ["city"])
    zones = roles.table(spark, sf, "supplier").select(F.col("s_name").alias("city"), (F.col("s_suppkey") % 5).alias("zone"))
    number = F.coalesce(*[F.when(F.col("city") == c, F.lit(i).cast("bigint")) for i, c in enumerate(roles.CITIES)])
    pois = roles.amenities(spark, sf).withColumn("zone", number).drop("city")
    streets = roles.roads(spark, sf).withColumn("zone", number).drop("city")
    grid = roles.pixels(spark, sf).withColumn("zone", F.col("px").cast("bigint") % 5)
    out, _ = features.build_features(
        edges, streets, pois, pois, grid.select("zone", "px0", "py0", "px1", "py1", "value"),
        grid.select("zone", "px0", "py0", "px1", "py1", F.col("cover").alias("value")).where("value <> 0"), zones=zones,
    )
    return out.select(
        "city", "ix", "iy", "area_km2", "population", "road_distance_m", "school_distance_m", "clinic_distance_m",
        "amenity_count_1km", "service_count_1km", "population_per_service", "building_coverage_ratio",
        "open_space_share", "intersection_density_km2", "grid_cell_size_m",
    )


@query("study_counts", "SELECT city, country_iso, count(*) AS grid_rows FROM cells GROUP BY 1, 2", base=roles.CELLS)
def _(spark, sf):
    from tessera.sources.tables import study_counts

    return study_counts(roles.cells(spark, sf))

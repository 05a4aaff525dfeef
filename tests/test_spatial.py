import math
import random

import pytest

from conftest import rows
from pyspark.sql import functions as F
from tessera.functions import geo
from tessera.operators import areas, moran, near, raster, targets


def table(spark, points):
    return spark.createDataFrame(points, "cell_id int, city string, x double, y double")


def clustered(seed, n, copies):
    """Scattered points, a tight cluster and many copies of one place."""
    rng = random.Random(seed)
    out = [("A", rng.uniform(0, 1e5), rng.uniform(0, 1e5)) for _ in range(n)]
    out += [("A", 5e4 + rng.uniform(0, 1), 5e4 + rng.uniform(0, 1)) for _ in range(n)]
    out += [("A", 123.0, 456.0)] * copies
    out += [("B", float(i), 0.0) for i in range(5)]
    return [(i, c, x, y) for i, (c, x, y) in enumerate(out)]


def brute(queries, targets_, k, skip_self):
    out = set()
    for i, c, x, y in queries:
        order = sorted(
            ((a - x) ** 2 + (b - y) ** 2, j) for j, d, a, b in targets_ if d == c and not (skip_self and j == i)
        )
        out |= {(i, j) for _, j in order[:k]}
    return out


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("way", ["few", "many", "salted"])
def test_knn_edges_equal_brute_force(spark, monkeypatch, k, way):
    points = clustered(3, 80, 30)
    if way != "few":  # too many queries to broadcast
        spark.conf.set("tessera.broadcastRows", "0")
    if way == "salted":
        monkeypatch.setattr(near, "_CROWDED", 5)
    got = {(r["src"], r["dst"]) for r in near.knn_edges(table(spark, points), ["city"], k, "cell_id").collect()}
    spark.conf.unset("tessera.broadcastRows")
    assert got == brute(points, points, k, True)


@pytest.mark.parametrize("block", [near._BLOCK, 7])
def test_vector_edges_use_all_elements(spark, monkeypatch, block):
    monkeypatch.setattr(near, "_BLOCK", block)
    rng = random.Random(4)
    # The first two elements tell nothing, or the opposite of the rest.
    points = [(i, "AB"[i % 2], [float(i % 3), -float(i), *(rng.choice([0.0, 50.0, 900.0]) + rng.random() for _ in range(6))]) for i in range(50)]
    points += [(i, "A", points[0][2]) for i in range(50, 60)] + [(60, "A", [1.0, None] * 4), (61, "A", None), (62, None, points[0][2]), (63, "A", [0.0])]
    df = spark.createDataFrame(points, "cell_id int, city string, v array<double>").repartition(3)
    whole = [(i, c, v) for i, c, v in points[:60]]
    expected = set()
    for i, c, v in whole:
        order = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, d, w in whole if d == c and j != i)
        expected |= {(i, j, seq) for seq, (_, j) in enumerate(order[:3], 1)}
    assert {(r["src"], r["dst"], r["seq"]) for r in near.vector_edges(df, ["city"], 3, "cell_id", "v").collect()} == expected


def test_nearest_line_in_many_buckets(spark):
    rng = random.Random(9)
    cells = [(i, "A", rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(60)]
    lines = [("A", *(rng.uniform(0, 1000) for _ in range(4))) for _ in range(25)]
    df = spark.createDataFrame(lines, "city string, x1 double, y1 double, x2 double, y2 double")

    def far(x, y, line):
        _, a, b, c, d = line
        t = max(0.0, min(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
        return math.hypot(a + t * (c - a) - x, b + t * (d - b) - y)

    for limit in ("200000", "0"):
        spark.conf.set("tessera.broadcastRows", limit)
        got = {r["cell_id"]: r["d"] for r in near.nearest_distance(table(spark, cells), df, "d").collect()}
        spark.conf.unset("tessera.broadcastRows")
        assert all(math.isclose(got[i], min(far(x, y, line) for line in lines), abs_tol=1e-9) for i, _, x, y in cells)


def _bucketed(spark, cells, lines):
    places = table(spark, cells).selectExpr("city", "x AS qx", "y AS qy")
    ends = spark.createDataFrame(lines, "city string, __x1 double, __y1 double, __x2 double, __y2 double")
    framed = ends.join(near._line_frame(places, ends, ["city"]), "city")
    return near._line_buckets(framed, ["city"], F.col("__s")).count()


def test_buckets_of_lines_follow_the_queries(spark):
    rng = random.Random(4)
    cells = [(i, "A", rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(70)]
    lines = [("A", x, y, x + 100, y - 60) for x, y in ((rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(2000))]
    assert _bucketed(spark, cells, lines) < 4 * len(lines)


def test_lines_of_a_hub_are_cut_only_near_the_queries(spark, monkeypatch):
    rng = random.Random(14)
    cells = [(i, "A", rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(70)] + [(70, "A", -4e4, 9e4)]
    turns = [rng.uniform(0, 7) for _ in range(300)]
    lines = [("A", 500.0, 500.0, 500 + 1e5 * math.cos(a), 500 + 1e5 * math.sin(a)) for a in turns]
    assert _bucketed(spark, cells[:70], lines) < 40 * len(lines)
    df = spark.createDataFrame(lines, "city string, x1 double, y1 double, x2 double, y2 double")

    def far(x, y):
        return min(math.hypot(x - 500, y - 500) if (x - 500) * math.cos(a) + (y - 500) * math.sin(a) < 0 else
                   abs((x - 500) * math.sin(a) - (y - 500) * math.cos(a)) for a in turns)

    monkeypatch.setattr(near, "_CROWDED", 1)  # salted
    spark.conf.set("tessera.broadcastRows", "0")
    got = {r["cell_id"]: r["d"] for r in near.nearest_distance(table(spark, cells), df, "d").collect()}
    spark.conf.unset("tessera.broadcastRows")
    assert len(got) == 71 and all(math.isclose(got[i], far(x, y), abs_tol=1e-7) for i, _, x, y in cells)


def test_shared_points_in_overlapping_boundaries(spark):
    """Points without a group count as their copies for each group do, also on
    corners, in holes and in parts turned the other way."""
    shapes = {"p": [[(0, 0), (900, 100), (700, 800), (100, 600)], [(200, 200), (200, 400), (400, 300)]], "q": [[(50, 700), (650, 750), (300, -100)]]}
    edges = []
    for city, rings in shapes.items():
        for ring, corners in enumerate(rings):
            edges += [(city, ring, *map(float, (*a, *b))) for a, b in zip(corners, corners[1:] + corners[:1])]
    edges = spark.createDataFrame(edges, "city string, ring int, x1 double, y1 double, x2 double, y2 double")
    rng = random.Random(3)
    spots = [(float(rng.randrange(-100, 1000, 50)), float(rng.randrange(-100, 1000, 50))) for _ in range(400)] + [(rng.uniform(0, 900), rng.uniform(0, 800)) for _ in range(300)]
    points = spark.createDataFrame([*spots, (None, 1.0)], "x double, y double")
    cells = areas.grid(edges, 250.0)
    copies = points.crossJoin(spark.createDataFrame([("p",), ("q",)], "city string"))
    got, want = (rows(areas.contains_count(cells, p, 250.0, "n", edges=edges).select("city", "ix", "iy", "n"), "city", "ix", "iy") for p in (points, copies))
    assert got == want and sum(r["n"] for r in got) > 300


def test_layers_of_a_zone_are_shared_by_its_cities(spark):
    corners = {"p": [(0, 0), (900, 100), (700, 800)], "q": [(50, 700), (650, 750), (300, -100)], "r": [(10, 10), (500, 10), (500, 600)]}
    edges = spark.createDataFrame([(c, 0, *map(float, (*a, *b))) for c, k in corners.items() for a, b in zip(k, k[1:] + k[:1])],
                                  "city string, ring int, x1 double, y1 double, x2 double, y2 double")
    zones = spark.createDataFrame([("p", 1), ("q", 1), ("r", 2)], "city string, zone int")
    rng = random.Random(8)
    spots = [(rng.randint(1, 2), rng.uniform(0, 900), rng.uniform(0, 800), float(rng.randint(0, 9))) for _ in range(500)]
    shared = spark.createDataFrame(spots, "zone int, x double, y double, value double").selectExpr("*", "x - 6 AS px0", "y - 6 AS py0", "x + 6 AS px1", "y + 6 AS py1")
    copies = shared.join(zones, "zone").drop("zone")
    cells = areas.grid(edges, 250.0).join(zones, "city").cache()
    for make in (
        lambda rows_, layer: areas.contains_count(cells, rows_, 250.0, "v", edges=edges, layer=layer),
        lambda rows_, layer: raster.population_sum(cells, rows_, ["city"], out="v", bucket=250.0, edges=edges, layer=layer),
    ):
        got, want = (rows(make(r, k).select("city", "ix", "iy", "v"), "city", "ix", "iy") for r, k in ((shared, "zone"), (copies, None)))
        assert got == want and sum(r["v"] for r in got) > 100


def test_knn_samples_equal_brute_force(spark):
    cells, samples = clustered(5, 60, 20), clustered(6, 70, 40)
    got = near.knn(
        table(spark, cells), table(spark, samples).withColumnRenamed("cell_id", "sid"), ["city"], 3, "cell_id", "sid"
    )
    assert {(r["cell_id"], r["sid"]) for r in got.collect()} == brute(cells, samples, 3, False)


def test_count_within_equals_brute_force(spark):
    cells, points = clustered(7, 60, 10), clustered(8, 90, 50)
    for radius, leaf in ((1000.0, 128), (25000.0, 128), (25000.0, 1), (25000.0, 12)):
        got = {r["cell_id"]: r["n"] for r in near.count_within(
            table(spark, cells), table(spark, points).drop("cell_id"), radius, "n", leaf=leaf).collect()}
        want = {i: sum(d == c and (a - x) ** 2 + (b - y) ** 2 < radius ** 2 for _, d, a, b in points)
                for i, c, x, y in cells}
        assert got == want


def test_count_within_a_crowded_spot(spark):
    """All points in a few metres, and on the circles' very edge."""
    rng = random.Random(19)
    points = [(i, "A", 500.0 + rng.uniform(0, 3), 500.0 + rng.uniform(0, 3)) for i in range(300)]
    points += [(300 + i, "A", 0.0, float(y)) for i, y in enumerate((-1000, -999, 0, 999, 1000, 1001))]
    cells = [(i, "A", x, y) for i, (x, y) in enumerate([(0.0, 0.0), (-500.0, 500.0), (501.0, -498.5), (501.0, 501.0), (1500.5, 501.0), (9e6, 0.0)])]
    cells.append((99, "A", None, 1.0))
    got = {r["cell_id"]: r["n"] for r in near.count_within(table(spark, cells), table(spark, points).drop("cell_id"), 1000.0, "n", leaf=8).collect()}
    want = {i: 0 if x is None else sum((a - x) ** 2 + (b - y) ** 2 < 1e6 for _, _, a, b in points) for i, _, x, y in cells}
    assert got == want and 0 < want[1] < 306
    none = near.count_within(table(spark, cells), table(spark, points).drop("cell_id").limit(0), 1000.0, "n")
    assert {r["n"] for r in none.collect()} == {0}


def test_count_within_makes_few_rows_of_a_circle(spark, monkeypatch):
    """A node's locations are held against its circles in tasks, in parts and
    shares where either are many, and not joined as a row for each of them."""
    rng = random.Random(23)
    cells = [(i, "A", rng.uniform(0, 4000), rng.uniform(0, 4000)) for i in range(200)] + [(900, None, 1.0, 1.0)]
    points = [(i, "A", rng.uniform(0, 4000), rng.uniform(0, 4000)) for i in range(3000)]
    points += [(i, "A", 2000.0, 2000.0) for i in range(50)]
    want = {i: sum(c == "A" and (a - x) ** 2 + (b - y) ** 2 < 1e6 for _, _, a, b in points) for i, c, x, y in cells}
    for asked, leaf, depth in ((50_000, 8_192, 16), (20, 8_192, 16), (20, 30, 0)):
        monkeypatch.setattr(near, "_ASKED", asked)
        monkeypatch.setattr(near, "_DEPTH", depth)
        out = near.count_within(table(spark, cells), table(spark, points).drop("cell_id"), 1000.0, "n", leaf=leaf)
        assert {r["cell_id"]: r["n"] for r in out.collect()} == want
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_nearest_distance_to_points_and_lines(spark):
    cells = table(spark, [(1, "A", 0.0, 5.0), (2, "A", 100.0, 3.0), (3, "B", 0.0, 0.0)])
    lines = spark.createDataFrame(
        [("A", -10.0, 0.0, 10.0, 0.0), ("A", 500.0, 0.0, 500.0, 900.0)], "city string, x1 double, y1 double, x2 double, y2 double"
    )
    out = rows(near.nearest_distance(cells, lines, "d"), "cell_id")
    assert out[0]["d"] == 5.0 and math.isclose(out[1]["d"], math.hypot(90, 3)) and out[2]["d"] is None
    none = lines.limit(0)
    assert [r["d"] for r in near.nearest_distance(cells, none, "d").collect()] == [None] * 3


def test_graph_stays_inside_cities(spark):
    df = spark.createDataFrame(
        [("a", "A", 0.0, 0.0), ("b", "A", 1.0, 0.0), ("c", "B", 0.1, 0.0), ("d", "B", 1.1, 0.0)],
        "cell_id string, city string, x double, y double",
    )
    got = {(r["src"], r["dst"]): r["weight"] for r in near.knn_graph(df, k=1).collect()}
    assert set(got) == {(a, b) for pair in ("ab", "cd") for a in pair for b in pair}
    assert all(math.isclose(w, 0.5) for w in got.values())


def test_weak_targets(spark):
    cells = spark.createDataFrame(
        [("a", "A", "KEN", 80.0, 0.0, 0.0), ("b", "A", "KEN", 20.0, 1000.0, 0.0)],
        "cell_id string, city string, country_iso string, deprivation_index_0_100 double, x double, y double",
    )
    samples = spark.createDataFrame(
        [(1, "KEN", -0.8, 0.1, 10.0, 0.0), (2, "KEN", 0.5, 0.2, 9000.0, 0.0)],
        "sample_id int, country_iso string, rwi double, error double, x double, y double",
    )
    out, report = targets.weak_targets(cells, samples, neighbors=1, max_distance=4000.0, low_quantile=0.5)
    a, b = rows(out, "cell_id")
    assert a["rwi_mean"] == b["rwi_mean"] == -0.8
    samples = samples.withColumn("x", F.when(F.col("sample_id") == 2, 1001.0).otherwise(F.col("x")))
    out, report = targets.weak_targets(cells, samples, neighbors=1, max_distance=0.5, low_quantile=0.5)
    a, b = rows(out, "cell_id")
    # All samples are beyond the limit, so the nearest is used all the same.
    assert a["rwi_mean"] < b["rwi_mean"] and a["rwi_bottom_quantile_flag"] and not b["rwi_bottom_quantile_flag"]
    assert a["rwi_deprivation_proxy_0_100"] > b["rwi_deprivation_proxy_0_100"]
    assert rows(report)[0]["label_coverage_share"] == 1.0


def polygon_edges(name, *rings):
    out = []
    for ring, points in enumerate(rings):
        for (a, b), (c, d) in zip(points, points[1:] + points[:1]):
            out.append((name, ring, float(a), float(b), float(c), float(d)))
    return out


EDGES = "city string, ring int, x1 double, y1 double, x2 double, y2 double"


def clip_area(points, x0, y0, x1, y1):
    """Area and centroid of a polygon cut to a box, by halving planes."""
    def cut(poly, inside, meet):
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1]):
            if inside(p):
                out.append(p)
            if inside(p) != inside(q):
                out.append(meet(p, q))
        return out

    def at_x(v):
        return lambda p, q: (v, p[1] + (q[1] - p[1]) * (v - p[0]) / (q[0] - p[0]))

    def at_y(v):
        return lambda p, q: (p[0] + (q[0] - p[0]) * (v - p[1]) / (q[1] - p[1]), v)

    poly = points
    for inside, meet in (
        (lambda p: p[0] >= x0, at_x(x0)), (lambda p: p[0] <= x1, at_x(x1)),
        (lambda p: p[1] >= y0, at_y(y0)), (lambda p: p[1] <= y1, at_y(y1)),
    ):
        poly = cut(poly, inside, meet) if poly else poly
    cross = [(p, q, p[0] * q[1] - q[0] * p[1]) for p, q in zip(poly, poly[1:] + poly[:1])]
    area = sum(c for _, _, c in cross) / 2
    if abs(area) < 1e-9:
        return 0.0, None
    return abs(area), (sum((p[0] + q[0]) * c for p, q, c in cross) / 6 / area, sum((p[1] + q[1]) * c for p, q, c in cross) / 6 / area)


def test_grid_area_and_centroid_of_a_concave_polygon(spark):
    shape = [(3, 2), (37, 5), (30, 18), (41, 33), (12, 30), (18, 15)]
    for ring in (shape, shape[::-1]):  # either turn of the outline
        cells = rows(areas.grid(spark.createDataFrame(polygon_edges("My City", ring), EDGES), 7.0), "cell_id")
        assert [c["cell_id"] for c in cells] == [f"my_city_{i + 1:05d}" for i in range(len(cells))]
        total = 0.0
        for c in cells:
            want, centre = clip_area(shape, c["x0"], c["y0"], c["x1"], c["y1"])
            assert math.isclose(c["area_m2"], want, abs_tol=1e-9)
            assert math.isclose(c["x"], centre[0], abs_tol=1e-6) and math.isclose(c["y"], centre[1], abs_tol=1e-6)
            total += want
        assert math.isclose(total, clip_area(shape, 0, 0, 99, 99)[0])


def test_grid_with_a_hole(spark):
    outer = [(0, 0), (10, 0), (10, 10), (0, 10)]
    hole = [(2, 2), (8, 2), (8, 8), (2, 8)]
    cells = rows(areas.grid(spark.createDataFrame(polygon_edges("h", outer, hole), EDGES), 5.0))
    assert [round(c["area_m2"], 9) for c in cells] == [16.0] * 4
    centre = rows(areas.centroids(spark.createDataFrame(polygon_edges("h", outer, hole), EDGES), ["city"]))[0]
    assert math.isclose(centre["area"], 64.0) and math.isclose(centre["x"], 5.0)


def test_attach_units(spark):
    square = lambda x: [(x, 0), (x + 1, 0), (x + 1, 1), (x, 1)]
    edges = polygon_edges("u1", square(0)) + polygon_edges("u2", square(1))
    edges = spark.createDataFrame([("KEN", *e) for e in edges], "country_iso string, admin2_id string, " + EDGES.split(", ", 1)[1])
    units = spark.createDataFrame(
        [("KEN", "u1", "Alpha", None), ("KEN", "u2", "Beta", "X")], "country_iso string, admin2_id string, admin2_name string, admin2_iso string"
    )
    points = spark.createDataFrame(
        [("a", "KEN", 0.5, 0.5), ("b", "KEN", 1.5, 0.5), ("c", "KEN", 7.0, 0.5), ("d", "TZA", 0.5, 0.5)],
        "cell_id string, country_iso string, x double, y double",
    )
    out, report = areas.attach_units(points, units, edges)
    assert [r["admin2_name"] for r in rows(out, "cell_id")] == ["Alpha", "Beta", "Beta", "unassigned"]
    ken, tza = rows(report, "country_iso")
    assert (ken["matched_within_count"], ken["matched_nearest_count"], tza["unmatched_count"]) == (2, 1, 1)


def test_points_in_random_polygons(spark):
    rng = random.Random(4)
    shape = [(rng.uniform(5, 10) * math.cos(t / 12 * math.tau), rng.uniform(5, 10) * math.sin(t / 12 * math.tau)) for t in range(12)]
    points = [(i, "p", rng.uniform(-11, 11), rng.uniform(-11, 11)) for i in range(400)]

    def held(x, y):
        odd = False
        for (a, b), (c, d) in zip(shape, shape[1:] + shape[:1]):
            if (b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b):
                odd = not odd
        return odd

    got = areas.inside(table(spark, points), spark.createDataFrame(polygon_edges("p", shape), EDGES), "city")
    assert {r["cell_id"] for r in got.collect()} == {i for i, _, x, y in points if held(x, y)}


def ray_held(shapes, x, y):
    """Whether an odd number of outlines' edges lies to the right of a place."""
    odd = False
    for shape in shapes:
        for (a, b), (c, d) in zip(shape, shape[1:] + shape[:1]):
            if (b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b):
                odd = not odd
    return odd


def test_unit_index_equals_rays(spark):
    """Overlapping and nested units, a hole, integer corners that lie on cell
    borders, and all points of one group at one height."""
    rng = random.Random(23)
    star = [(50 + rng.uniform(8, 45) * math.cos(t / 40 * math.tau), 50 + rng.uniform(8, 45) * math.sin(t / 40 * math.tau)) for t in range(40)]
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    units = {"star": [star], "wide": [box(0, 0, 100)], "hollow": [box(10, 10, 80), box(40, 40, 16)], "small": [box(20, 20, 4)], "flat": [[(0, 30), (100, 30), (50, 30)]]}
    edges = [("g", u, k, *e[2:]) for u, shapes in units.items() for k, s in enumerate(shapes) for e in polygon_edges("g", s)]
    edges = spark.createDataFrame(edges, "city string, unit string, ring int, x1 double, y1 double, x2 double, y2 double")
    places = {(rng.uniform(-5, 105), rng.uniform(-5, 105)) for _ in range(400)} | {(float(x), float(y)) for x in range(0, 101, 5) for y in (0, 10, 24, 30, 40, 90, 100)}
    places |= {(x / 4 + 0.1, 50.0) for x in range(400)}
    points = spark.createDataFrame([("g", x, y) for x, y in places] + [("other", 1.0, 1.0)], "city string, qx double, qy double")
    got = {(r["qx"], r["qy"], r["unit"]) for r in areas.containing_units(points, edges, "city", "unit").collect()}
    assert got == {(x, y, u) for x, y in places for u, shapes in units.items() if ray_held(shapes, x, y)}
    assert not areas.containing_units(points, edges.limit(0), "city", "unit").collect()


def test_places_within_a_unit_meet_no_edges(spark):
    """A long outline on one height: places inside meet the cell, not its edges."""
    n = 400
    comb = [(float(i), 100.0 + (i % 2)) for i in range(n, -1, -1)]
    edges = polygon_edges("g", [(0.0, 0.0), (float(n), 0.0), *comb])
    edges = spark.createDataFrame(edges, EDGES).withColumn("unit", F.lit(7))
    _, cells, banded = areas.unit_index(edges, "city", "unit")
    frame = areas._index_frame(edges, "city").first()
    assert banded.count() < 4 * (n + 3) and cells.count() < 4 * (n + 3)
    low, side = frame["__oy"], frame["__side"]
    inner = cells.where((F.col("__row") > 0) & ((F.col("__row") + 1) * side + low < 100.0) & (F.col("__col") > 0) & ((F.col("__col") + 1) * side < n))
    assert inner.count() and not inner.where("__edge").count()


def test_zonal_means_ignore_shared_edges(spark):
    cells = spark.createDataFrame(
        [("a", "A", 0.0, 0.0, 1.0, 1.0), ("b", "A", 1.0, 0.0, 2.0, 1.0), ("c", "A", 5.0, 0.0, 6.0, 1.0)],
        "cell_id string, city string, x0 double, y0 double, x1 double, y1 double",
    )
    pixels = spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0)], "row int, col int, value double")
    boxes = raster.pixel_boxes(pixels, 0.0, 1.0, 1.0, 1.0)
    out = rows(raster.zonal_stats(cells, boxes, ["mean", "median"]), "cell_id")
    assert [r["external_signal_mean"] for r in out] == [10.0, 20.0, None]
    assert [r["external_signal_available"] for r in out] == [True, True, False]
    with pytest.raises(ValueError):
        raster.zonal_stats(cells, boxes, ["nonsense"])


def test_zonal_pixels_are_clipped_to_the_boundary(spark):
    triangle = [(0, 0), (10, 0), (0, 10)]
    edges = spark.createDataFrame(polygon_edges("t", triangle), EDGES)
    cells = areas.grid(edges, 5.0)
    pixels = spark.createDataFrame([(r, c, 1.0) for r in range(10) for c in range(10)], "row int, col int, value double")
    pixels = raster.pixel_boxes(pixels.withColumn("city", F.lit("t")), 0.0, 10.0, 1.0, 1.0)
    got = {(r["x0"], r["y0"]): r["population"] for r in raster.population_sum(
        cells, pixels, ["city"], bucket=5.0, edges=edges).collect()}
    # Pixels on the diagonal are touched, those beyond it are not.
    assert got == {(0.0, 0.0): 25.0, (5.0, 0.0): 15.0, (0.0, 5.0): 15.0}


def test_patches(spark):
    cells = table(spark, [(1, "A", 10.0, 10.0), (2, "A", 5000.0, 0.0)])
    points = spark.createDataFrame(
        [("A", "schools", 8.5, 11.5), ("A", "schools", 8.5, 11.5), ("A", "nothing", 8.5, 8.5)], "city string, channel string, x double, y double"
    )
    pixels = spark.createDataFrame(
        [("A", "cover", 11.0, 11.0, 50.0), ("A", "population", 9.0, 9.0, 3.0)], "city string, channel string, x double, y double, value double"
    )
    roads = spark.createDataFrame([("A", 8.2, 8.5, 11.8, 8.5)], "city string, x1 double, y1 double, x2 double, y2 double")
    out = rows(raster.patch_features(cells, pixels, points, roads, patch_size=2, context=4.0, pixel_size=2.0), "cell_id")
    patch = out[0]["patch"]
    assert len(patch) == 32 and out[1]["patch"] == [0.0] * 32
    channel = lambda i: patch[4 * i:4 * i + 4]
    assert math.isclose(channel(5)[0], math.log(3), rel_tol=1e-6)  # two copies, upper left
    assert channel(1) == [0.0, 1.0, 0.0, 0.0] and math.isclose(channel(0)[2], math.log(4), rel_tol=1e-6)
    assert channel(3) == [0.0, 0.0, 1.0, 1.0]


def test_moran_finds_clusters(spark):
    data = [(i, "A", float(i % 10), float(i // 10), 100.0 if i % 10 < 5 else 0.0) for i in range(100)]
    df = spark.createDataFrame(data, "cell_id int, city string, x double, y double, score double")
    overall, local = moran.moran(df, "score", k=4, permutations=None)
    assert rows(overall)[0]["moran_i"] > 0.7 and rows(overall)[0]["moran_p"] < 1e-6
    labels = {r["cell_id"]: r["local_moran_cluster"] for r in local.collect()}
    assert labels[50] == "high_high" and labels[59] == "low_low"
    with pytest.raises(ValueError):
        moran.moran(df.limit(2), "score")


def test_global_moran_of_a_large_group(spark):
    n = 200_000
    df = spark.createDataFrame([(n, 0.001, float(n), 4.1 * n)], "n bigint, i double, s1 double, s2 double")
    p = df.select(moran._global_p(*[F.col(c) for c in ("i", "n", "s1", "s2")]).alias("p")).first()["p"]
    spread = (n * n * n - n * 4.1 * n + 3 * n * n) / ((n - 1) * (n + 1) * n * n) - 1 / (n - 1) ** 2
    assert math.isclose(p, 0.5 * math.erfc((0.001 + 1 / (n - 1)) / math.sqrt(2 * spread)), rel_tol=1e-5)


def test_interior_points_of_concave_cells(spark):
    """Stars, combs and a ring with a hole: every point lies in its cell and inside."""
    import random

    pick = random.Random(8)
    rings = []
    for c in range(6):
        n = 40
        reach = [pick.uniform(150, 900) for _ in range(n)]
        turned = [(900 + r * math.cos(2 * math.pi * i / n), 900 + r * math.sin(2 * math.pi * i / n)) for i, r in enumerate(reach)]
        rings.append((f"star{c}", 0, turned if c % 2 else turned[::-1]))
    comb = [(0.0, 0.0)] + [p for i in range(12) for p in ((130.0 * i, 950.0), (130.0 * i + 10, 950.0), (130.0 * i + 20, 30.0), (130.0 * i + 120, 30.0))] + [(1600.0, 0.0)]
    rings += [("comb", 0, comb), ("hole", 0, [(0.0, 0.0), (1250.0, 0.0), (1250.0, 1250.0), (0.0, 1250.0)]), ("hole", 1, [(20.0, 20.0), (20.0, 1230.0), (1230.0, 1230.0), (1230.0, 20.0)])]
    rings.append(("flat", 0, [(0.0, 0.0), (1000.0, 0.0), (1000.0, 620.0), (0.0, 620.0)]))
    data = [(g, r, *p, *q) for g, r, ring in rings for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
    edges = spark.createDataFrame(data, "city string, ring int, x1 double, y1 double, x2 double, y2 double")
    out = areas.interior_points(edges, areas.grid(edges)).collect()
    assert len(out) > 70
    outside = 0
    for r in out:
        def odd(x, y):
            return sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for g, _, x1, y1, x2, y2 in data if g == r["city"]) % 2  # noqa: B023
        assert r["x0"] < r["inner_x"] < r["x1"] and r["y0"] < r["inner_y"] < r["y1"] and odd(r["inner_x"], r["inner_y"]), r
        outside += not odd(r["x"], r["y"])
    assert outside > 3  # centroids do lie outside


def test_neighbour_draws_are_without_replacement(spark):
    sizes = spark.createDataFrame([("a", 9, 8), ("b", 200, 4), ("c", 3, 2)], "g string, n long, k long")
    sets, places = {}, {}
    for r in moran.neighbour_draws(sizes, ["g"], "n", "k", 400, 1).collect():
        sets.setdefault((r["g"], r["r"]), []).append(r["place"])
        places.setdefault(r["g"], []).append(r["place"])
    assert len(sets) == 3 * 400 and all(len(set(s)) == len(s) for s in sets.values())
    assert {g: len(s) for (g, _), s in sets.items()} == {"a": 8, "b": 4, "c": 2}
    assert {g: (min(p), max(p)) for g, p in places.items()} == {"a": (0, 7), "b": (0, 198), "c": (0, 1)}
    counts = [places["b"].count(p) for p in range(199)]
    assert max(counts) < 3 * sum(counts) / 199  # no place is favoured


@pytest.mark.parametrize("by", [None, "city"])
def test_permutation_p_equals_counting_all_sets(spark, by, monkeypatch):
    """Against loops over the same sets; rows of several blocks and two groups."""
    import random

    monkeypatch.setattr(moran, "_BLOCK", 7)
    pick = random.Random(4)
    data = [(i, "AB"[i % 3 == 0], pick.random(), pick.random(), pick.choice([None, 1.0, 5.0, pick.random()])) for i in range(50)]
    df = spark.createDataFrame(data, "cell_id int, city string, x double, y double, score double")
    _, local = moran.moran(df, "score", k=3, by=by, permutations=60, seed=9)
    _, normal = moran.moran(df, "score", k=3, by=by, permutations=None)
    got, plain = ({r["cell_id"]: r for r in t.collect()} for t in (local, normal))
    groups = {}
    for i, city, x, y, score in data:
        groups.setdefault(city if by else "all", []).append((i, x, y, score))
    sizes = spark.createDataFrame([(g, len(rows), 3) for g, rows in groups.items()], "g string, n long, k long")
    sets = {}
    for r in moran.neighbour_draws(sizes, ["g"], "n", "k", 60, 9).collect():
        sets.setdefault((r["g"], r["r"]), []).append(r["place"])
    for g, members in groups.items():
        known = sorted(s for *_, s in members if s is not None)
        median = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
        y = [median if s is None else s for *_, s in members]
        z = [v - sum(y) / len(y) for v in y]
        for i, (cell, cx, cy, _) in enumerate(members):
            near = sorted(((x - cx) ** 2 + (yy - cy) ** 2, c, z[j]) for j, (c, x, yy, _) in enumerate(members) if j != i)[:3]
            lag = sum(v for *_, v in near) / 3
            others = z[:i] + z[i + 1 :]
            larger = sum(z[i] * (sum(others[p] for p in s) / 3) >= z[i] * lag - 1e-12 for (h, _), s in sets.items() if h == g)
            assert got[cell]["local_moran_p"] == (min(larger, 60 - larger) + 1) / 61, cell
            assert math.isclose(got[cell]["local_moran_i"], plain[cell]["local_moran_i"], rel_tol=1e-9)


def test_utm_matches_known_point(spark):
    # A survey mark at 9 E on the central meridian of zone 32.
    df = spark.createDataFrame([("a", 9.0, 0.0), ("a", 9.0, 48.0)], "g string, lon double, lat double")
    out = rows(areas.project(df, "g"), "lat")
    assert math.isclose(out[0]["x"], 500000.0, abs_tol=1e-6) and math.isclose(out[0]["y"], 0.0, abs_tol=1e-6)
    assert math.isclose(out[1]["y"], 0.9996 * 5318363.0, rel_tol=1e-4)
    back = rows(areas.unproject(areas.project(df, "g").drop("lon", "lat")), "lat")
    assert math.isclose(back[1]["lat"], 48.0, abs_tol=1e-9)


def test_tiles(spark):
    df = spark.range(1).select(geo.tiles_for_bounds(F.lit(38.9), F.lit(-7.1), F.lit(39.5), F.lit(-6.6)).alias("t"))
    assert df.first()["t"] == ["S09E036", "S09E039"]
    given = spark.range(1).select(geo.resolve_tiles(
        F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.lit("c"), F.array(F.lit("d"))).alias("t"))
    assert given.first()["t"] == ["a", "b"]


def test_lines_that_meet_in_one_point_end(spark):
    """Ten thousand segments from one junction: no bucket side parts them."""
    pick = random.Random(4)
    hub = [("A", 10.0, 20.0, 10.0 + 900 * math.cos(0.7 * i), 20.0 + 900 * math.sin(0.7 * i)) for i in range(10_000)]
    hub.append(("A", 0.0, 0.0, 90_000.0, 45_000.0))  # and one road a hundred times as long
    spots = [(i, "A", pick.uniform(-2000, 3000), pick.uniform(-2000, 3000)) for i in range(20)]
    cells = spark.createDataFrame(spots, "cell_id int, city string, x double, y double")
    lines = spark.createDataFrame(hub, "city string, x1 double, y1 double, x2 double, y2 double")
    got = {r["cell_id"]: r["d"] for r in near.nearest_distance(cells, lines, "d").collect()}

    def distance(x, y, line):
        _, a, b, c, d = line
        t = max(0.0, min(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
        return math.hypot(a + t * (c - a) - x, b + t * (d - b) - y)

    for i, _, x, y in spots:
        assert abs(got[i] - min(distance(x, y, line) for line in hub)) < 1e-6


def test_parts_of_either_turn_add_up(spark):
    def square(part, x, turned):
        corners = [(x, 0.0), (x + 1000, 0.0), (x + 1000, 1000.0), (x, 1000.0)]
        corners = corners[::-1] if turned else corners
        return [("A", part, 0, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]

    edges = spark.createDataFrame(square(0, 0.0, False) + square(1, 3000.0, True), "city string, part int, ring int, x1 double, y1 double, x2 double, y2 double")
    cells = areas.grid(edges).collect()
    assert len(cells) == 8 and sum(r["area_m2"] for r in cells) == 2_000_000.0
    middle = areas.centroids(edges, ["city"]).first()
    assert (middle["area"], middle["x"], middle["y"]) == (2_000_000.0, 2000.0, 500.0)


def test_population_of_a_patch_is_bilinear_over_pixels_that_exist(spark):
    random = __import__("random").Random(5)
    values = {(i, j): float(random.randint(0, 50)) for i in range(-2, 8) for j in range(-2, 8) if random.random() < 0.8}
    pixels = spark.createDataFrame(
        [("A", "population", i * 30.0 + 15.0, j * 30.0 + 15.0, v) for (i, j), v in values.items()]
        + [("A", "population", 15.0, 15.0, None), ("A", "cover", 5.0, 5.0, 50.0)],
        "city string, channel string, x double, y double, value double",
    )
    points = spark.createDataFrame([], "city string, channel string, x double, y double")
    cells = table(spark, [(1, "A", 77.0, 91.0), (2, "A", 3.0, -4.0), (3, "A", 9000.0, 0.0)])
    out = rows(raster.patch_features(cells, pixels, points, patch_size=8, context=100.0, pixel_size=30.0, cover_size=10.0), "cell_id")
    for row, (x, y) in zip(out, [(77.0, 91.0), (3.0, -4.0), (9000.0, 0.0)], strict=True):
        for r in range(8):
            for c in range(8):
                px, py = x - 50 + (c + 0.5) * 12.5, y + 50 - (r + 0.5) * 12.5
                u, v = px / 30 - 0.5, py / 30 - 0.5
                corners = [
                    ((1 - abs(u - i)) * (1 - abs(v - j)), values[i, j])
                    for i in (math.floor(u), math.floor(u) + 1) for j in (math.floor(v), math.floor(v) + 1) if (i, j) in values
                ]
                weight = sum(w for w, _ in corners)
                want = math.log1p(sum(w * z for w, z in corners) / weight) if weight else 0.0
                assert math.isclose(row["patch"][8 * r + c], want, rel_tol=1e-5, abs_tol=1e-6)
                assert row["patch"][64 + 8 * r + c] == float(0 <= px < 10 and 0 <= py < 10)


def test_patches_of_crowded_windows_and_blocks(spark, monkeypatch):
    """Points counted by corners, features cut into blocks and cells of equal id give what a look at each row gives."""
    random = __import__("random").Random(3)
    marks = [(random.choice(["schools", "clinics"]), float(random.randint(0, 60)), float(random.randint(0, 60))) for _ in range(4000)]
    lines = [(*(random.uniform(0, 60) for _ in range(2)), random.uniform(-20, 80), random.uniform(0, 60)) for _ in range(3)]
    points = spark.createDataFrame([("A", *m) for m in marks], "city string, channel string, x double, y double")
    roads = spark.createDataFrame([("A", *m) for m in lines], "city string, x1 double, y1 double, x2 double, y2 double")
    pixels = spark.createDataFrame([("A", "cover", 25.0, 25.0, 50.0)], "city string, channel string, x double, y double, value double")
    spots = [(7, "A", 30.0, 30.0), (7, "A", 20.0, 33.0), (8, "A", 61.0, 5.0), (9, "B", 30.0, 30.0), (10, None, 30.0, 30.0), (11, "A", None, 1.0)]
    cells = spark.createDataFrame(spots, "cell_id int, city string, x double, y double")

    def patch(city, x, y):
        out = [0.0] * 32
        if city != "A" or x is None:
            return out
        for channel, px, py in marks:
            c, r = math.floor((px - x + 10) / 10), 1 - math.floor((py - y + 10) / 10)
            if c in (0, 1) and r in (0, 1):
                out[raster.CHANNELS.index(channel) * 4 + 2 * r + c] += 1
        out = [math.log1p(v) for v in out]
        for c in (0, 1):
            for r in (0, 1):
                u, v = x - 10 + (c + 0.5) * 10, y + 10 - (r + 0.5) * 10
                out[4 + 2 * r + c] = float(20 <= u < 30 and 20 <= v < 30)
                box = x - 10 + c * 10, y - 10 + (1 - r) * 10
                for x1, y1, x2, y2 in lines:
                    steps = [(x1 + t / 20000 * (x2 - x1), y1 + t / 20000 * (y2 - y1)) for t in range(20001)]
                    if any(box[0] < a < box[0] + 10 and box[1] < b < box[1] + 10 for a, b in steps):
                        out[12 + 2 * r + c] = 1.0
        return out

    want = sorted((i, str(c), str(x), patch(c, x, y)) for i, c, x, y in spots)
    for features, shares in ((1_000_000, 2_048), (300, 1)):
        monkeypatch.setattr(raster, "_FEATURES", features)
        monkeypatch.setattr(raster, "_CELLS", shares)
        out = raster.patch_features(cells, pixels, points, roads, patch_size=2, context=20.0, pixel_size=10.0).collect()
        got = sorted((r["cell_id"], str(r["city"]), str(r["x"]), list(r["patch"])) for r in out)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        for g, w in zip(got, want, strict=True):
            assert all(math.isclose(a, b, rel_tol=1e-5) for a, b in zip(g[3], w[3], strict=True)), (g, w)


def test_lines_of_a_patch_are_looked_at_where_they_are_in_doubt(monkeypatch):
    """Dense, sparse, short, level and far lines mark what each line alone marks, and
    of many lines few are held against a pixel."""
    np, looked, held = __import__("numpy"), [], raster._Lines._held
    monkeypatch.setattr(raster._Lines, "_held", lambda self, line, *at: looked.append(len(line)) or held(self, line, *at))
    rng = np.random.default_rng(8)

    def around(n, spread):
        start = np.where(rng.random((2, n)) < 0.5, rng.integers(-40, 340, (2, n)), rng.uniform(-40, 340, (2, n)))
        return np.concatenate([start, start + np.where(rng.random((2, n)) < 0.2, 0.0, rng.integers(-spread, spread + 1, (2, n)))])

    far = np.array([[-1e5, 80.0, 3e5, 200.0], [30.0, -9e4, 31.0, 9e4], [40.0, 40.0, 40.0, 40.0], [50.0, 50.0, 50.004, 50.0]]).T
    for many, spread, most in ((150, 20, 4_000), (150, 2, 4_000), (40_000, 20, 40_000)):
        lines = np.concatenate([around(many, spread), far], axis=1)
        del looked[:]
        scene = raster._Lines(lines, (-50.0, -50.0), 150 / 16, 16)
        x, y = (np.array([0.0, 17.0, 93.75, 149.0]) - 50 + v for v in (0.0, 0.5))
        got = scene.passed(x, y)
        assert sum(looked) < most
        every = np.arange(lines.shape[1])
        for k in range(4):
            for i, j in [(0, 0), (15, 15), *rng.integers(0, 16, (60, 2)).tolist()]:
                want = held(scene, every, *(np.full(len(every), v) for v in (x[k], y[k], i, j)))
                assert got[k, i, j] == want.any(), (many, k, i, j)


def test_summaries_take_the_place_of_patches(spark, monkeypatch):
    """Digests made where the patches are, in one block or several, are those of the patches."""
    random, sha256 = __import__("random").Random(6), __import__("hashlib").sha256
    spots = [(i, "A", random.uniform(0, 60), random.uniform(0, 60)) for i in range(12)] + [(90, "B", 1.0, 1.0), (91, None, 1.0, 1.0), (92, "A", None, 1.0)]
    cells = spark.createDataFrame(spots, "cell_id int, city string, x double, y double")
    points = [("A", random.choice(["schools", "clinics"]), float(random.randint(0, 60)), float(random.randint(0, 60))) for _ in range(900)]
    points = spark.createDataFrame(points, "city string, channel string, x double, y double")
    roads = spark.createDataFrame([("A", *(random.uniform(0, 60) for _ in range(4))) for _ in range(5)], "city string, x1 double, y1 double, x2 double, y2 double")
    pixels = [("A", c, i * 10.0 + 5, j * 10.0 + 5, v) for i in range(6) for j in range(6) for c, v in (("cover", random.choice([10.0, 50.0, 80.0])), ("population", random.choice([0.0, 3.0, 1e6])))]
    pixels = spark.createDataFrame(pixels, "city string, channel string, x double, y double, value double")
    for features, corners in ((1_000_000, 10_000_000), (1_000_000, 0), (100, 10_000_000)):
        monkeypatch.setattr(raster, "_FEATURES", features)
        monkeypatch.setattr(raster, "_CORNERS", corners)
        make = lambda **how: raster.patch_features(cells, pixels, points, roads, patch_size=4, context=20.0, pixel_size=10.0, **how)
        made = make(summary=(raster.SLOT_DIGESTS, raster.slot_digests()))
        assert made.columns == [*cells.columns, "n_filled", "slots_sha256"]
        got = {r["cell_id"]: (list(r["n_filled"]), list(r["slots_sha256"])) for r in made.collect()}
        for row in make().collect():
            parts = [row["patch"][16 * c:16 * c + 16] for c in range(8)]
            texts = [",".join(f"{i}:{math.floor(v * 1000 + 0.5)}" for i, v in enumerate(p) if v) for p in parts]
            assert got[row["cell_id"]] == ([sum(v != 0 for v in p) for p in parts], [sha256(t.encode()).hexdigest() for t in texts])
        assert len(got) == len(spots)


def test_sums_of_touched_pixels_make_no_pairs(spark, monkeypatch):
    """Sums made in tasks, in one block or several, are those over all pairs: at slanted
    and level outlines, holes, shared corners, copies and pixels of several sizes."""
    random, fraction = __import__("random").Random(12), __import__("fractions").Fraction
    shapes = {
        "p": [[(0, 0), (900, 100), (700, 800), (100, 600)], [(200, 200), (200, 400), (400, 300)]], "q": [[(50, 700), (650, 750), (300, -100)]],
        "r": [[(0, 0), (500, 0), (500, 620), (0, 620)]],
    }
    lines = [(city, ring, *map(float, (*a, *b))) for city, rings in shapes.items() for ring, corners in enumerate(rings) for a, b in zip(corners, corners[1:] + corners[:1])]
    edges = spark.createDataFrame(lines, "city string, ring int, x1 double, y1 double, x2 double, y2 double")
    spots = [(float(random.randrange(-100, 1000, 25)), float(random.randrange(-100, 1000, 25)), 25.0) for _ in range(500)]
    spots += [(random.uniform(-50, 900), random.uniform(-50, 800), random.choice([4.0, 40.0, 300.0])) for _ in range(200)] + spots[:9]
    layers = [(random.choice([0, 1]), x, y, x + w, y + w, random.choice([None, 3.0, 50.0, 60.0])) for x, y, w in spots]
    pixels = spark.createDataFrame([*layers, (0, None, 0.0, 1.0, 1.0, 50.0)], "zone int, px0 double, py0 double, px1 double, py1 double, value double")
    zones = {"p": 0, "q": 1, "r": 0}
    cells = areas.grid(edges, 250.0).join(spark.createDataFrame(list(zones.items()), "city string, zone int"), "city")

    def meets(box, outline):
        """In whole fractions: an edge passes through the open box, or its centre is inside."""
        x0, y0, x1, y1 = map(fraction, box)
        x, y, odd = (x0 + x1) / 2, (y0 + y1) / 2, False
        for xa, ya, xb, yb in outline:
            spans = []
            for a, b, low, high in ((xa, xb, x0, x1), (ya, yb, y0, y1)):
                spans.append(sorted([(low - a) / (b - a), (high - a) / (b - a)]) if a != b else ([0, 1] if low < a < high else [1, 0]))
            if max(0, *(s[0] for s in spans)) < min(1, *(s[1] for s in spans)):
                return True
            odd ^= (ya > y) != (yb > y) and x < xa + (y - ya) * (xb - xa) / (yb - ya)
        return odd

    want, plain = [], 0
    for c in rows(cells, "city", "cell_id"):
        outline = [tuple(map(fraction, line[2:])) for line in lines if line[0] == c["city"]]
        met = [p for p in layers if p[1] < c["x1"] and p[3] > c["x0"] and p[2] < c["y1"] and p[4] > c["y0"]]
        plain += len(met)
        held = [v for z, a, b, d, e, v in met if z == zones[c["city"]] and meets((max(a, c["x0"]), max(b, c["y0"]), min(d, c["x1"]), min(e, c["y1"])), outline)]
        if held:
            want.append({"city": c["city"], "cell_id": c["cell_id"], "__n": len(held), "s": sum(v or 0.0 for v in held), "b": float(held.count(50.0))})
    sums = {"s": F.col("value"), "b": (F.col("value") == 50).cast("int")}
    for held in (1_000_000, 40):
        monkeypatch.setattr(raster, "_HELD", held)
        monkeypatch.setattr(raster, "_COMPARED", 4 * held)
        out = raster.touched_sums(cells, pixels, sums, ["city"], bucket=250.0, edges=edges, layer="zone")
        assert rows(out, "city", "cell_id") == want and len(want) > 20
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
        assert sum(r["__n"] for r in raster.touched_sums(cells, pixels.drop("zone"), {}).collect()) == plain

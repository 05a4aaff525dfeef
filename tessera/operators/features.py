"""Per-cell features of all cities of a study in one job."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import (
    clinic_points, intersection_nodes, population_per_service, school_points, service_points,
)
from tessera.functions.geo import resolve_tiles, tiles_for_bounds
from tessera.operators.areas import contains_count, grid
from tessera.operators.near import count_within, nearest_distance
from tessera.operators.raster import class_shares, population_sum
from tessera.runtime import keep, lookup


def combine_points(*layers: DataFrame) -> DataFrame:
    """Union of point layers by column name."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def build_features(
    boundary: DataFrame,
    roads: DataFrame,
    nodes: DataFrame,
    amenities: DataFrame,
    population: DataFrame,
    cover: DataFrame,
    cell_size: float = 500.0,
    radius: float = 1000.0,
    by: str = "city",
    zones: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Grid cells with ten features, and the number of cells per city.

    ``boundary`` and ``roads`` are segments, ``nodes`` and ``amenities`` points,
    ``population`` and ``cover`` pixel boxes, all in metres and keyed by city.
    Where cities share their layers, ``zones`` names the zone of each city (``by,
    zone``) and all but the boundary are keyed by ``zone``: no layer is copied.
    """
    layer = "zone" if zones is not None else by
    shared = layer if zones is not None else None
    amenities = keep(amenities)
    schools, clinics = school_points(amenities), clinic_points(amenities)
    cells = grid(boundary, cell_size, by)
    cells = keep(cells if zones is None else cells.join(lookup(zones.select(by, layer)), by))
    steps = (
        lambda: nearest_distance(cells, roads, "road_distance_m", [layer]),
        lambda: nearest_distance(cells, schools, "school_distance_m", [layer]),
        lambda: nearest_distance(cells, clinics, "clinic_distance_m", [layer]),
        lambda: count_within(cells, service_points(amenities), radius, "amenity_count_1km", [layer]),
        lambda: count_within(cells, combine_points(schools, clinics), radius, "service_count_1km", [layer]),
        lambda: contains_count(cells, intersection_nodes(nodes), cell_size, "__nodes", by, edges=boundary, layer=shared)
        .withColumnRenamed("__nodes_per_km2", "intersection_density_km2").drop("__nodes"),
        lambda: population_sum(cells, population, [by], bucket=cell_size, edges=boundary, layer=shared),
        lambda: class_shares(cells, cover, [by], bucket=cell_size, edges=boundary, layer=shared),
    )
    place = [by, "ix", "iy"]

    def made(step: Callable[[], DataFrame]) -> DataFrame:
        out = step()
        return keep(out.select(*place, *[c for c in out.columns if c not in cells.columns]))

    # The steps need only the cells, and each is a chain of short jobs, so they run side by side.
    with ThreadPoolExecutor(len(steps)) as pool:
        out = reduce(lambda a, b: a.join(b, place), pool.map(made, steps), cells)
    out = out.withColumns({
        "population_per_service": population_per_service("population", "service_count_1km"),
        "grid_cell_size_m": F.lit(int(cell_size)),
    })
    counts = cells.groupBy(by).agg(F.count(F.lit(1)).alias("grid_rows"))
    return out.drop(*["zone"] * (zones is not None)), counts


def city_tiles(
    cities: DataFrame, bounds: DataFrame, by: str = "city", many: str = "worldcover_tiles", one: str = "worldcover_tile"
) -> DataFrame:
    """Land-cover tiles per city: the configured ones, or those its bounding box
    ``minx, miny, maxx, maxy`` in degrees touches."""

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in cities.columns else F.lit(None).cast(kind)

    inferred = tiles_for_bounds(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])
    return cities.join(bounds, by, "left").select(
        by, F.explode(resolve_tiles(column(many, "array<string>"), column(one, "string"), inferred)).alias("tile")
    )

"""Polygons as edge tables: membership, nearest unit, grid cells, centroids.

An edge table has ``group, unit, ring, x1, y1, x2, y2`` and, where a unit has
several parts, ``part``. In each part ring 0 is the outline and rings above 0 are
holes, in either turn; the parts of a unit do not overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import slug
from tessera.functions.geo import from_utm, segment_distance2, to_utm, utm_zone
from tessera.operators.near import _locations, _search, cut_lines, placed
from tessera.operators.order import number_rows
from tessera.runtime import attach, keep, lookup, require, require_columns


def edges_from_rings(rings: DataFrame, keys: Sequence[str], points: str = "points") -> DataFrame:
    """Edge table from rows that hold a closed ring as ``array<struct<x,y>>``."""
    pairs = F.arrays_zip(
        F.slice(points, 1, F.size(points) - 1).alias("a"), F.slice(points, 2, F.size(points) - 1).alias("b")
    )
    return rings.select(*keys, F.posexplode(pairs).alias("seq", "p")).select(
        *keys, "seq", F.col("p.a.x").alias("x1"), F.col("p.a.y").alias("y1"),
        F.col("p.b.x").alias("x2"), F.col("p.b.y").alias("y2"),
    )


def _index_frame(edges: DataFrame, group: str) -> DataFrame:
    """Per group: origin and side of square index cells. There are about as many
    cells as edges, and an edge covers two of them on average."""
    low = [F.least("x1", "x2"), F.least("y1", "y2")]
    high = [F.greatest("x1", "x2"), F.greatest("y1", "y2")]
    wide, tall = high[0] - low[0], high[1] - low[1]
    extent = F.greatest(F.max(high[0]) - F.min(low[0]), F.max(high[1]) - F.min(low[1]))
    side = F.greatest(extent / F.sqrt(F.count(F.lit(1))), F.avg(F.greatest(wide, tall)), extent * 1e-6)
    return edges.groupBy(group).agg(
        F.min(low[0]).alias("__ox"), F.min(low[1]).alias("__oy"), F.when(side > 0, side).otherwise(1.0).alias("__side")
    )


def _place(value: Column, origin: str) -> Column:
    return F.floor((value - F.col(origin)) / F.col("__side"))


def unit_index(edges: DataFrame, group: str, unit: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A two-level index of units: the frame of each group, its cells (``group,
    unit, __row, __col, __edge``, true where the outline may pass), and the
    edges by the rows they reach. A cell without an edge is wholly inside or
    outside its unit; those outside are not in the table. Inside cells are at
    most the grid's cells for each layer of overlapping units.
    """
    frame = lookup(_index_frame(edges, group))
    x1, y1, x2, y2, side = (F.col(c) for c in ("x1", "y1", "x2", "y2", "__side"))
    rows = F.sequence(_place(F.least(y1, y2), "__oy"), _place(F.greatest(y1, y2), "__oy"))
    banded = keep(
        edges.select(group, unit, "x1", "y1", "x2", "y2").join(frame, group).withColumn("__row", F.explode(rows))
    )
    # The part of an edge within its row, a little widened, covers these cells.
    floor = F.col("__oy") + F.col("__row") * side

    def at(y: Column) -> Column:
        return F.when(y1 == y2, x1).otherwise(x1 + (y - y1) * (x2 - x1) / (y2 - y1))

    def cut(y: Column) -> Column:
        return at(F.least(F.greatest(y, F.least(y1, y2)), F.greatest(y1, y2)))

    ends = [F.when(y1 == y2, e).otherwise(cut(y)) for e, y in ((x1, floor), (x2, floor + side))]
    slack = side * 1e-6
    columns = F.sequence(_place(F.least(*ends) - slack, "__ox"), _place(F.greatest(*ends) + slack, "__ox"))
    key = [group, unit, "__row"]
    outline = keep(banded.select(*key, F.explode(columns).alias("__col")).distinct())
    # Along the middle of a row the unit lies between odd and even crossings,
    # which are first summed by cell, so a window holds one row of the grid.
    middle = floor + side / 2.0
    flips = banded.where((y1 > middle) != (y2 > middle)).groupBy(*key, _place(at(middle), "__ox").alias("__col")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    along = Window.partitionBy(*key).orderBy("__col")
    spans = flips.select(
        *key, F.col("__col").alias("__from"), F.lead("__col").over(along).alias("__to"), F.sum("__n").over(along).alias("__n")
    ).where("__n % 2 = 1 AND __to - __from > 1")
    held = spans.select(*key, F.explode(F.sequence(F.col("__from") + 1, F.col("__to") - 1)).alias("__col"))
    held = held.join(outline, [*key, "__col"], "left_anti")
    cells = outline.withColumn("__edge", F.lit(True)).unionByName(held.withColumn("__edge", F.lit(False)))
    return frame, lookup(cells), banded.drop("__ox", "__oy", "__side")


def containing_units(points: DataFrame, edges: DataFrame, group: str, unit: str) -> DataFrame:
    """Units around each location: ``group, qx, qy, unit``.

    A location in a cell wholly inside a unit is answered by the cell. In a cell
    that an outline passes, a ray to the right crosses the outline of a
    containing unit an odd number of times; it meets only edges at its own
    height, and only of the units that pass the cell.
    """
    frame, cells, banded = unit_index(edges, group, unit)
    own = points.select(group, "qx", "qy").join(frame, group).select(
        group, "qx", "qy", _place(F.col("qy"), "__oy").alias("__row"), _place(F.col("qx"), "__ox").alias("__col")
    )
    met = own.join(cells, [group, "__row", "__col"])
    px, py = F.col("qx"), F.col("qy")
    spans = (F.col("y1") > py) != (F.col("y2") > py)
    at = F.col("x1") + (py - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    near = met.where("__edge").join(banded, [group, unit, "__row"]).where(spans).where(px < at)
    odd = near.groupBy(group, "qx", "qy", unit).agg((F.count(F.lit(1)) % 2).alias("__odd")).where("__odd = 1")
    return met.where(~F.col("__edge")).select(group, "qx", "qy", unit).unionByName(odd.drop("__odd"))


def inside(points: DataFrame, edges: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """Points inside any polygon of their group."""
    unit = edges if "unit" in edges.columns else edges.withColumn("unit", F.lit(0))
    hits = containing_units(_locations(points, [group], x, y), unit, group, "unit")
    keyed = points.withColumns({"qx": F.col(x).cast("double"), "qy": F.col(y).cast("double")})
    return keyed.join(hits.select(group, "qx", "qy"), [group, "qx", "qy"], "left_semi").drop("qx", "qy")


def unmatched(points: DataFrame, matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.join(matched, list(keys), "left_anti")


def nearest_units(points: DataFrame, edges: DataFrame, group: str, unit: str) -> DataFrame:
    """Closest unit of each location: ``group, qx, qy, unit``."""
    ends = edges.select(
        group, F.col("x1").alias("__x1"), F.col("y1").alias("__y1"), F.col("x2").alias("__x2"), F.col("y2").alias("__y2"), F.col(unit).alias("cid"),
    ).distinct()
    lines = cut_lines(ends, [group])
    d2 = segment_distance2(*[F.col(c) for c in ("qx", "qy", "__x1", "__y1", "__x2", "__y2")])
    return _search(points, lines, [group], 1, d2).select(group, "qx", "qy", F.col("cid").alias(unit))


def attach_units(
    points: DataFrame,
    units: DataFrame,
    edges: DataFrame,
    country: str = "country_iso",
    prefix: str = "admin2",
    x: str = "x",
    y: str = "y",
) -> tuple[DataFrame, DataFrame]:
    """Label points with the unit that holds them, else with the nearest one of
    their country. Returns the points and match counts per country."""
    unit, name, iso = f"{prefix}_id", f"{prefix}_name", f"{prefix}_iso"
    require_columns(points, [country, x, y], "points")
    require_columns(units, [country, unit, name, iso], "units")
    require_columns(edges, [country, unit, "x1", "y1", "x2", "y2"], "edges")
    places = keep(_locations(points, [country], x, y))
    within = containing_units(places, edges, country, unit).groupBy(country, "qx", "qy").agg(
        F.min(unit).alias(unit)
    )
    within = keep(within.withColumn("__how", F.lit("within")))
    rest = keep(unmatched(places, within, [country, "qx", "qy"]))
    if rest.isEmpty():
        matched = within
    else:
        near = nearest_units(rest, edges, country, unit).withColumn("__how", F.lit("nearest"))
        matched = keep(within.unionByName(near))
    keyed = points.withColumns({"qx": F.col(x).cast("double"), "qy": F.col(y).cast("double")})
    labelled = keyed.join(matched, [country, "qx", "qy"], "left").drop("qx", "qy")
    report = labelled.groupBy(country).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("__how") == "within").alias("matched_within_count"),
        F.count_if(F.col("__how") == "nearest").alias("matched_nearest_count"),
        F.count_if(F.col("__how").isNull()).alias("unmatched_count"),
    )
    names = lookup(units.select(country, unit, name, iso))
    out = labelled.drop("__how").join(names, [country, unit], "left").withColumns({
        name: F.coalesce(name, F.lit("unassigned")), unit: F.coalesce(F.col(unit).cast("string"), F.lit("unassigned")),
    })
    return out.select(*points.columns, name, unit, iso), report


def _cuts(a: Column, b: Column, size: Column) -> Column:
    """Positions along a segment, as fractions, where it meets a grid line."""
    low, high = F.least(a, b), F.greatest(a, b)
    first, last = F.floor(low / size) + 1, F.ceil(high / size) - 1
    lines = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(lines, lambda k: (k * size - a) / (b - a))


def split_on_grid(segments: DataFrame, size: Column) -> DataFrame:
    """Cut segments, given relative to the grid origin, at every grid line. Each
    piece lies in one cell ``ix, iy``."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    stops = F.array_sort(F.array_distinct(F.concat(
        F.array(F.lit(0.0), F.lit(1.0)), _cuts(x1, x2, size), _cuts(y1, y2, size)
    )))
    spans = F.arrays_zip(F.slice("__t", 1, F.size("__t") - 1).alias("a"), F.slice("__t", 2, F.size("__t") - 1).alias("b"))
    others = [c for c in segments.columns if c not in ("x1", "y1", "x2", "y2")]
    a, b = F.col("__p.a"), F.col("__p.b")
    mid = (a + b) / 2.0
    return segments.withColumn("__t", stops).withColumn("__p", F.explode(spans)).select(
        *others,
        F.floor((x1 + (x2 - x1) * mid) / size).alias("ix"),
        F.floor((y1 + (y2 - y1) * mid) / size).alias("iy"),
        (x1 + (x2 - x1) * a).alias("x1"), (y1 + (y2 - y1) * a).alias("y1"),
        (x1 + (x2 - x1) * b).alias("x2"), (y1 + (y2 - y1) * b).alias("y2"),
    )


def _oriented(edges: DataFrame, keys: Sequence[str], ring: str) -> DataFrame:
    """Turn outlines counter-clockwise and holes clockwise, part by part."""
    keys = [*keys, "part"] if "part" in edges.columns else list(keys)
    turn = edges.groupBy(*keys, ring).agg(
        F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("__turn")
    )
    wrong = (F.col("__turn") > 0) != (F.col(ring) == 0)

    def pick(a: str, b: str) -> Column:
        return F.when(wrong, F.col(b)).otherwise(F.col(a))

    return attach(edges, turn, [*keys, ring]).withColumns({
        "x1": pick("x1", "x2"), "y1": pick("y1", "y2"), "x2": pick("x2", "x1"), "y2": pick("y2", "y1")
    }).drop("__turn")


def grid_origins(edges: DataFrame, by: str) -> DataFrame:
    return edges.groupBy(by).agg(
        F.min(F.least("x1", "x2")).alias("origin_x"), F.min(F.least("y1", "y2")).alias("origin_y")
    )


def _local(edges: DataFrame, origin: DataFrame, by: str) -> DataFrame:
    return edges.join(origin, by).withColumns({
        "x1": F.col("x1") - F.col("origin_x"), "x2": F.col("x2") - F.col("origin_x"),
        "y1": F.col("y1") - F.col("origin_y"), "y2": F.col("y2") - F.col("origin_y"),
    })


def boundary_pieces(edges: DataFrame, cell_size: float, by: str = "city") -> DataFrame:
    """Boundary cut at the grid lines: ``by, ix, iy`` and the piece's ends,
    relative to the grid origin."""
    local = _local(edges, lookup(grid_origins(edges, by)), by).select(by, "x1", "y1", "x2", "y2")
    return split_on_grid(local, F.lit(float(cell_size)))


def grid(edges: DataFrame, cell_size: float = 500.0, by: str = "city", unit: str | None = None) -> DataFrame:
    """Square cells clipped to a boundary, with area and centroid.

    Boundary edges are cut at the grid lines. A piece adds the area between
    itself and the floor of its cell, and a full-height strip to every cell
    below it in the column, which a running sum down the column hands on.
    """
    s = F.lit(float(cell_size))
    keys = [by, unit] if unit else [by]
    rings = edges if "ring" in edges.columns else edges.withColumn("ring", F.lit(0))
    origin = lookup(grid_origins(rings, by))
    turned = _oriented(_local(rings, origin, by), keys, "ring").select(by, "x1", "y1", "x2", "y2")
    pieces = split_on_grid(turned, s)
    floor = F.col("iy") * s
    xa, xb = F.col("x1"), F.col("x2")
    ya, yb = F.col("y1") - floor, F.col("y2") - floor
    dx = xa - xb
    touched = pieces.groupBy(by, "ix", "iy").agg(
        F.sum(dx * (ya + yb) / 2.0).alias("__a"),
        F.sum(dx * (xa * (2 * ya + yb) + xb * (ya + 2 * yb)) / 6.0).alias("__mx"),
        F.sum(dx * ((ya * ya + ya * yb + yb * yb) / 6.0 + floor * (ya + yb) / 2.0)).alias("__my"),
        F.sum(dx).alias("__d"),
        F.sum(dx * (xa + xb) / 2.0).alias("__dxx"),
    )
    touched = keep(touched)
    columns = touched.groupBy(by, "ix").agg(F.min("iy").alias("__lo"), F.max("iy").alias("__hi"))
    cells = columns.select(by, "ix", F.explode(F.sequence("__lo", "__hi")).alias("iy"))
    cells = cells.join(touched, [by, "ix", "iy"], "left").na.fill(0.0, ["__a", "__mx", "__my", "__d", "__dxx"])
    above = Window.partitionBy(by, "ix").orderBy(F.col("iy").desc()).rowsBetween(Window.unboundedPreceding, -1)
    d = F.coalesce(F.sum("__d").over(above), F.lit(0.0))
    dxx = F.coalesce(F.sum("__dxx").over(above), F.lit(0.0))
    cells = cells.withColumns({"__cd": d, "__cx": dxx})
    area = F.col("__a") + F.col("__cd") * s
    mx = F.col("__mx") + F.col("__cx") * s
    my = F.col("__my") + F.col("__cd") * s * (F.col("iy") * s + s / 2.0)
    cells = keep(cells.select(
        by, "ix", "iy", area.alias("area_m2"), mx.alias("__mx"), my.alias("__my")
    ).where(F.col("area_m2") > s * s * 1e-12))
    numbered = number_rows(cells, [by], [F.col("ix"), F.col("iy")], "__n")
    x0, y0 = F.col("origin_x") + F.col("ix") * s, F.col("origin_y") + F.col("iy") * s
    return numbered.join(origin, by).select(
        by,
        F.concat(slug(by), F.lit("_"), F.lpad(F.col("__n").cast("string"), F.greatest(F.lit(5), F.length(F.col("__n").cast("string"))), "0")).alias("cell_id"),
        "ix", "iy", "origin_x", "origin_y",
        x0.alias("x0"), y0.alias("y0"), (x0 + s).alias("x1"), (y0 + s).alias("y1"),
        "area_m2",
        (F.col("area_m2") / 1_000_000.0).alias("area_km2"),
        (F.col("origin_x") + F.col("__mx") / F.col("area_m2")).alias("x"),
        (F.col("origin_y") + F.col("__my") / F.col("area_m2")).alias("y"),
    )


def _widest_spans(pieces: DataFrame, cell: Sequence[str], size: Column) -> DataFrame:
    """(cell, across, along): the middle of the widest stretch inside the boundary on
    one line through a cell. ``pieces`` has the ends ``u1, v1, u2, v2`` of directed
    boundary pieces with the inside on their left, and the cell's corner ``u0``.

    The line goes through the tallest piece of the cell, between two heights at which
    pieces end, so it meets pieces between their ends only. A piece that goes up has
    the inside before it, one that goes down has it behind.
    """
    cell = list(cell)
    tall = pieces.where("v1 <> v2").groupBy(*cell).agg(F.max_by((F.col("v1") + F.col("v2")) / 2.0, F.struct(F.abs(F.col("v2") - F.col("v1")), "v1", "u1")).alias("__mid"))
    ends = pieces.select(*cell, F.explode(F.array("v1", "v2")).alias("v")).join(keep(tall), cell)
    below, above = F.max(F.when(F.col("v") <= F.col("__mid"), F.col("v"))), F.min(F.when(F.col("v") > F.col("__mid"), F.col("v")))
    lines = keep(ends.groupBy(*cell).agg(((below + above) / 2.0).alias("along")))
    met = pieces.join(lines, cell).where((F.col("v1") > F.col("along")) != (F.col("v2") > F.col("along")))
    at = F.col("u1") + (F.col("along") - F.col("v1")) * (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))
    ordered = Window.partitionBy(*cell).orderBy("__at", "__up")
    crossed = met.select(*cell, "along", "u0", at.alias("__at"), (F.col("v2") > F.col("v1")).alias("__up")).withColumns({
        "__first": F.row_number().over(ordered) == 1, "__next": F.coalesce(F.lead("__at").over(ordered), F.col("u0") + size)
    })
    spans = F.array(
        F.when(~F.col("__up"), F.struct(F.col("__at").alias("a"), F.col("__next").alias("b"))),
        F.when(F.col("__up") & F.col("__first"), F.struct(F.col("u0").alias("a"), F.col("__at").alias("b"))),
    )
    found = crossed.select(*cell, "along", F.explode(spans).alias("s")).where("s IS NOT NULL")
    middle = F.max_by((F.col("s.a") + F.col("s.b")) / 2.0, F.struct(F.col("s.b") - F.col("s.a"), -F.col("s.a")))
    return found.groupBy(*cell).agg(middle.alias("across"), F.first("along").alias("along"))


def interior_points(edges: DataFrame, cells: DataFrame, cell_size: float = 500.0, by: str = "city") -> DataFrame:
    """Add ``inner_x`` and ``inner_y`` to the cells that ``grid`` made: a point inside
    both the cell and the boundary, also where the centroid of a concave piece lies
    outside. Cells that the boundary does not cut have their middle."""
    s = F.lit(float(cell_size))
    rings = edges if "ring" in edges.columns else edges.withColumn("ring", F.lit(0))
    turned = _oriented(_local(rings, lookup(grid_origins(rings, by)), by), [by], "ring").select(by, "x1", "y1", "x2", "y2")
    cell = [by, "ix", "iy"]
    left, low = F.col("ix") * s, F.col("iy") * s
    # A piece along the cell's border cuts nothing off.
    border = (F.col("x1") == F.col("x2")) & F.col("x1").isin(left, left + s) | (F.col("y1") == F.col("y2")) & F.col("y1").isin(low, low + s)
    pieces = keep(split_on_grid(turned, s).where(~border))
    ends = ("x1", "y1", "x2", "y2")
    across = pieces.select(*cell, *[F.col(c).alias(n) for c, n in zip(ends, ("u1", "v1", "u2", "v2"), strict=True)], left.alias("u0"))
    level = keep(_widest_spans(across, cell, s).select(*cell, F.col("across").alias("__px"), F.col("along").alias("__py")))
    # Cells with level pieces alone are looked at from the side; a mirrored piece runs the other way.
    flat = pieces.join(level.select(*cell), cell, "left_anti")
    mirrored = flat.select(*cell, F.col("y2").alias("u1"), F.col("x2").alias("v1"), F.col("y1").alias("u2"), F.col("x1").alias("v2"), low.alias("u0"))
    upright = _widest_spans(mirrored, cell, s).select(*cell, F.col("along").alias("__px"), F.col("across").alias("__py"))
    inner = lookup(level.unionByName(upright))
    return cells.join(inner, cell, "left").withColumns({
        "inner_x": F.coalesce(F.col("origin_x") + F.col("__px"), F.col("x0") + s / 2.0), "inner_y": F.coalesce(F.col("origin_y") + F.col("__py"), F.col("y0") + s / 2.0)
    }).drop("__px", "__py")


def centroids(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area and centroid of each polygon from moments of its edges."""
    keys = list(keys)
    rings = edges if "ring" in edges.columns else edges.withColumn("ring", F.lit(0))
    base = rings.groupBy(*keys).agg(F.min("x1").alias("__ox"), F.min("y1").alias("__oy"))
    local = attach(rings, base, keys).withColumns({
        "x1": F.col("x1") - F.col("__ox"), "x2": F.col("x2") - F.col("__ox"),
        "y1": F.col("y1") - F.col("__oy"), "y2": F.col("y2") - F.col("__oy"),
    })
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = _oriented(local, keys, "ring").groupBy(*keys).agg(
        (F.sum(cross) / 2.0).alias("area"),
        F.sum((F.col("x1") + F.col("x2")) * cross).alias("__mx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("__my"),
        F.first("__ox").alias("__ox"), F.first("__oy").alias("__oy"),
    )
    return sums.select(
        *keys, "area",
        (F.col("__ox") + F.col("__mx") / (6.0 * F.col("area"))).alias("x"),
        (F.col("__oy") + F.col("__my") / (6.0 * F.col("area"))).alias("y"),
    )


_SHARE = 4  # buckets along a cell in which shared points meet it


def _shared_counts(cells: DataFrame, points: DataFrame, edges: DataFrame, size: float, out: str, by: str, x: str, y: str, layer: list[str]) -> DataFrame:
    """Points that belong to no group, counted in the cells of all groups, or of those
    with their ``layer``. An edge
    that goes up adds the points on its left, one that goes down takes them away, by
    the ray rule of ``containing_units``; what is left are the points inside. Edges of
    a cell meet the points of its buckets, and only their sums are shuffled."""
    rings = edges if "ring" in edges.columns else edges.withColumn("ring", F.lit(0))
    turned = _oriented(rings, [by], "ring").select(by, "x1", "y1", "x2", "y2").where("y1 <> y2")
    bucket, slack = size / _SHARE, size * 1e-6
    places = placed(points, x, y).groupBy(*layer, F.col(x).cast("double").alias("__px"), F.col(y).cast("double").alias("__py")).agg(F.count(F.lit(1)).alias("__n"))
    places = places.withColumns({f"__b{c}": F.floor(F.col(f"__p{c}") / bucket) for c in "xy"})
    met = cells.select(by, *layer, "ix", "iy", "origin_x", "origin_y").join(turned, by)
    low = {c: F.col(f"origin_{c}") + F.col(f"i{c}") * size - slack for c in "xy"}
    high = {c: low[c] + size + 2 * slack for c in "xy"}
    ends = {"x": (low["x"], F.least(high["x"], F.greatest("x1", "x2"))), "y": (F.greatest(low["y"], F.least("y1", "y2")), F.least(high["y"], F.greatest("y1", "y2")))}
    for a, b in ends.values():
        met = met.where(a <= b)
    for c, (a, b) in ends.items():
        met = met.withColumn(f"__b{c}", F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket))))
    px, py = F.col("__px"), F.col("__py")
    at = F.col("x1") + (py - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    own = (F.floor((px - F.col("origin_x")) / size) == F.col("ix")) & (F.floor((py - F.col("origin_y")) / size) == F.col("iy"))
    pairs = met.join(places.hint("merge"), [*layer, "__bx", "__by"]).where(own & ((F.col("y1") > py) != (F.col("y2") > py)) & (px < at))
    return pairs.groupBy(by, "ix", "iy").agg(F.sum(F.when(F.col("y2") > F.col("y1"), F.col("__n")).otherwise(-F.col("__n"))).alias(out))


def contains_count(
    cells: DataFrame,
    points: DataFrame,
    cell_size: float = 500.0,
    out: str = "node_count",
    by: str = "city",
    edges: DataFrame | None = None,
    x: str = "x",
    y: str = "y",
    layer: str | None = None,
) -> DataFrame:
    """Count of points in each grid cell, and per square kilometre. With
    ``edges`` only points inside the boundary count. Points without ``by`` are
    shared by the boundaries of all groups, which may overlap, or by those whose cells
    have the same ``layer``."""
    require_columns(cells, [by, "ix", "iy", "origin_x", "origin_y", "area_km2"], "cells")
    if by not in points.columns:
        require(edges is not None, "points without a group need the edges")
        counts = _shared_counts(cells, points, edges, float(cell_size), out, by, x, y, [layer] if layer else [])
        return _per_km2(cells, counts, by, out)
    held = inside(points, edges, by, x, y) if edges is not None else points
    origins = cells.select(by, "origin_x", "origin_y").distinct()
    size = float(cell_size)
    counts = attach(held, origins, [by], "inner").groupBy(
        by,
        F.floor((F.col(x) - F.col("origin_x")) / size).alias("ix"),
        F.floor((F.col(y) - F.col("origin_y")) / size).alias("iy"),
    ).agg(F.count(F.lit(1)).alias(out))
    return _per_km2(cells, counts, by, out)


def _per_km2(cells: DataFrame, counts: DataFrame, by: str, out: str) -> DataFrame:
    joined = cells.join(counts, [by, "ix", "iy"], "left").withColumn(out, F.coalesce(out, F.lit(0)))
    return joined.withColumn(f"{out}_per_km2", F.col(out) / F.col("area_km2"))


def project(df: DataFrame, by: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Metres ``x, y`` in the UTM zone of the group's mean position."""
    middle = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        utm_zone(F.avg(lon)).alias("utm_zone"), (F.avg(lat) < 0).alias("utm_south")
    )
    east, north = to_utm(F.col(lon), F.col(lat), F.col("utm_zone"), F.col("utm_south"))
    return attach(df, middle, [by]).withColumns({"x": east, "y": north})


def unproject(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Longitude and latitude of projected rows."""
    lon, lat = from_utm(F.col(x), F.col(y), F.col("utm_zone"), F.col("utm_south"))
    return df.withColumns({"lon": lon, "lat": lat})

"""Pixel tables: selection, mosaics, zonal statistics and patches.

A pixel table has one row per pixel with its box ``px0, py0, px1, py1`` (or
``row, col`` on a regular grid) and ``value``; no-data pixels are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import numeric
from tessera.operators.areas import boundary_pieces, inside
from tessera.operators.quantiles import quantile_table
from tessera.runtime import keep, lookup, require, require_columns

# Land-cover class codes.
BUILT_CLASS = 50
OPEN_CLASSES = (10, 20, 30, 60, 90, 95)


def scan_pixels(df: DataFrame, nodata: float | None = None, value: str = "value") -> DataFrame:
    """Drop no-data and unreadable pixels."""
    read = df.withColumn(value, numeric(value)).where(F.col(value).isNotNull())
    return read if nodata is None else read.where(F.col(value) != F.lit(float(nodata)))


def pick_raster(pixels: DataFrame, by: str = "country_iso", raster: str = "raster_id") -> DataFrame:
    """Pixels of the last raster by name of each country."""
    last = pixels.groupBy(by).agg(F.max(raster).alias(raster))
    return pixels.join(lookup(last), [by, raster], "left_semi")


def mosaic(
    pixels: DataFrame, keys: Sequence[str] = ("row", "col"), order: str = "tile_seq", first: bool = True
) -> DataFrame:
    """One value per pixel position: of the first tile, or of the last."""
    choose = F.min_by if first else F.max_by
    return pixels.groupBy(*keys).agg(choose("value", order).alias("value"))


def pixel_boxes(pixels: DataFrame, left: float, top: float, dx: float, dy: float) -> DataFrame:
    """Boxes of ``row, col`` pixels; rows run downwards from ``top``."""
    return pixels.withColumns({
        "px0": F.lit(float(left)) + F.col("col") * float(dx),
        "px1": F.lit(float(left)) + (F.col("col") + 1) * float(dx),
        "py0": F.lit(float(top)) - (F.col("row") + 1) * float(dy),
        "py1": F.lit(float(top)) - F.col("row") * float(dy),
    })


def cell_pixels(
    cells: DataFrame, pixels: DataFrame, by: Sequence[str] = (), id: str = "cell_id", bucket: float | None = None,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Pairs of a cell and a pixel whose boxes overlap. A shared edge is no
    overlap. Each pair is emitted from the one bucket that holds the
    lower-left corner of the overlap."""
    by = list(by)
    require_columns(cells, [*by, id, "x0", "y0", "x1", "y1"], "cells")
    require_columns(pixels, [*by, "px0", "py0", "px1", "py1", "value"], "pixels")
    if bucket is None:
        wide = cells.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("w"))
        bucket = float(wide.first()["w"] or 1.0)
    s = F.lit(float(bucket))

    def spread(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        return df.withColumn(
            "__bx", F.explode(F.sequence(F.floor(F.col(x0) / s), F.floor(F.col(x1) / s)))
        ).withColumn("__by", F.explode(F.sequence(F.floor(F.col(y0) / s), F.floor(F.col(y1) / s))))

    left = lookup(spread(cells.select(*by, *carried, id, "x0", "y0", "x1", "y1"), "x0", "y0", "x1", "y1"))
    right = spread(pixels.select(*by, "px0", "py0", "px1", "py1", "value"), "px0", "py0", "px1", "py1")
    overlap = (
        (F.col("px0") < F.col("x1")) & (F.col("px1") > F.col("x0"))
        & (F.col("py0") < F.col("y1")) & (F.col("py1") > F.col("y0"))
    )
    owner = (F.floor(F.greatest("x0", "px0") / s) == F.col("__bx")) & (
        F.floor(F.greatest("y0", "py0") / s) == F.col("__by")
    )
    return right.join(left, [*by, "__bx", "__by"]).where(overlap & owner).drop("__bx", "__by")


def _crosses(xa: Column, ya: Column, xb: Column, yb: Column, box: Sequence[Column]) -> Column:
    """Whether a segment passes through the open rectangle ``x0, y0, x1, y1``."""
    x0, y0, x1, y1 = box

    def span(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        at_low, at_high = (low - a) / (b - a), (high - a) / (b - a)
        held = (a > low) & (a < high)
        enter = F.when(a == b, F.when(held, 0.0).otherwise(1.0)).otherwise(F.least(at_low, at_high))
        leave = F.when(a == b, F.when(held, 1.0).otherwise(0.0)).otherwise(F.greatest(at_low, at_high))
        return enter, leave

    (ex, lx), (ey, ly) = span(xa, xb, x0, x1), span(ya, yb, y0, y1)
    return F.greatest(ex, ey, F.lit(0.0)) < F.least(lx, ly, F.lit(1.0))


def _clipped(pairs: DataFrame, cells: DataFrame, edges: DataFrame, by: str, id: str, size: float) -> DataFrame:
    """Keep pairs whose common rectangle meets the boundary's inside. Only cells
    the boundary cuts are looked at: such a rectangle counts if the boundary
    crosses it or its centre is inside."""
    cut = F.col("area_m2") < size * size * (1 - 1e-9)
    marked = keep(pairs.join(cells.select(
        by, id, "ix", "iy", "origin_x", "origin_y", cut.alias("__cut")
    ), [by, id]))
    names = ["__rx0", "__ry0", "__rx1", "__ry1"]
    corner = [F.greatest("x0", "px0"), F.greatest("y0", "py0"), F.least("x1", "px1"), F.least("y1", "py1")]
    boxed = marked.where("__cut").withColumns(dict(zip(names, corner)))
    boxes = keep(boxed.select(by, id, "ix", "iy", "origin_x", "origin_y", *names).distinct())
    pieces = lookup(boundary_pieces(edges, size, by)).withColumnsRenamed({c: f"__{c}" for c in ("x1", "y1", "x2", "y2")})
    crossed = boxes.join(pieces, [by, "ix", "iy"]).where(
        _crosses(
            *[F.col(c) for c in ("__x1", "__y1", "__x2", "__y2")],
            [F.col(n) - F.col(o) for n, o in zip(names, ["origin_x", "origin_y"] * 2)],
        )
    ).select(by, id, *names)
    middle = boxes.withColumns({
        "__mx": (F.col("__rx0") + F.col("__rx1")) / 2, "__my": (F.col("__ry0") + F.col("__ry1")) / 2
    })
    held = inside(middle, edges, by, "__mx", "__my").select(by, id, *names)
    met = crossed.unionByName(held).distinct()
    cut_pairs = boxed.join(met, [by, id, *names]).select(by, id, "value")
    return marked.where(~F.col("__cut")).select(by, id, "value").unionByName(cut_pairs)


def touched_pixels(
    cells: DataFrame, pixels: DataFrame, by: Sequence[str] = (), id: str = "cell_id", bucket: float | None = None,
    edges: DataFrame | None = None, layer: str | None = None,
) -> DataFrame:
    """``by, id, value`` of the pixels a cell touches. With boundary ``edges``
    the cells are grid cells clipped to it, and ``bucket`` is their side. Pixels
    that several groups share are keyed by ``layer``, a column of the cells too."""
    pairs = cell_pixels(cells, pixels, [layer], id, bucket, by) if layer else cell_pixels(cells, pixels, by, id, bucket)
    if edges is None:
        return pairs.select(*by, id, "value")
    require(bucket is not None and len(by) == 1, "clipped cells need their side and one group column")
    return _clipped(pairs, cells, edges, by[0], id, float(bucket))


# Pixels that a task holds against cells, and those compared with the edges of a cell at once.
_HELD, _COMPARED = 1_000_000, 200_000


class _Boxes:
    """Pixel boxes of one bucket, by their left sides."""

    def __init__(self, boxes: np.ndarray, weights: np.ndarray):
        order = np.argsort(boxes[0], kind="stable")
        self.boxes, self.weights = boxes[:, order], weights[:, order]
        self.widest = (boxes[2] - boxes[0]).max(initial=0.0) * (1 + 1e-9)

    def touched(self, box: np.ndarray, edges: np.ndarray, cut: bool, own: tuple[float, float, float]) -> np.ndarray:
        """Number and sums of weights of the boxes that a cell touches, of those whose
        overlap has its lower left corner in the bucket ``own``. In a cell that the
        boundary cuts an overlap counts if an edge crosses it or its centre is inside."""
        x0, y0, x1, y1 = box
        first, last = np.searchsorted(self.boxes[0], [x0 - self.widest, x1])
        px0, py0, px1, py1 = self.boxes[:, first:last]
        side, bx, by = own
        low = np.maximum(px0, x0), np.maximum(py0, y0)
        met = np.flatnonzero(
            (px0 < x1) & (px1 > x0) & (py0 < y1) & (py1 > y0) & (np.floor(low[0] / side) == bx) & (np.floor(low[1] / side) == by)
        )
        if cut:
            size = max(_COMPARED // max(edges.shape[1], 1), 1)
            rx0, ry0, rx1, ry1 = (v[met] for v in (*low, np.minimum(px1, x1), np.minimum(py1, y1)))
            held = [_meets((rx0[k:k + size], ry0[k:k + size], rx1[k:k + size], ry1[k:k + size]), edges) for k in range(0, len(met), size)]
            met = met[np.concatenate([np.zeros(0, bool), *held])]
        return np.append(len(met), self.weights[:, first:last][:, met].sum(axis=1))


def _meets(boxes: tuple[np.ndarray, ...], edges: np.ndarray) -> np.ndarray:
    """Whether rectangles meet the inside of a boundary, of which ``edges`` has all
    that pass them or lie to their right: as ``_crosses``, or by the ray rule of
    ``containing_units`` at the centre."""
    x0, y0, x1, y1 = (v[:, None] for v in boxes)
    xa, ya, xb, yb = edges

    def span(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at_low, at_high = (low - a) / (b - a), (high - a) / (b - a)
        held = (a > low) & (a < high)
        enter = np.where(a == b, np.where(held, 0.0, 1.0), np.minimum(at_low, at_high))
        return enter, np.where(a == b, np.where(held, 1.0, 0.0), np.maximum(at_low, at_high))

    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        (ex, lx), (ey, ly) = span(xa, xb, x0, x1), span(ya, yb, y0, y1)
        crossed = np.maximum(np.maximum(ex, ey), 0.0) < np.minimum(np.minimum(lx, ly), 1.0)
        right = ((ya > y) != (yb > y)) & (x < xa + (y - ya) * (xb - xa) / (yb - ya))
    return crossed.any(axis=1) | (right.sum(axis=1) % 2 == 1)


def touched_sums(
    cells: DataFrame, pixels: DataFrame, sums: Mapping[str, Column], by: Sequence[str] = (), id: str = "cell_id",
    bucket: float | None = None, edges: DataFrame | None = None, layer: str | None = None,
) -> DataFrame:
    """``by, id``, sums over the pixels a cell touches as ``touched_pixels`` has them,
    and their number ``__n``, for the cells that touch some. Cells meet pixels in
    buckets, in tasks, so a pair of a cell and a pixel is never a row."""
    by = list(by)
    require_columns(cells, [*by, id, "x0", "y0", "x1", "y1"], "cells")
    shared = [layer] if layer else by
    require_columns(pixels, [*shared, "px0", "py0", "px1", "py1"], "pixels")
    if bucket is None:
        bucket = float(cells.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0)
    side, key, number = 2.0 * float(bucket), [*shared, "__bx", "__by"], F.count(F.lit(1))
    box, weights = ["a", "b", "c", "d"], [f"w{i}" for i in range(len(sums))]
    outline = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    place = F.struct(*[F.col(c) for c in dict.fromkeys([*by, id])])
    asking = cells.select(*dict.fromkeys([*by, *shared]), place.alias("cell"), *[F.col(c).cast("double").alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), box)], *(
        ["area_m2"] if edges is not None else []))
    if edges is None:
        asking = asking.withColumns({"cut": F.lit(False), "edges": outline})
    else:
        require(len(by) == 1, "clipped cells need their side and one group column")
        asking = asking.withColumn("cut", F.col("area_m2") < float(bucket) ** 2 * (1 - 1e-9)).drop("area_m2")
        # As in ``_shared_counts``: the edges at a cell's height that pass it or lie to its right.
        ends = edges.select(by[0], *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
        level = (F.greatest("y1", "y2") >= F.col("b")) & (F.least("y1", "y2") <= F.col("d")) & (F.greatest("x1", "x2") >= F.col("a"))
        cut = asking.where("cut").select(by[0], "cell", *box).join(ends, by[0]).where(level)
        lists = cut.groupBy("cell").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        asking = asking.join(lists, "cell", "left").withColumn("edges", F.coalesce("edges", outline))

    def spread(rows: DataFrame) -> DataFrame:
        for name, low, high in (("__bx", "a", "c"), ("__by", "b", "d")):
            rows = rows.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side))))
        return rows

    asking = keep(spread(asking))
    boxes = pixels.select(*shared, *[F.col(c).cast("double").alias(n) for c, n in zip(("px0", "py0", "px1", "py1"), box)], *[
        F.coalesce(c.cast("double"), F.lit(0.0)).alias(w) for w, c in zip(weights, sums.values())])
    boxes = spread(boxes).join(lookup(asking.select(*key).distinct()), key, "left_semi")
    load = lookup(boxes.groupBy(*key).agg(F.ceil(number / F.lit(_HELD)).cast("int").alias("__blocks")).withColumn("bucket", F.monotonically_increasing_id()))
    lone = F.lit(None).cast(asking.schema["cell"].dataType).alias("cell")
    values = ["bucket", "block", "kind", "__bx", "__by", *box, *weights, "cut", "cell", "edges"]
    sent = boxes.join(load, key).withColumns({
        "block": F.pmod(F.xxhash64(*box), F.col("__blocks")).cast("int"), "kind": F.lit(0), "cut": F.lit(False), "edges": outline,
    }).withColumn("cell", lone).select(*values)
    met = asking.join(load, key).withColumns({
        "block": F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)), "kind": F.lit(1), **{w: F.lit(0.0) for w in weights},
    }).select(*values)
    rows = sent.unionByName(met).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "kind")
    made = T.StructType([T.StructField("cell", asking.schema["cell"].dataType), *[T.StructField(n, T.DoubleType()) for n in ("__n", *weights)]])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each bucket the pixels come first, then its cells."""
        now, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("bucket", "block")])
            kind = np.asarray(batch.column("kind"))
            change = (keys[:, 1:] != keys[:, :-1]).any(axis=0) | (kind[1:] != kind[:-1])
            borders = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                if lo == hi:
                    continue
                if now != tuple(keys[:, lo]):
                    now, parts, held = tuple(keys[:, lo]), [], None
                run = batch.slice(lo, hi - lo)
                own = np.stack([run.column(c).to_numpy() for c in (*box, *weights)])
                if kind[lo] == 0:
                    parts.append(own)
                    continue
                if held is None:
                    whole = np.concatenate([np.zeros((len(own), 0)), *parts], axis=1)
                    held, parts = _Boxes(whole[:4], whole[4:]), []
                cut = run.column("cut").to_numpy(zero_copy_only=False)
                outlines = run.column("edges")
                ends, flat = np.asarray(outlines.offsets) - outlines.offsets[0].as_py(), outlines.flatten()
                flat = np.stack([np.asarray(flat.field(c)) for c in range(4)])
                at = side, run.column("__bx")[0].as_py(), run.column("__by")[0].as_py()
                found = np.stack([held.touched(own[:4, k], flat[:, ends[k]:ends[k + 1]], cut[k], at) for k in range(hi - lo)], axis=1)
                out = pa.RecordBatch.from_arrays([run.column("cell"), *(pa.array(v) for v in found)], names=made.names)
                yield out.filter(pa.array(found[0] > 0))

    found = rows.mapInArrow(scan, made).groupBy(*[F.col(f"cell.{c}").alias(c) for c in dict.fromkeys([*by, id])]).agg(
        F.sum("__n").cast("bigint").alias("__n"), *[F.sum(w).alias(n) for w, n in zip(weights, sums)])
    return found


_DIRECT = {
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "sum": F.sum,
    "std": F.stddev_pop,
    "range": lambda c: F.max(c) - F.min(c),
}
_BY_VALUE = ("majority", "minority", "unique")


def _quantile_of(stat: str) -> float | None:
    if stat == "median":
        return 0.5
    if stat.startswith("percentile_"):
        return float(stat.removeprefix("percentile_")) / 100.0
    return None


def zonal_stats(
    cells: DataFrame,
    pixels: DataFrame,
    stats: Sequence[str] = ("mean",),
    prefix: str = "external_signal",
    by: Sequence[str] = (),
    id: str = "cell_id",
    bucket: float | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Add ``{prefix}_{stat}`` over the touched pixels and ``{prefix}_available``."""
    stats, by = list(stats), list(by)
    require(len(stats) > 0, "at least one statistic is needed")
    known = [s for s in stats if s in _DIRECT or s in _BY_VALUE or _quantile_of(s) is not None]
    require(len(known) == len(stats), f"unknown statistic in {stats}")
    keys = [*by, id]
    pairs = touched_pixels(cells, pixels, by, id, bucket, edges)
    direct = [s for s in stats if s in _DIRECT]
    by_value = [s for s in stats if s in _BY_VALUE]
    quantiles = [s for s in stats if _quantile_of(s) is not None]
    if (len(direct) > 0) + (len(by_value) > 0) + (len(quantiles) > 0) > 1 or quantiles:
        pairs = keep(pairs)
    tables = []
    if direct:
        tables.append(pairs.groupBy(*keys).agg(*[_DIRECT[s]("value").alias(f"{prefix}_{s}") for s in direct]))
    if by_value:
        counts = pairs.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("__n"))
        pick = {
            "majority": F.min_by("value", F.struct(-F.col("__n"), F.col("value"))),
            "minority": F.min_by("value", F.struct(F.col("__n"), F.col("value"))),
            "unique": F.count("value"),
        }
        tables.append(counts.groupBy(*keys).agg(*[pick[s].alias(f"{prefix}_{s}") for s in by_value]))
    if quantiles:
        table = quantile_table(pairs, keys, ["value"], [_quantile_of(s) for s in quantiles])
        tables.append(table.select(*keys, *[F.col("value")[i].alias(f"{prefix}_{s}") for i, s in enumerate(quantiles)]))
    out = cells
    for table in tables:
        out = out.join(table, keys, "left")
    names = [f"{prefix}_{s}" for s in stats]
    present = F.coalesce(*[F.col(c).cast("double") for c in names]).isNotNull()
    return out.withColumn(f"{prefix}_available", present)


def coverage(df: DataFrame, prefix: str = "external_signal") -> DataFrame:
    """One row: rows, covered rows and their share."""
    held = F.col(f"{prefix}_available").cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(held).alias("n_available_rows"), F.avg(held).alias("coverage_share")
    )


def population_sum(
    cells: DataFrame, pixels: DataFrame, by: Sequence[str] = (), id: str = "cell_id", out: str = "population",
    bucket: float | None = None, edges: DataFrame | None = None, layer: str | None = None,
) -> DataFrame:
    sums = touched_sums(cells, pixels, {out: F.col("value")}, by, id, bucket, edges, layer).drop("__n")
    return cells.join(sums, [*by, id], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def class_shares(
    cells: DataFrame,
    pixels: DataFrame,
    by: Sequence[str] = (),
    id: str = "cell_id",
    built: int = BUILT_CLASS,
    open_classes: Sequence[int] = OPEN_CLASSES,
    bucket: float | None = None,
    edges: DataFrame | None = None,
    layer: str | None = None,
) -> DataFrame:
    """Shares of built-up and open pixels; NULL for a cell without pixels."""
    kinds = {"__built": F.col("value") == built, "__open": F.col("value").isin(*open_classes)}
    shares = touched_sums(cells, pixels, {n: c.cast("int") for n, c in kinds.items()}, by, id, bucket, edges, layer).select(
        *by, id, (F.col("__built") / F.col("__n")).alias("building_coverage_ratio"), (F.col("__open") / F.col("__n")).alias("open_space_share"),
    )
    return cells.join(shares, [*by, id], "left")


# The channels of a context patch, in order.
CHANNELS = (
    "population",
    "built_up",
    "open_space",
    "roads",
    "amenities",
    "schools",
    "clinics",
    "intersections",
)


# Cells whose patches are held at once, cells and features of one bucket that a task meets, and shares of all cells.
_CHUNK, _CELLS, _FEATURES, _SHARES = 64, 2_048, 1_000_000, 64
# Corners of points in a table.
_CORNERS = 10_000_000
# Squares of the fine grid of lines along a pixel, those along a wide square, and places of lines held at once.
_FINE, _WIDE, _PLACES = 8, 2, 1_000_000
# Kinds of rows that meet in a bucket; cells come last.
_PEOPLE, _COVER, _POINT, _SEGMENT, _CELL = range(5)
_MARKED = CHANNELS.index("amenities")  # from here on channels are counts of points


class _Counts:
    """Weights of points below and left of a corner: by a table of all corners where the
    points have few different x and y, else in steps of the logarithm of their number:
    the points by x, dealt out by the bits of their place in y."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray):
        self.xs, self.ys, self.table = np.unique(x), np.unique(y), None
        size = len(self.xs) + 1, len(self.ys) + 1
        if size[0] * size[1] <= _CORNERS:
            at = (np.searchsorted(self.xs, x) + 1) * size[1] + np.searchsorted(self.ys, y) + 1
            kind = np.int32 if n.sum() < 2**31 else np.int64
            self.table = np.bincount(at, n, size[0] * size[1]).astype(kind).reshape(size).cumsum(0, kind).cumsum(1, kind).ravel()
        by_x = np.argsort(x, kind="stable")
        self.x, self.y, self.n = x[by_x], y[by_x], n[by_x]
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def _deal(self) -> None:
        self.low = np.sort(self.y)
        rank = np.empty(len(self.y), np.int64)
        rank[np.argsort(self.y, kind="stable")] = np.arange(len(rank))
        n = self.n
        for bit in range(len(rank).bit_length() - 1, -1, -1):
            zero = (rank >> bit) & 1 == 0
            places = np.concatenate([[0], np.cumsum(zero)])
            self.levels.append((bit, int(places[-1]), places, np.concatenate([[0], np.cumsum(np.where(zero, n, 0))])))
            rank, n = (np.concatenate([v[zero], v[~zero]]) for v in (rank, n))

    def _below(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Weight of the first ``i`` points by x that are among the first ``j`` by y."""
        first, last, total = np.zeros_like(j), i + np.zeros_like(j), np.zeros_like(i + j)
        for bit, zeros, places, weights in self.levels:
            one = (j >> bit) & 1 == 1
            a, b = places[first], places[last]
            total = total + np.where(one, weights[last] - weights[first], 0)
            first, last = np.where(one, zeros + first - a, a), np.where(one, zeros + last - b, b)
        return total

    def windows(self, wx: np.ndarray, wy: np.ndarray, res: float, patch_size: int) -> np.ndarray:
        """Weights in the pixels of each window, rows from the top."""
        across, up = (w[:, None] + np.arange(patch_size + 1) * res for w in (wx, wy))
        if self.table is not None:
            i, j = np.searchsorted(self.xs, across) * (len(self.ys) + 1), np.searchsorted(self.ys, up)
            corners = self.table.take(i[:, None, :] + j[:, :, None])
            return np.diff(np.diff(corners, axis=1), axis=2)[:, ::-1, :].astype(float)
        i = np.searchsorted(self.x, across)
        if (i[:, -1] - i[:, 0]).sum() < len(wx) * (patch_size + 1) ** 2 * len(self.x).bit_length():
            out = np.zeros((len(wx), patch_size, patch_size))
            for k, (a, b) in enumerate(zip(i[:, 0], i[:, -1], strict=True)):
                r = np.searchsorted(up[k], self.y[a:b], "right") - 1
                c = np.searchsorted(across[k], self.x[a:b], "right") - 1
                held = (r >= 0) & (r < patch_size)
                np.add.at(out[k], (patch_size - 1 - r[held], c[held]), self.n[a:b][held])
            return out
        if not self.levels:
            self._deal()
        corners = self._below(i[:, None, :], np.searchsorted(self.low, up)[:, :, None])
        return np.diff(np.diff(corners, axis=1), axis=2)[:, ::-1, :].astype(float)


class _Pixels:
    """Values of a grid's pixels by their numbers."""

    def __init__(self, gx: np.ndarray, gy: np.ndarray, value: np.ndarray):
        self.gx, self.gy = np.unique(gx), np.unique(gy)
        self.value = np.zeros((len(self.gx) + 1, len(self.gy) + 1))
        self.held = np.zeros(self.value.shape, bool)
        at = np.searchsorted(self.gx, gx), np.searchsorted(self.gy, gy)
        self.value[at], self.held[at] = value, True
        self.value, self.held = self.value.T.copy(), self.held.T.copy()

    def _place(self, known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        i = np.searchsorted(known, wanted)
        return np.where(np.append(known, np.nan)[i] == wanted, i, len(known))

    def at(self, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
        """Values, lines of y by columns of x; 0 where there is none."""
        return self.value.take(self._place(self.gy, gy), 0).take(self._place(self.gx, gx), 1)

    def around(self, gx: np.ndarray, gy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | float]]:
        """The same at the numbers and the next ones, x first, and whether there is one."""
        i, j = ([self._place(known, g), self._place(known, g + 1)] for known, g in ((self.gx, gx), (self.gy, gy)))
        values = [self.value.take(n, 0) for n in j]
        held = [self.held.take(n, 0) for n in j]
        columns = np.unique(np.concatenate(i))
        whole = all(h.take(columns, 1).all() for h in held)
        for n in i:
            for value, h in zip(values, held, strict=True):
                yield value.take(n, 1), 1.0 if whole else h.take(n, 1)


def _people(pixels: _Pixels, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Log population, bilinear between the centres of the pixels around that exist."""
    gx, gy = np.floor(u), np.floor(v)
    fx, fy = (u - gx)[None, :], (v - gy)[:, None]
    value, weight = 0.0, 0.0
    shares = (1 - fx) * (1 - fy), (1 - fx) * fy, fx * (1 - fy), fx * fy
    for w, (here, held) in zip(shares, pixels.around(gx, gy), strict=True):
        value, weight = value + w * here, weight + w * held
    known = (weight > 0) & ~(value <= 0)
    return np.log1p(np.divide(value, weight, out=np.zeros_like(value), where=known))


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from ``low`` to ``high`` of each row, with the row."""
    many = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(low)), many)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


class _Lines:
    """Lines by the squares of a fine grid in which they have places, so that a
    window looks at few of them one by one. Places of a line are at most a square's
    side apart: a pixel that holds a whole square with a place is passed, and one
    without a place nearby is not. Only the other pixels meet the lines around them."""

    def __init__(self, lines: np.ndarray, corner: tuple[float, float], res: float, patch_size: int):
        self.res, self.patch_size, self.fine = res, patch_size, res / _FINE
        # What lies at least so far inside of a pixel passes it by the test of ``_held``.
        self.margin = 1e-3 * res + 2e-6
        # Windows of a bucket's cells reach two windows far, and their neighbours a little more.
        self.x, self.y = (v - 2 * self.fine for v in corner)
        self.side = 2 * patch_size * _FINE + 8
        self.wide = self.side // _WIDE + 1
        self.lines, short, self.near = lines, np.hypot(lines[2] - lines[0], lines[3] - lines[1]) <= 1e-2, []
        total, solid = (np.zeros(self.side * self.side, np.int32) for _ in range(2))
        for line, square in self._places():
            total += np.bincount(square, minlength=len(total)).astype(np.int32)
            solid += np.bincount(square[~short[line]], minlength=len(total)).astype(np.int32)
            wide = square // self.side // _WIDE * self.wide + square % self.side // _WIDE
            new = np.append(True, (wide[1:] != wide[:-1]) | (line[1:] != line[:-1]))[:len(line)]
            self.near.append((wide[new].astype(np.int32), line[new].astype(np.int32)))
        self.total, self.solid = (np.pad(v.reshape(self.side, self.side).cumsum(0, np.int32).cumsum(1, np.int32), ((1, 0), (1, 0))) for v in (total, solid))
        self.starts = None

    def _places(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Line and square of places along the lines' parts in the grid."""
        x1, y1, x2, y2 = self.lines
        reach = self.side * self.fine
        enter, leave = np.zeros(len(x1)), np.ones(len(x1))
        for a, b, low in ((x1, x2, self.x), (y1, y2, self.y)):
            with np.errstate(divide="ignore", invalid="ignore"):
                p, q = (low - a) / (b - a), (low + reach - a) / (b - a)
            flat, out = a == b, (a < low) | (a > low + reach)
            enter = np.maximum(enter, np.where(flat, np.where(out, 2.0, 0.0), np.minimum(p, q)))
            leave = np.minimum(leave, np.where(flat, 1.0, np.maximum(p, q)))
        seen = np.flatnonzero(enter <= leave)
        steps = np.ceil((leave - enter) * np.hypot(x2 - x1, y2 - y1) / self.fine)[seen].astype(np.int64)
        ends = np.cumsum(steps + 1)
        first = 0
        while first < len(seen):
            last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _PLACES, "right")), first + 1)
            row, step = _runs(np.zeros(last - first, np.int64), steps[first:last])
            line = seen[first:last][row]
            t = enter[line] + (leave[line] - enter[line]) * (step / np.maximum(steps[first:last][row], 1))
            i = np.floor((x1[line] + t * (x2[line] - x1[line]) - self.x) / self.fine).astype(np.int64)
            j = np.floor((y1[line] + t * (y2[line] - y1[line]) - self.y) / self.fine).astype(np.int64)
            inside = (i >= 0) & (i < self.side) & (j >= 0) & (j < self.side)
            yield line[inside], i[inside] * self.side + j[inside]
            first = last

    def _around(self, low: np.ndarray, grown: float, origin: float, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """First square and the one behind the last, of pixels from ``low``, grown to
        both sides: those wholly in a pixel, or all that it meets."""
        a, b = (low - grown - origin) / self.fine, (low + self.res + grown - origin) / self.fine
        first, last = (np.ceil(a), np.floor(b)) if whole else (np.floor(a), np.floor(b) + 1)
        first = np.clip(first, 0, self.side).astype(np.int64)
        return first, np.maximum(np.clip(last, 0, self.side).astype(np.int64), first)

    def passed(self, wx: np.ndarray, wy: np.ndarray) -> np.ndarray:
        """Which pixels of windows the lines pass through, columns by rows from below;
        a corner alone, of which rounding makes a piece of no length, is no passage."""
        across, up = (w[:, None] + np.arange(self.patch_size) * self.res for w in (wx, wy))
        (a, b), (c, d) = self._around(across, -self.margin, self.x, True), self._around(up, -self.margin, self.y, True)
        out = np.empty((len(wx), self.patch_size, self.patch_size), bool)
        for k in range(len(wx)):
            strips = self.solid.take(b[k], 0) - self.solid.take(a[k], 0)
            out[k] = strips.take(d[k], 1) > strips.take(c[k], 1)
        k, i, j = np.nonzero(~out)
        grown = self.fine / 2 + self.margin
        (a, b), (c, d) = self._around(across[k, i], grown, self.x, False), self._around(up[k, j], grown, self.y, False)
        some = self.total[b, d] - self.total[a, d] - self.total[b, c] + self.total[a, c] > 0
        if some.any():
            k, i, j, a, b, c, d = (v[some] for v in (k, i, j, a, b, c, d))
            found = np.zeros(len(k), bool)
            for pixel, line in self._candidates(a // _WIDE, (b - 1) // _WIDE, c // _WIDE, (d - 1) // _WIDE):
                held = self._held(line, wx[k[pixel]], wy[k[pixel]], i[pixel], j[pixel])
                found[pixel[held]] = True
            out[k[found], i[found], j[found]] = True
        return out

    def _candidates(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a pixel and a line with a place in the wide squares around it."""
        if self.starts is None:
            wide, line = (np.concatenate(v) for v in zip(*self.near, strict=True))
            order = np.argsort(wide, kind="stable")
            self.near, self.starts = line[order], np.append(0, np.bincount(wide, minlength=self.wide**2).cumsum())
        for step in range(int((b - a).max()) + 1):
            row = np.flatnonzero(a + step <= b)
            base = (a[row] + step) * self.wide
            pixel, at = _runs(self.starts[base + c[row]], self.starts[base + d[row] + 1] - 1)
            for k in range(0, len(pixel), _PLACES):
                yield row[pixel[k:k + _PLACES]], self.near[at[k:k + _PLACES]]

    def _held(self, line: np.ndarray, wx: np.ndarray, wy: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether lines pass through pixels of windows."""
        x1, y1, x2, y2 = self.lines[:, line]
        res, size = self.res, self.patch_size * self.res
        near = (np.minimum(x1, x2) < wx + size) & (np.maximum(x1, x2) >= wx) & (np.minimum(y1, y2) < wy + size) & (np.maximum(y1, y2) >= wy)
        x1, y1, x2, y2 = x1 - wx, y1 - wy, x2 - wx, y2 - wy
        for a, b, k in ((x1, x2, i), (y1, y2, j)):
            near &= (np.floor(np.minimum(a, b) / res) <= k) & (np.floor(np.maximum(a, b) / res) >= k)
        at = np.flatnonzero(near)
        x1, y1, x2, y2, i, j = (v[at] for v in (x1, y1, x2, y2, i, j))

        def share(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            with np.errstate(divide="ignore", invalid="ignore"):
                p, q = (k * res - a) / (b - a), ((k + 1) * res - a) / (b - a)
            return np.where(a == b, 0.0, np.minimum(p, q)), np.where(a == b, 1.0, np.maximum(p, q))

        (enter_x, leave_x), (enter_y, leave_y) = share(x1, x2, i), share(y1, y2, j)
        length = np.hypot(x2 - x1, y2 - y1)
        inside = np.minimum(np.minimum(leave_x, leave_y), 1.0) - np.maximum(np.maximum(enter_x, enter_y), 0.0)
        near[at] = (length == 0) | (inside * length > 1e-6)
        return near


class _Scene:
    """What the windows of one bucket's cells may hold."""

    def __init__(self, rows: dict[str, np.ndarray], corner: tuple[float, float], patch_size: int, context: float, sizes: Sequence[float], finished: bool):
        def of(kind: int, *names: str) -> list[np.ndarray]:
            return [rows[c][rows["kind"] == kind] for c in names]

        self.patch_size, self.context, self.sizes, self.finished = patch_size, context, sizes, finished
        self.people, self.cover = (_Pixels(*of(k, "a", "b", "v")) if (rows["kind"] == k).any() else None for k in (_PEOPLE, _COVER))
        if self.cover:
            value = self.cover.value
            self.cover.value = np.where(value == BUILT_CLASS, 1.0, np.where(np.isin(value, OPEN_CLASSES), 2.0, 0.0)) * self.cover.held
        lines = np.stack(of(_SEGMENT, "a", "b", "c", "d"))
        lines = lines[:, np.isfinite(lines).all(axis=0)]
        self.lines = _Lines(lines, corner, context / patch_size, patch_size) if lines.shape[1] else None
        x, y, channel, n = of(_POINT, "a", "b", "c", "n")
        self.points = {int(c): _Counts(x[channel == c], y[channel == c], n[channel == c]) for c in np.unique(channel)}

    def patches(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """One flat patch for each cell; counts of points are still to be summed
        over the blocks of a crowded bucket unless they are finished here."""
        p, half, res = self.patch_size, self.context / 2.0, self.context / self.patch_size
        out = np.zeros((len(x), len(CHANNELS), p, p), np.float32)
        for channel, counts in self.points.items():
            found = counts.windows(x - half, y - half, res, p)
            if self.finished:
                most = int(found.max(initial=0.0))
                found = np.log1p(np.arange(most + 1.0))[found.astype(np.int64)] if most < found.size else np.log1p(found)
            out[:, channel] = found
        if self.lines:
            out[:, CHANNELS.index("roads")] = self.lines.passed(x - half, y - half).transpose(0, 2, 1)[:, ::-1]
        steps = np.arange(p) + 0.5
        for k in range(len(x)):
            across, down = (x[k] - half) + steps * res, (y[k] + half) + steps * -res
            if self.people:
                out[k, CHANNELS.index("population")] = _people(self.people, across / self.sizes[0] - 0.5, down / self.sizes[0] - 0.5)
            if self.cover:
                kind = self.cover.at(np.floor(across / self.sizes[1]), np.floor(down / self.sizes[1]))
                out[k, CHANNELS.index("built_up")] = kind == 1.0
                out[k, CHANNELS.index("open_space")] = kind == 2.0
        return out.reshape(len(x), -1)


def _bucketed(rows: DataFrame, side: float, reach: float, x: tuple[str, str], y: tuple[str, str]) -> DataFrame:
    """Rows in the buckets of all cells whose windows may meet their box."""
    for name, (low, high) in (("__bx", x), ("__by", y)):
        first, last = F.floor((F.col(low) - reach) / side), F.floor((F.col(high) + reach) / side)
        rows = rows.withColumn(name, F.explode(F.sequence(first, last)))
    return rows


def _met(cells: DataFrame, features: Sequence[DataFrame], by: list[str], side: float) -> tuple[DataFrame, bool]:
    """Cells and features together, by bucket, features first, and whether a bucket is
    in several blocks. A bucket of many cells, against all cells, is dealt to several
    tasks, and one of many features is cut into blocks that meet all its cells."""
    key, number = [*by, "__bx", "__by"], F.count(F.lit(1))
    asked = keep(cells.groupBy(*key).agg(number.alias("__cells")))
    total = asked.agg(F.sum("__cells")).first()[0] or 0
    most = max(_CELLS, total // _SHARES)
    listed = reduce(DataFrame.unionByName, features).join(lookup(asked.select(*key)), key, "left_semi")
    held = listed.where(F.col("kind").isin(_POINT, _SEGMENT)).groupBy(*key).agg(number.alias("__held"))
    load = keep(asked.join(held, key, "left").select(
        *key, F.ceil(F.col("__cells") / most).cast("int").alias("__salts"),
        F.ceil(F.greatest(F.coalesce("__held", F.lit(0)), F.lit(1)) / _FEATURES).cast("int").alias("__blocks"),
        F.monotonically_increasing_id().alias("bucket"),
    ))

    def dealt(column: str, count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(column)

    own = [F.pmod(F.xxhash64("a", "b"), F.col(m)).cast("int").alias(c) for c, m in (("salt", "__salts"), ("block", "__blocks"))]
    block = F.when(F.col("kind").isin(_POINT, _SEGMENT), F.pmod(F.xxhash64("a", "b", "c", "d"), F.col("__blocks"))).otherwise(0)
    values = ["bucket", "kind", "a", "b", "c", "d", "v", "n", "cell", "number"]
    sent = listed.join(load, key).select(*values, dealt("salt", "__salts"), block.cast("int").alias("block"))
    asking = cells.join(load, key).select(*values, own[0], dealt("block", "__blocks"))
    # A number of tasks by the work, as the bytes are few for it.
    tasks = max(cells.sparkSession.sparkContext.defaultParallelism, -(-total // _CELLS))
    rows = sent.unionByName(asking).repartition(tasks, "bucket", "salt", "block").sortWithinPartitions("bucket", "salt", "block", "kind")
    return rows, (load.agg(F.max("__blocks")).first()[0] or 1) > 1


def patch_features(
    cells: DataFrame,
    pixels: DataFrame,
    points: DataFrame,
    segments: DataFrame | None = None,
    by: Sequence[str] = ("city",),
    id: str = "cell_id",
    patch_size: int = 64,
    context: float = 1500.0,
    pixel_size: float = 100.0,
    cover_size: float | None = None,
    summary: tuple[T.StructType, Callable[[np.ndarray], list[pa.Array]]] | None = None,
) -> DataFrame:
    """A square context window per cell as one flat channel-row-column array.

    ``pixels`` has ``channel`` ('population' or 'cover'), pixel centre ``x, y``
    and ``value``; ``points`` has ``channel`` (a name of ``CHANNELS``) and
    ``x, y``. Population is bilinear over the pixels that exist, land cover is the
    nearest pixel's; their pixels are ``pixel_size`` and ``cover_size`` wide (the
    same if that is None). A pixel without a value is none; of several at one
    place the greatest counts. A road marks every pixel it passes through; a
    corner alone is no passage.

    Cells meet what lies around them in buckets as wide as a window, where patches
    are made a few at a time, so no slot of a patch is shuffled. Many points are
    counted by the corners of the pixels, not one by one. With a ``summary``, columns
    and what makes them of patches (cells, channels, slots), these take the place of
    ``patch``, and no patch leaves the task that made it.
    """
    by, side, half = list(by), float(context), context / 2.0
    require_columns(cells, [*by, id, "x", "y"], "cells")
    sizes = float(pixel_size), float(cover_size or pixel_size)
    place = F.struct(*cells.columns)
    none = {c: F.lit(None).cast(t) for c, t in (("a", "double"), ("b", "double"), ("c", "double"), ("d", "double"), ("v", "double"), ("n", "bigint"), ("number", "bigint"))}

    def shaped(rows: DataFrame, kind: int, cell: Column | None = None, **values: Column) -> DataFrame:
        lone = F.lit(None).cast(cells.schema) if cell is None else cell
        return rows.select(*by, "__bx", "__by", F.lit(kind).alias("kind"), *[values.get(c, v).alias(c) for c, v in none.items()], lone.alias("cell"))

    located = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    for c in by:
        located = located & F.col(c).isNotNull()
    known = cells.withColumns({"__x": F.col("x").cast("double"), "__y": F.col("y").cast("double"), "__number": F.monotonically_increasing_id()})
    asking = known.where(located).withColumns({"__bx": F.floor(F.col("__x") / side), "__by": F.floor(F.col("__y") / side)})
    asking = shaped(asking, _CELL, place, a=F.col("__x"), b=F.col("__y"), number=F.col("__number"))
    # A little more reach than rounding could need.
    reach = half + 1e-6 * context
    features = []
    for channel, kind, size in (("population", _PEOPLE, sizes[0]), ("cover", _COVER, sizes[1])):
        grid = pixels.where((F.col("channel") == channel) & F.col("value").isNotNull()).groupBy(
            *by, F.floor(F.col("x") / size).alias("__gx"), F.floor(F.col("y") / size).alias("__gy")
        ).agg(F.max(F.col("value").cast("double")).alias("__v"))
        grid = grid.withColumns({"__cx": (F.col("__gx") + 0.5) * size, "__cy": (F.col("__gy") + 0.5) * size})
        spread = _bucketed(grid, side, reach + 2 * size, ("__cx", "__cx"), ("__cy", "__cy"))
        features.append(shaped(spread, kind, a=F.col("__gx").cast("double"), b=F.col("__gy").cast("double"), v=F.col("__v")))
    number = F.coalesce(*[F.when(F.col("channel") == c, F.lit(float(i))) for i, c in enumerate(CHANNELS)])
    marked = points.select(*by, number.alias("__c"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["__c", "x", "y"])
    # Copies of a place are one row with a number.
    places = marked.groupBy(*by, "__c", "x", "y").agg(F.count(F.lit(1)).alias("__n"))
    spread = _bucketed(places, side, reach, ("x", "x"), ("y", "y"))
    features.append(shaped(spread, _POINT, a=F.col("x"), b=F.col("y"), c=F.col("__c"), n=F.col("__n")))
    if segments is not None:
        ends = ["x1", "y1", "x2", "y2"]
        lines = segments.select(*by, *[F.col(c).cast("double").alias(c) for c in ends]).dropna(subset=ends).distinct()
        lines = lines.withColumns({f"__{f}{c}": g(f"{c}1", f"{c}2") for c in "xy" for f, g in (("l", F.least), ("h", F.greatest))})
        spread = _bucketed(lines, side, reach, ("__lx", "__hx"), ("__ly", "__hy"))
        features.append(shaped(spread, _SEGMENT, **{n: F.col(c) for n, c in zip("abcd", ends)}))
    rows, parted = _met(keep(asking), [keep(f) for f in features], by, side)
    # The type as a row has it, in which a cell may be missing.
    patch = T.StructType([T.StructField("patch", T.ArrayType(T.FloatType()))])
    early = patch if summary is None or parted else summary[0]
    made = T.StructType([T.StructField("number", T.LongType()), rows.schema["cell"], *early])
    total = len(CHANNELS) * patch_size * patch_size
    names = ("kind", "a", "b", "c", "d", "v", "n")

    def lists(flat: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * total), pa.array(flat.ravel()))]

    def summed_up(flat: np.ndarray) -> list[pa.Array]:
        return summary[1](flat.reshape(len(flat), len(CHANNELS), -1))

    held = lists if early is patch else summed_up

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each bucket the features come first, then its cells."""
        now, parts, scene = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("bucket", "salt", "block")])
            kind = np.asarray(batch.column("kind"))
            change = (keys[:, 1:] != keys[:, :-1]).any(axis=0) | ((kind[1:] == _CELL) != (kind[:-1] == _CELL))
            borders = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                if lo == hi:
                    continue
                if now != tuple(keys[:, lo]):
                    now, parts, scene = tuple(keys[:, lo]), [], None
                run = batch.slice(lo, hi - lo)
                if kind[lo] != _CELL:
                    parts.append({c: run.column(c).to_numpy(zero_copy_only=False) for c in names})
                    continue
                if scene is None:
                    empty = {c: np.zeros(0) for c in names}
                    whole = {c: np.concatenate([r[c] for r in [empty, *parts]]) for c in names}
                    corner = tuple(np.floor(run.column(c)[0].as_py() / side) * side - half for c in "ab")
                    scene, parts = _Scene(whole, corner, patch_size, context, sizes, not parted), []
                for k in range(0, hi - lo, _CHUNK):
                    some = run.slice(k, _CHUNK)
                    flat = scene.patches(some.column("a").to_numpy(), some.column("b").to_numpy())
                    yield pa.RecordBatch.from_arrays([some.column("number"), some.column("cell"), *held(flat)], names=made.names)

    out = rows.mapInArrow(scan, made)
    if parted:
        # Blocks of a crowded bucket add up.
        def together(v: Column, i: Column) -> Column:
            channel = F.floor(i / (patch_size * patch_size))
            return F.when(channel >= _MARKED, F.log1p(v)).when(channel == CHANNELS.index("roads"), F.least(v, F.lit(1.0))).otherwise(v)

        zero = F.array_repeat(F.lit(0.0), total)
        summed = F.aggregate("patches", zero, lambda s, p: F.zip_with(s, p, lambda x, y: x + y.cast("double")))
        blocks = out.groupBy("number").agg(F.any_value("cell").alias("cell"), F.collect_list("patch").alias("patches"))
        out = blocks.select("cell", F.transform(summed, together).cast("array<float>").alias("patch"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), total).alias("patch")
    if summary is None:
        return out.select("cell.*", "patch").unionByName(known.where(~located).select(*cells.columns, zeros))

    def summarized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _CHUNK):
                some = batch.slice(k, _CHUNK)
                flat = some.column("patch").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, total)
                yield pa.RecordBatch.from_arrays([some.column("cell"), *summed_up(flat)], names=["cell", *summary[0].names])

    late = known.where(~located).select(place.alias("cell"), zeros)
    late = late.unionByName(out.select("cell", "patch")) if parted else late
    shown = late.mapInArrow(summarized, T.StructType([T.StructField("cell", cells.schema), *summary[0]]))
    shown = shown if parted else shown.unionByName(out.select("cell", *summary[0].names))
    return shown.select("cell.*", *summary[0].names)


# Columns of ``slot_digests``, digests of equal channels that are kept, and values in thousandths that are written from a table.
SLOT_DIGESTS = T.StructType([T.StructField("n_filled", T.ArrayType(T.LongType())), T.StructField("slots_sha256", T.ArrayType(T.StringType()))])
_DIGESTS, _WRITTEN = 256, 10_000


def slot_digests() -> Callable[[np.ndarray], list[pa.Array]]:
    """A summary of patches: of each channel the number of filled slots, and a digest
    of ``slot:value`` of these in their order, comma-joined, values in thousandths."""
    tables, seen = {}, {}

    def text(at: np.ndarray, value: np.ndarray, slots: int) -> bytes:
        if len(value) and (value.min() < 0 or value.max() >= _WRITTEN or slots > 99_999):
            return ",".join(f"{s}:{v}" for s, v in zip(at.tolist(), value.tolist(), strict=True)).encode()
        if slots not in tables:
            tables[slots] = np.array([f",{s}:" for s in range(slots)], "S8").view(np.uint64), np.array([str(v) for v in range(_WRITTEN)], "S4").view(np.uint32)
        # Words of one width, whose empty bytes are then left out.
        words = np.empty(len(at), [("slot", np.uint64), ("value", np.uint32)])
        words["slot"], words["value"] = tables[slots][0][at], tables[slots][1][value]
        return words.tobytes().translate(None, b"\0")[1:]

    def made(patches: np.ndarray) -> list[pa.Array]:
        counts, digests = [], []
        for flat in patches.reshape(-1, patches.shape[2]):
            key = flat.tobytes()
            if key not in seen:
                if len(seen) >= _DIGESTS:
                    seen.clear()
                at = np.flatnonzero(flat)
                value = np.floor(flat[at].astype(np.float64) * 1000 + 0.5).astype(np.int64)
                seen[key] = len(at), sha256(text(at, value, len(flat))).hexdigest()
            counts.append(seen[key][0])
            digests.append(seen[key][1])
        ends = pa.array(np.arange(len(patches) + 1, dtype=np.int32) * patches.shape[1])
        return [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((counts, pa.int64()), (digests, pa.string()))]

    return made

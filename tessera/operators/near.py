"""Nearest neighbours, nearest lines and counts within a radius.

Both sides are first reduced to distinct locations, so copies of one place cost
one row. Locations meet through square buckets in equi-joins. The bucket side
starts so small that even the densest bucket holds a bounded number of
locations; a query whose answer is not proven by its 3x3 block goes on to
buckets three times as wide. Dense areas finish in the first rounds, so a wide
bucket is only ever probed by the few queries of sparse areas.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import numeric
from tessera.functions.geo import segment_distance2
from tessera.operators.quantiles import quantile_table
from tessera.runtime import attach, broadcast_rows, keep, lookup, require_columns

_GROWTH = 3.0
_DENSEST = 64  # locations per wanted neighbour in the fullest first bucket
_COVERED = 4  # times the buckets first covered, above which the side shrinks no more
_CROWDED = 1_000_000  # candidates one task should compare with a query
_COMPANY = 7  # queries in a bucket of lines, on average
_PAIRS = 100  # comparisons a bucket row of a line is worth
_BLOCK = 1_024  # vectors that one task holds against as many others


def _frame(query: DataFrame, boxes: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Per group: origin, extent and first bucket size. Groups without a
    candidate drop out."""
    aggs = [F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")]
    names = ["__ax", "__ay", "__bx", "__by"]
    size = boxes.groupBy(*by).agg(
        *[a.alias(n) for a, n in zip(aggs, names)],
        F.count(F.lit(1)).alias("__m"),
        F.avg(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("__long"),
    )
    seen = query.groupBy(*by).agg(
        F.min("qx").alias("__cx"), F.min("qy").alias("__cy"), F.max("qx").alias("__dx"), F.max("qy").alias("__dy"),
    )
    joined = size.join(seen, list(by)) if by else size.crossJoin(F.broadcast(seen))
    low = [F.least("__ax", "__cx"), F.least("__ay", "__cy")]
    high = [F.greatest("__bx", "__dx"), F.greatest("__by", "__dy")]
    extent = F.greatest(high[0] - low[0], high[1] - low[1])
    extent = F.when(extent > 0, extent * 1.000001).otherwise(1.0)
    first = F.greatest(extent * F.sqrt(F.lit(0.6 * k + 1.4) / F.col("__m")), F.col("__long"))
    return joined.where(F.col("__m") > 0).select(
        *by, low[0].alias("__ox"), low[1].alias("__oy"), extent.alias("__extent"),
        F.least(first, extent).alias("__s"),
    )


def _cell(value: str, origin: str, size: Column) -> Column:
    return F.floor((F.col(value) - F.col(origin)) / size)


def _loads(boxes: DataFrame, by: Sequence[str], factors: Sequence[float]) -> list[tuple[int, int]]:
    """For each factor: boxes in the fullest bucket, and buckets covered by all
    boxes together. One pass for all factors."""
    tries = boxes.withColumn("__f", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    buckets = _covering(tries, F.col("__s") * F.col("__f"), 0).groupBy("__f", *by, "__bx", "__by").agg(F.count(F.lit(1)).alias("n"))
    found = {r["__f"]: (r["top"], r["all"]) for r in buckets.groupBy("__f").agg(F.max("n").alias("top"), F.sum("n").alias("all")).collect()}
    return [found.get(float(f), (0, 0)) for f in factors]


def _load(boxes: DataFrame, by: Sequence[str], factor: float) -> tuple[int, int]:
    return _loads(boxes, by, [factor])[0]


def _first_scale(boxes: DataFrame, by: Sequence[str], k: int) -> tuple[float, int]:
    """Shrink factor of the bucket side and the load of its fullest bucket. The
    side shrinks until no bucket is overfull, or until boxes would cover many
    buckets each: lines that meet in a point are not parted by smaller buckets,
    and a full bucket is then salted instead. The covered buckets of all factors
    are counted before any is laid out; the first is tried alone, the others
    three in a pass."""
    def covers(factor: float) -> Column:
        size = F.col("__s") * F.lit(factor)
        wide = [_cell(f"{c}2", f"__o{c}", size) - _cell(f"{c}1", f"__o{c}", size) + 1 for c in "xy"]
        return F.sum(wide[0].cast("double") * wide[1])

    factors = [_GROWTH**-i for i in range(17)]
    covered = boxes.agg(*[covers(f).alias(f"c{i}") for i, f in enumerate(factors)]).first()
    most = _COVERED * max(covered[0] or 0, 1)
    allowed = [f for i, f in enumerate(factors) if all((covered[j] or 0) <= most for j in range(1, i + 1))]
    best = (1.0, 0)
    for chunk in (allowed[:1], *(allowed[i : i + 3] for i in range(1, len(allowed), 3))):
        for factor, (fullest, _) in zip(chunk, _loads(boxes, by, chunk)):
            best = (factor, fullest)
            if fullest <= _DENSEST * max(k, 1):
                return best
    return best


def cut_lines(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bounding boxes of pieces of each line, none much longer than the first
    bucket side, so that a long line covers the buckets along it and not the
    whole square around it. The line's own ends are ``__x1 .. __y2``."""
    by = list(by)
    low = [F.least("__x1", "__x2"), F.least("__y1", "__y2")]
    high = [F.greatest("__x1", "__x2"), F.greatest("__y1", "__y2")]
    frame = lines.groupBy(*by).agg(
        F.greatest(F.max(high[0]) - F.min(low[0]), F.max(high[1]) - F.min(low[1])).alias("__e"), F.count(F.lit(1)).alias("__m")
    ).where("__m > 0").select(*by, (F.col("__e") * F.sqrt(2.0 / F.col("__m"))).alias("__step"))
    framed = attach(lines, frame, by, "inner")
    long = F.greatest(F.abs(F.col("__x2") - F.col("__x1")), F.abs(F.col("__y2") - F.col("__y1")))
    n = F.when(F.col("__step") > 0, F.greatest(F.lit(1), F.ceil(long / F.col("__step")).cast("int"))).otherwise(1)
    pieces = framed.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))

    def at(axis: str, i: Column) -> Column:
        a, b = F.col(f"__{axis}1"), F.col(f"__{axis}2")
        return F.when(i == F.col("__n"), b).otherwise(a + (b - a) * i / F.col("__n"))

    ends = {c: (at(c, F.col("__i")), at(c, F.col("__i") + 1)) for c in "xy"}
    boxed = {f"{c}{k}": pick(*ends[c]) for c in "xy" for k, pick in ((1, F.least), (2, F.greatest))}
    return pieces.withColumns(boxed).drop("__step", "__n", "__i")


def _search(query: DataFrame, boxes: DataFrame, by: list[str], k: int, d2: Column) -> DataFrame:
    """The ``k`` nearest candidates of each query location: rows
    ``by, qx, qy, cid, d2, seq``, nearest first, ties by ``cid``. With ``k = 1``
    a candidate id may stand for several boxes."""
    boxes, left = keep(boxes), keep(query)
    frame = lookup(_frame(left, boxes, by, k))

    def framed(rows: DataFrame) -> DataFrame:
        return rows.join(frame, by) if by else rows.crossJoin(frame)

    boxes, left = framed(boxes), framed(left)
    factor, fullest = _first_scale(boxes, by, k)
    first = factor
    found: list[DataFrame] = []
    waiting = left.count()
    while True:
        size = F.col("__s") * F.lit(factor)
        if waiting * 9 <= broadcast_rows(query.sparkSession):
            near = _nearest_of_few(left, boxes, by, k, size, d2)
        else:
            load = fullest if factor == first else _load(boxes, by, factor)[0]
            salts = max(1, -(-load // _CROWDED))
            near = _nearest_of_many(left, boxes, by, k, size, d2, salts)
        whole = Window.partitionBy(*by, "__bx", "__by", "__salt", "qx", "qy")
        # How far the block around the query reaches for certain.
        inset = [F.pmod(F.col(q) - F.col(o), F.col("__size")) for q, o in (("qx", "__ox"), ("qy", "__oy"))]
        reach = F.col("__size") + F.least(*inset, *[F.col("__size") - i for i in inset])
        full = (F.max("seq").over(whole) == k) & (F.sqrt(F.max("d2").over(whole)) <= reach * (1 - 1e-9))
        final = full | (F.col("__size") >= F.col("__extent"))
        done = keep(near.withColumn("__final", final).where("__final").select(*by, "qx", "qy", "cid", "d2", "seq"))
        found.append(done)
        rest = left.join(done.where("seq = 1").select(*by, "qx", "qy"), [*by, "qx", "qy"], "left_anti")
        left = keep(rest.where(size < F.col("__extent")))
        waiting = left.count()
        if not waiting:
            break
        factor *= _GROWTH
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _probes(left: DataFrame, by: list[str], size: Column) -> DataFrame:
    return left.select(
        *by, "qx", "qy", _cell("qx", "__ox", size).alias("__bx"), _cell("qy", "__oy", size).alias("__by"),
        size.alias("__size"), "__extent", "__ox", "__oy",
    )


def _covering(boxes: DataFrame, size: Column, margin: int) -> DataFrame:
    """One row per bucket a box covers, and ``margin`` buckets around."""
    wide = boxes.withColumn(
        "__bx", F.explode(F.sequence(_cell("x1", "__ox", size) - margin, _cell("x2", "__ox", size) + margin))
    ).withColumn("__by", F.explode(F.sequence(_cell("y1", "__oy", size) - margin, _cell("y2", "__oy", size) + margin)))
    return wide.drop("__ox", "__oy", "__extent", "__s")


def _nearest_of_few(left: DataFrame, boxes: DataFrame, by: list[str], k: int, size: Column, d2: Column) -> DataFrame:
    """Queries few enough to broadcast visit the candidates where they lie.
    Every task keeps its own best ``k`` of a query before anything moves."""
    steps = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"))
        for i in (-1, 0, 1) for j in (-1, 0, 1)
    ])
    probes = _probes(left, by, size).withColumn("__o", F.explode(steps)).withColumns({
        "__bx": F.col("__bx") + F.col("__o.i"), "__by": F.col("__by") + F.col("__o.j")
    }).drop("__o")
    pairs = _covering(boxes, size, 0).join(F.broadcast(probes), [*by, "__bx", "__by"]).withColumn("d2", d2)
    pairs = pairs.withColumns({"__bx": F.lit(0), "__by": F.lit(0), "__salt": F.lit(0)})
    place = Window.partitionBy(*by, "qx", "qy").orderBy("d2", "cid")
    return pairs.withColumn("seq", F.row_number().over(place)).where(F.col("seq") <= k)


def _nearest_of_many(
    left: DataFrame, boxes: DataFrame, by: list[str], k: int, size: Column, d2: Column, salts: int
) -> DataFrame:
    """A candidate is copied to its own and the adjoining buckets, a query stays
    in its one bucket. So all pairs of a query are made in one partition and
    ranked there: pairs are never shuffled. A bucket too wide for one task is
    salted over several, whose few best are ranked once more."""
    probes = _probes(left, by, size).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = _covering(boxes, size, 1).withColumn("__salt", F.pmod(F.xxhash64("cid"), F.lit(salts)).cast("int"))
    bucket = [*by, "__bx", "__by", "__salt"]
    pairs = probes.join(spread.hint("merge"), bucket).withColumn("d2", d2)
    place = Window.partitionBy(*bucket, "qx", "qy").orderBy("d2", "cid")
    near = pairs.withColumn("seq", F.row_number().over(place)).where(F.col("seq") <= k)
    if salts > 1:
        again = Window.partitionBy(*by, "qx", "qy").orderBy("d2", "cid")
        near = near.withColumn("__salt", F.lit(0))
        near = near.withColumn("seq", F.row_number().over(again)).where(F.col("seq") <= k)
    return near


def placed(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that have a position."""
    return df.where(numeric(x).isNotNull() & numeric(y).isNotNull())


def _locations(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return placed(df, x, y).select(
        *by, F.col(x).cast("double").alias("qx"), F.col(y).cast("double").alias("qy")
    ).distinct()


def _thinned(df: DataFrame, by: Sequence[str], id: str, x: str, y: str, k: int) -> DataFrame:
    """Candidate points; of copies of one location only the first ``k`` by id
    can be among anyone's ``k`` nearest."""
    rows = placed(df, x, y).select(
        *by, F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"), F.col(id).alias("cid")
    )
    copies = Window.partitionBy(*by, "x1", "y1").orderBy("cid")
    rows = rows.withColumn("__c", F.row_number().over(copies)).where(F.col("__c") <= k).drop("__c")
    return rows.withColumns({"x2": F.col("x1"), "y2": F.col("y1")})


def _point_d2() -> Column:
    dx, dy = F.col("x1") - F.col("qx"), F.col("y1") - F.col("qy")
    return dx * dx + dy * dy


def knn(
    cells: DataFrame, samples: DataFrame, by: Sequence[str], k: int, id: str, sample_id: str,
    x: str = "x", y: str = "y",
) -> DataFrame:
    """``k`` nearest samples of each cell in its group: ``by, id, sample_id,
    distance, seq``."""
    by = list(by)
    require_columns(cells, [*by, id, x, y], "cells")
    require_columns(samples, [*by, sample_id, x, y], "samples")
    hits = _search(_locations(cells, by, x, y), _thinned(samples, by, sample_id, x, y, k), by, k, _point_d2())
    rows = cells.select(*by, id, F.col(x).cast("double").alias("qx"), F.col(y).cast("double").alias("qy"))
    return rows.join(hits, [*by, "qx", "qy"]).select(
        *by, id, F.col("cid").alias(sample_id), F.sqrt("d2").alias("distance"), "seq"
    )


def knn_edges(
    df: DataFrame, by: Sequence[str], k: int, id: str, x: str = "x", y: str = "y"
) -> DataFrame:
    """``k`` nearest other rows of the same group: ``by, src, dst, distance, seq``."""
    by = list(by)
    hits = _search(_locations(df, by, x, y), _thinned(df, by, id, x, y, k + 1), by, k + 1, _point_d2())
    rows = df.select(
        *by, F.col(id).alias("src"), F.col(x).cast("double").alias("qx"), F.col(y).cast("double").alias("qy")
    )
    # Each row has at most k + 1 candidates here, one of which may be itself.
    pairs = rows.join(hits, [*by, "qx", "qy"]).where(F.col("src") != F.col("cid"))
    place = Window.partitionBy(*by, "src").orderBy("d2", "cid")
    return pairs.withColumn("seq", F.row_number().over(place)).where(F.col("seq") <= k).select(
        *by, "src", F.col("cid").alias("dst"), F.sqrt("d2").alias("distance"), "seq"
    )


def _matrix(rows: pa.Table) -> np.ndarray:
    lists = rows["v"].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _nearest_vectors(queries: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, squared distance) of the ``k`` nearest candidates of
    each query, ties by place. A product of matrices only bounds the distances;
    what its rounding leaves open is computed from the differences."""
    k = min(k, len(candidates))
    q2, c2 = (queries**2).sum(axis=1), (candidates**2).sum(axis=1)
    near = q2[:, None] + c2[None, :] - 2 * (queries @ candidates.T)
    slack = 8 * (queries.shape[1] + 4) * np.finfo(np.float64).eps * (q2 + c2.max())
    open_ = near <= (np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack)[:, None]
    picked, far = [], []
    for x in range(len(queries)):
        at = np.flatnonzero(open_[x])
        d2 = ((candidates[at] - queries[x]) ** 2).sum(axis=1)
        best = np.lexsort((at, d2))[:k]
        picked.append(at[best])
        far.append(d2[best])
    return np.repeat(np.arange(len(queries)), k), np.concatenate(picked), np.concatenate(far)


def vector_edges(df: DataFrame, by: Sequence[str], k: int, id: str, vector: str) -> DataFrame:
    """``k`` nearest other rows of the same group by the distance of whole
    vectors: ``by, src, dst, distance, seq``, ties by ``dst``. Vectors of
    different lengths have no distance; vectors with a missing or not finite
    element are left out. Copies of a vector are one query, and of its copies
    only the first ``k + 1`` by id are candidates. Every block of queries meets
    every block of candidates of its group, so the result is exact."""
    by = list(by)
    require_columns(df, [*by, id, vector], "df")
    v = F.col(vector)
    if df.schema[vector].dataType.elementType != T.FloatType():
        v = v.cast("array<double>")
    rows = df.select(*by, F.col(id).alias("src"), v.alias("v")).where(
        (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    rows = keep(rows.dropna(subset=by) if by else rows)
    groups = [*by, "__n"]
    places = keep(rows.select(*by, "v").distinct().withColumns({"__n": F.size("v"), "node": F.monotonically_increasing_id()}))
    named = keep(rows.join(places.select(*by, "v", "node"), [*by, "v"]).select(*by, "src", "node"))
    copies = Window.partitionBy("node").orderBy("src")
    first = named.withColumn("__c", F.row_number().over(copies)).where(F.col("__c") <= k + 1).select("node", F.col("src").alias("cid"))
    candidates = keep(first.join(places, "node"))

    def dealt(side: DataFrame, own: str, other: DataFrame, its: str, key: str) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        for rows, name in ((side, own), (other, its)):
            parts = rows.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias(f"__parts{name}"))
            side = side.join(lookup(parts), groups)
        side = side.withColumn(own, F.pmod(F.xxhash64(key), F.col(f"__parts{own}")).cast("int"))
        return side.withColumn(its, F.explode(F.sequence(F.lit(0), F.col(f"__parts{its}") - 1))).drop(f"__parts{own}", f"__parts{its}")

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("cid", df.schema[id].dataType), T.StructField("d2", T.DoubleType())])

    def meet(queries: pa.Table, others: pa.Table) -> pa.Table:
        if not queries.num_rows or not others.num_rows:
            return pa.table({"node": queries["node"].slice(0, 0), "cid": others["cid"].slice(0, 0), "d2": pa.array([], pa.float64())})
        others = others.sort_by("cid")
        x, y, d2 = _nearest_vectors(_matrix(queries), _matrix(others), k + 1)
        return pa.table({"node": queries["node"].take(pa.array(x)), "cid": others["cid"].take(pa.array(y)), "d2": pa.array(d2)})

    keys = [*groups, "__i", "__j"]
    queries = dealt(places, "__i", candidates, "__j", "node").groupBy(*keys)
    others = dealt(candidates, "__j", places, "__i", "cid").groupBy(*keys)
    found = queries.cogroup(others).applyInArrow(meet, schema)
    best = Window.partitionBy("node").orderBy("d2", "cid")
    hits = keep(found.withColumn("__c", F.row_number().over(best)).where(F.col("__c") <= k + 1).drop("__c"))
    # Each row has at most k + 1 candidates here, one of which may be itself.
    pairs = named.join(hits, "node").where(F.col("src") != F.col("cid"))
    place = Window.partitionBy(*by, "src").orderBy("d2", "cid")
    return pairs.withColumn("seq", F.row_number().over(place)).where(F.col("seq") <= k).select(
        *by, "src", F.col("cid").alias("dst"), F.sqrt("d2").alias("distance"), "seq"
    )


def _line_frame(query: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """Per group: extent of the queries, origin and extent of all, and the first
    bucket side. It follows the queries: were it as fine as the lines are many, each
    line would cover the more buckets the more lines there are."""
    low = [F.least("__x1", "__x2"), F.least("__y1", "__y2")]
    high = [F.greatest("__x1", "__x2"), F.greatest("__y1", "__y2")]
    reach = lines.groupBy(*by).agg(
        F.min(low[0]).alias("__ax"), F.min(low[1]).alias("__ay"), F.max(high[0]).alias("__zx"), F.max(high[1]).alias("__zy"), F.count(F.lit(1)).alias("__m"),
    )
    seen = query.groupBy(*by).agg(
        F.min("qx").alias("__cx"), F.min("qy").alias("__cy"), F.max("qx").alias("__dx"), F.max("qy").alias("__dy"), F.count(F.lit(1)).alias("__q"),
    )
    joined = seen.join(reach, by) if by else seen.crossJoin(F.broadcast(reach))
    low = [F.least("__ax", "__cx"), F.least("__ay", "__cy")]
    extent = F.greatest(F.greatest("__zx", "__dx") - low[0], F.greatest("__zy", "__dy") - low[1])
    extent = F.when(extent > 0, extent * 1.000001).otherwise(1.0)
    wide = F.greatest(F.col("__dx") - F.col("__cx"), F.col("__dy") - F.col("__cy"))
    wide = F.when(wide > 0, wide).otherwise(extent)
    side = wide * F.sqrt(F.greatest(_COMPANY / F.col("__q"), 2.0 / F.col("__m")))
    return joined.where("__m > 0 AND __q > 0").select(
        *by, low[0].alias("__ox"), low[1].alias("__oy"), "__cx", "__cy", "__dx", "__dy", extent.alias("__extent"), F.least(side, extent).alias("__s"),
    )


def _line_probes(left: DataFrame, by: list[str], size: Column) -> DataFrame:
    """Queries in the buckets within a quarter of the side."""
    out = left.select(*by, "qx", "qy", "__ox", "__oy", size.alias("__size"))
    for axis in "xy":
        at = F.col(f"q{axis}") - F.col(f"__o{axis}")
        spans = [F.floor((at + sign * F.col("__size") / 4.0) / F.col("__size")) for sign in (-1, 1)]
        out = out.withColumn(f"__b{axis}", F.explode(F.sequence(*spans)))
    return out.select(*by, "qx", "qy", "__bx", "__by")


def _line_buckets(lines: DataFrame, by: list[str], size: Column) -> DataFrame:
    """One row per line and bucket, for the buckets the queries may look into. A
    line is cut into pieces of a bucket's side, of which only those by the extent of
    the queries are made."""
    out = lines.withColumn("__size", size)
    long = F.greatest(F.abs(F.col("__x2") - F.col("__x1")), F.abs(F.col("__y2") - F.col("__y1")))
    out = out.withColumn("__n", F.greatest(F.lit(1).cast("bigint"), F.ceil(long / F.col("__size"))))
    first, last, meets = F.lit(0.0), F.lit(1.0), F.lit(True)
    for axis in "xy":
        a, b = F.col(f"__{axis}1"), F.col(f"__{axis}2")
        low, high = F.col(f"__c{axis}") - F.col("__size") * 2.0, F.col(f"__d{axis}") + F.col("__size") * 2.0
        ends = [F.when(a != b, (w - a) / (b - a)) for w in (low, high)]
        first, last = F.greatest(first, F.least(*ends)), F.least(last, F.greatest(*ends))
        meets = meets & (F.greatest(a, b) >= low) & (F.least(a, b) <= high)
    n = F.col("__n")
    out = out.where(meets).withColumns({
        "__i0": F.greatest(F.lit(0).cast("bigint"), F.floor(first * n) - 1), "__i1": F.least(n - 1, F.ceil(last * n) + 1)
    }).where("__i0 <= __i1").withColumn("__i", F.explode(F.sequence("__i0", "__i1")))

    def at(axis: str, i: Column) -> Column:
        a, b = F.col(f"__{axis}1"), F.col(f"__{axis}2")
        return F.when(i == F.col("__n"), b).otherwise(a + (b - a) * i / F.col("__n"))

    for axis in "xy":
        ends = [at(axis, F.col("__i")), at(axis, F.col("__i") + 1)]
        place = [F.floor((e - F.col(f"__o{axis}")) / F.col("__size")) for e in (F.least(*ends), F.greatest(*ends))]
        seen = [F.floor((F.col(f"__{e}{axis}") + sign * F.col("__size") / 4.0 - F.col(f"__o{axis}")) / F.col("__size")) for e, sign in (("c", -1), ("d", 1))]
        out = out.withColumns({f"__l{axis}": F.greatest(place[0], seen[0]), f"__h{axis}": F.least(place[1], seen[1])})
    out = out.where("__lx <= __hx AND __ly <= __hy")
    for axis in "xy":
        out = out.withColumn(f"__b{axis}", F.explode(F.sequence(f"__l{axis}", f"__h{axis}")))
    return out.select(*by, "__bx", "__by", "__x1", "__y1", "__x2", "__y2")


def _line_work(left: DataFrame, lines: DataFrame, by: list[str], size: Column) -> tuple[int, int, int]:
    """Rows of lines in buckets, comparisons, and those of the fullest bucket."""
    key = [*by, "__bx", "__by"]
    held = _line_buckets(lines, by, size).groupBy(*key).agg(F.count(F.lit(1)).alias("__nb"))
    asked = _line_probes(left, by, size).groupBy(*key).agg(F.count(F.lit(1)).alias("__nq"))
    pairs = F.coalesce(F.col("__nq"), F.lit(0)) * F.col("__nb").cast("double")
    r = held.join(asked, key, "left").agg(F.sum("__nb").alias("rows"), F.sum(pairs).alias("pairs"), F.max(pairs).alias("top")).first()
    return int(r["rows"] or 0), int(r["pairs"] or 0), int(r["top"] or 0)


def _nearest_lines(query: DataFrame, lines: DataFrame, by: list[str], d2: Column) -> DataFrame:
    """Squared distance of each location to the closest line of its group: ``by,
    qx, qy, d2``. Lines lie in the buckets they pass, and queries go to the buckets
    around them, so the many lines are not copied to the buckets around theirs. An
    answer within a quarter of the side is proven, the others go on to buckets three
    times as wide."""
    lines, left = keep(lines), keep(query)
    frame = lookup(_line_frame(left, lines, by))

    def framed(rows: DataFrame) -> DataFrame:
        return rows.join(frame, by) if by else rows.crossJoin(frame)

    lines, left = framed(lines), framed(left)
    spark, factor, work = query.sparkSession, 1.0, None
    waiting = left.count()
    while waiting * 4 > broadcast_rows(spark):
        # A dense spot makes buckets smaller as long as that saves more comparisons than it makes rows.
        finer = _line_work(left, lines, by, F.col("__s") * F.lit(factor))
        if work and _PAIRS * finer[0] + finer[1] >= _PAIRS * work[0] + work[1]:
            factor *= _GROWTH
            break
        work = finer
        if work[1] <= _PAIRS * work[0]:
            break
        factor /= _GROWTH
    found: list[DataFrame] = []
    while waiting:
        size = F.col("__s") * F.lit(factor)
        probes, held = _line_probes(left, by, size), _line_buckets(lines, by, size)
        key = [*by, "__bx", "__by"]
        if waiting * 4 <= broadcast_rows(spark):
            pairs = held.join(F.broadcast(probes), key)
        else:
            top = (work if not found and work else _line_work(left, lines, by, size))[2]
            salts = max(1, -(-top // (_PAIRS * _CROWDED)))
            held = held.withColumn("__salt", F.pmod(F.xxhash64("__x1", "__y1", "__x2", "__y2"), F.lit(salts)).cast("int"))
            probes = probes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            pairs = probes.join(held.hint("merge"), [*key, "__salt"])
        near = pairs.groupBy(*by, "qx", "qy").agg(F.min(d2).alias("d2"))
        final = (F.sqrt("d2") <= size / 4.0 * (1 - 1e-9)) | (size >= F.col("__extent"))
        done = keep(framed(near).where(final).select(*by, "qx", "qy", "d2"))
        found.append(done)
        left = keep(left.join(done, [*by, "qx", "qy"], "left_anti").where(size < F.col("__extent")))
        waiting = left.count()
        factor *= _GROWTH
    if not found:
        return left.select(*by, "qx", "qy", F.lit(0.0).alias("d2"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _nearest(cells: DataFrame, boxes: DataFrame, by: list[str], x: str, y: str, out: str, d2: Column) -> DataFrame:
    places = _locations(cells, by, x, y)
    hits = _nearest_lines(places, boxes, by, d2) if "__x1" in boxes.columns else _search(places, boxes, by, 1, d2)
    found = hits.select(*by, F.col("qx"), F.col("qy"), F.sqrt("d2").alias(out))
    keyed = cells.withColumns({"qx": F.col(x).cast("double"), "qy": F.col(y).cast("double")})
    return keyed.join(found, [*by, "qx", "qy"], "left").drop("qx", "qy")


def nearest_distance(
    cells: DataFrame, targets: DataFrame, out: str, by: Sequence[str] = ("city",), x: str = "x", y: str = "y"
) -> DataFrame:
    """Add the distance to the closest target of the group, at any distance.
    ``targets`` are points (``x, y``) or segments (``x1, y1, x2, y2``); a group
    without targets gets NULL."""
    by = list(by)
    if "x1" in targets.columns:
        ends = targets.select(*by, *[F.col(c).cast("double").alias(f"__{c}") for c in ("x1", "y1", "x2", "y2")])
        known = ends.distinct().dropna(subset=["__x1", "__y1", "__x2", "__y2"])
        d2 = segment_distance2(*[F.col(c) for c in ("qx", "qy", "__x1", "__y1", "__x2", "__y2")])
        return _nearest(cells, known, by, x, y, out, d2)
    points = _locations(targets, by, x, y).select(
        *by, F.col("qx").alias("x1"), F.col("qy").alias("y1"), F.col("qx").alias("x2"), F.col("qy").alias("y2"),
        F.struct("qx", "qy").alias("cid"),
    )
    return _nearest(cells, points, by, x, y, out, _point_d2())


_LEAF = 8_192  # locations in a node of the count tree that one task holds against circles
_DEPTH = 16  # halvings of the radius after which a node is split no more
_ASKED = 50_000  # circles that one task holds against a node
_TASK = 100_000  # meetings of a circle and a node in a task
_FEW = 64  # locations that are compared one by one


def _nodes(places: DataFrame, key: Sequence[str], level: int) -> DataFrame:
    """Places with their node at a level, by the ids of the finest nodes."""
    up = _DEPTH - level
    node = {"__bx": F.shiftright("__fx", up), "__by": F.shiftright("__fy", up)}
    return places.select(*key, "__px", "__py", "__n", "__fx", "__fy", *[c.alias(n) for n, c in node.items()])


def _within(px: np.ndarray, py: np.ndarray, n: np.ndarray, qx: np.ndarray, qy: np.ndarray, r2: float) -> np.ndarray:
    """The sum of ``n`` of the locations closer to each query than the radius. The
    locations are halved again and again, and each part is counted whole, left out
    or halved on, for those queries alone whose circle cuts its box."""
    out, slack = np.zeros(len(qx), np.int64), 1e-9 * (r2 + 1.0)
    parts = [(px, py, n, np.arange(len(qx)))]
    while parts:
        px, py, n, at = parts.pop()
        x, y = qx[at], qy[at]
        x1, x2, y1, y2 = px.min(), px.max(), py.min(), py.max()
        inside = np.maximum(x - x1, x2 - x) ** 2 + np.maximum(y - y1, y2 - y) ** 2 < r2 - slack
        out[at[inside]] += n.sum()
        near = np.maximum(np.maximum(x1 - x, x - x2), 0.0) ** 2 + np.maximum(np.maximum(y1 - y, y - y2), 0.0) ** 2
        at = at[~inside & (near < r2 + slack)]
        if not len(at):
            continue
        if len(px) <= _FEW:
            for block in np.split(at, range(512, len(at), 512)):
                close = (px - qx[block, None]) ** 2 + (py - qy[block, None]) ** 2 < r2
                out[block] += np.where(close, n, 0).sum(axis=1)
            continue
        half = len(px) // 2
        order = np.argpartition(px if x2 - x1 >= y2 - y1 else py, half)
        parts += [(px[k], py[k], n[k], at) for k in (order[:half], order[half:])]
    return out


def _compared(asked: DataFrame, held: DataFrame, nodes: DataFrame, key: Sequence[str], place: Sequence[str], r2: float, leaf: int) -> DataFrame:
    """(place, __n) of the circles ``asked`` (place, __node, __load) against the
    locations of their nodes. A node of more than ``leaf`` locations is cut into
    parts, and the circles at a node into shares, so that a task holds few of
    either; counts of parts add up."""
    crowd = asked.groupBy("__node").agg(F.ceil(F.count(F.lit(1)) / F.lit(_ASKED)).cast("int").alias("__shares"))
    crowd = lookup(crowd.where("__shares > 1"))
    shares, parts = F.coalesce("__shares", F.lit(1)), F.greatest(F.ceil(F.col("__load") / F.lit(leaf)).cast("int"), F.lit(1))
    circles = asked.join(crowd, "__node", "left").select(
        "__node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"), F.pmod(F.xxhash64("qx", "qy"), shares).cast("int").alias("__share"),
        F.lit(1).alias("__q"), F.lit(0).cast("long").alias("__n"), *place,
    )
    points = held.join(nodes.select(*key, "__node", "__load"), list(key)).join(crowd, "__node", "left").select(
        "__node", F.pmod(F.xxhash64("__px", "__py"), parts).cast("int").alias("__part"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("__share"),
        F.lit(0).alias("__q"), "__n", *place[:-2], F.col("__px").alias("qx"), F.col("__py").alias("qy"),
    )
    task = ["__node", "__part", "__share"]
    schema = T.StructType([*circles.select(*place).schema.fields, T.StructField("__n", T.LongType())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each task's share the locations come first, then the circles."""
        now, own = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.column_stack([np.asarray(batch.column(c)) for c in task])
            q, n, x, y = (np.asarray(batch.column(c)) for c in ("__q", "__n", "qx", "qy"))
            borders = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(ids)]
            found = np.zeros(len(ids), np.int64)
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                if tuple(ids[lo]) != now:
                    now, own = tuple(ids[lo]), []
                first = lo + int(np.searchsorted(q[lo:hi], 1))
                if first > lo:
                    own.append((x[lo:first], y[lo:first], n[lo:first]))
                if hi > first and own:
                    own = [tuple(np.concatenate(c) for c in zip(*own, strict=True))]
                    found[first:hi] = _within(*own[0], x[first:hi], y[first:hi], r2)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in place), pa.array(found)], names=schema.names)
            yield out.filter(pa.array(found > 0))

    # A number of tasks by the work, as the bytes are few for it.
    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // _TASK))
    together = circles.unionByName(points).repartition(tasks, *task).sortWithinPartitions(*task, "__q")
    return together.mapInArrow(scan, schema)


def count_within(
    cells: DataFrame,
    points: DataFrame,
    radius: float = 1000.0,
    out: str = "count_within",
    by: Sequence[str] = ("city",),
    id: str = "cell_id",
    x: str = "x",
    y: str = "y",
    leaf: int = _LEAF,
) -> DataFrame:
    """Add the number of points closer than ``radius``.

    Circles descend a quadtree of counts whose first nodes are one radius wide.
    A node wholly inside the circle adds its count; a node the circle cuts is
    split if it holds more than ``leaf`` distinct locations, else it meets its
    circles in a task, where its locations are halved on and few are compared.
    Each node is split by its own load, so a dense spot makes deep nodes only
    where it lies, and a circle is a row for few nodes.
    """
    by = list(by)
    require_columns(cells, [*by, id, x, y], "cells")
    require_columns(points, [*by, x, y], "points")
    r, r2 = float(radius), float(radius) ** 2
    fine = {f"__f{c}": F.floor(F.col(f"__p{c}") / r * 2**_DEPTH) for c in "xy"}
    places = placed(points, x, y).groupBy(
        *by, F.col(x).cast("double").alias("__px"), F.col(y).cast("double").alias("__py")
    ).agg(F.count(F.lit(1)).alias("__n"))
    places = keep(places.withColumns(fine))

    def around(value: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(value) / r) - 1, F.floor(F.col(value) / r) + 1))

    probes = _locations(cells, by, x, y).withColumn("__bx", around("qx")).withColumn("__by", around("qy"))
    key, place = [*by, "__bx", "__by"], [*by, "qx", "qy"]
    # The slack keeps nodes next to the circle on the exact side.
    slack = 1e-9 * (r2 + 1.0)
    counted: list[DataFrame] = []
    for level in range(_DEPTH + 1):
        side = r / 2**level
        held = _nodes(places, by, level)
        nodes = held.groupBy(*key).agg(F.sum("__n").alias("__total"), F.count(F.lit(1)).alias("__load"))
        nodes = lookup(nodes.withColumn("__node", F.monotonically_increasing_id()))
        split = F.col("__load") > (leaf if level < _DEPTH else F.lit(float("inf")))

        def gap(value: str, node: str) -> tuple[Column, Column]:
            low = F.col(node) * side - F.col(value)
            return F.greatest(low, -(low + side), F.lit(0.0)), F.greatest(F.abs(low), F.abs(low + side))

        (nx, fx), (ny, fy) = gap("qx", "__bx"), gap("qy", "__by")
        inside = fx * fx + fy * fy < r2 - slack
        met = keep(probes.where(nx * nx + ny * ny < r2 + slack).join(nodes, key).withColumns({"__in": inside, "__split": split}))
        deeper = level < _DEPTH and not nodes.where(split).isEmpty()
        counted.append(met.where("__in").select(*place, F.col("__total").alias("__n")))
        asked = met.where("NOT __in AND NOT __split").select(*place, "__node", "__load")
        counted.append(_compared(asked, held, nodes.where(~split), key, place, r2, leaf))
        if not deeper:
            break
        halves = {n: F.explode(F.sequence(F.col(n) * 2, F.col(n) * 2 + 1)) for n in ("__bx", "__by")}
        probes = met.where("NOT __in AND __split").select(*key, "qx", "qy")
        for name, half in halves.items():
            probes = probes.withColumn(name, half)
        places = keep(held.join(nodes.where(split).select(*key), key, "left_semi").drop("__bx", "__by"))
    total = counted[0]
    for more in counted[1:]:
        total = total.unionByName(more)
    total = total.groupBy(*place).agg(F.sum("__n").alias(out))
    keyed = cells.withColumns({"qx": F.col(x).cast("double"), "qy": F.col(y).cast("double")})
    joined = keyed.join(total, place, "left").drop("qx", "qy")
    return joined.withColumn(out, F.coalesce(out, F.lit(0)).cast("bigint"))


def weighted_knn(
    cells: DataFrame,
    samples: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    k: int = 4,
    max_distance: float = 4000.0,
    floor_distance: float = 25.0,
    id: str = "cell_id",
    sample_id: str = "sample_id",
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Inverse-distance means of the ``k`` nearest samples no further than
    ``max_distance``, or of the single nearest one if all are further. One row
    per cell: ``by, id, values, max_neighbor_distance, neighbor_count``."""
    by = list(by)
    pairs = knn(cells, samples, by, k, id, sample_id, x, y)
    used = pairs.where((F.col("distance") <= float(max_distance)) | (F.col("seq") == 1))
    rows = used.join(samples.select(*by, sample_id, *values), [*by, sample_id])
    w = 1.0 / F.greatest("distance", F.lit(float(floor_distance)))
    return rows.groupBy(*by, id).agg(
        *[(F.sum(F.col(v) * w) / F.sum(w)).alias(v) for v in values],
        F.max("distance").alias("max_neighbor_distance"),
        F.count(F.lit(1)).alias("neighbor_count"),
    )


def knn_graph(
    df: DataFrame, by: str = "city", k: int = 8, id: str = "cell_id", x: str = "x", y: str = "y"
) -> DataFrame:
    """Undirected neighbour graph inside each group with self-loops and
    symmetric degree weights: ``by, src, dst, weight``."""
    near = keep(knn_edges(df, [by], k, id, x, y).select(by, "src", "dst"))
    loops = df.select(by, F.col(id).alias("src"), F.col(id).alias("dst"))
    edges = keep(
        near.unionByName(near.select(by, F.col("dst").alias("src"), F.col("src").alias("dst")))
        .unionByName(loops).distinct()
    )
    degrees = keep(edges.groupBy(by, "src").agg(F.count(F.lit(1)).alias("__d")))
    return (
        edges.join(degrees, [by, "src"])
        .join(degrees.select(by, F.col("src").alias("dst"), F.col("__d").alias("__e")), [by, "dst"])
        .select(by, "src", "dst", (1.0 / F.sqrt(F.col("__d") * F.col("__e"))).alias("weight"))
    )


def neighbor_aggregate(edges: DataFrame, features: DataFrame, by: str, id: str, columns: Sequence[str]) -> DataFrame:
    """One propagation step: weighted sums of the neighbours' features."""
    rows = edges.join(features.select(by, F.col(id).alias("dst"), *columns), [by, "dst"])
    return rows.groupBy(by, F.col("src").alias(id)).agg(
        *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns]
    )


def filled_coordinates(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Coordinates with missing ones set to the group's median, or 0."""
    table = quantile_table(df.where(F.col(by).isNotNull()), [by], [x, y], [0.5])
    table = table.select(by, F.col(x)[0].alias("__mx"), F.col(y)[0].alias("__my"))
    return attach(df, table, [by]).withColumns({
        x: F.coalesce(x, "__mx", F.lit(0.0)), y: F.coalesce(y, "__my", F.lit(0.0))
    }).drop("__mx", "__my")

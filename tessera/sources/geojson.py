"""GeoJSON as tables: it is JSON, so Spark's own reader parses it."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tessera.runtime import MissingColumns, keep, lookup, require

_GEOMETRY = "geometry struct<type: string, coordinates: string>"
_EITHER = f"type string, features array<struct<properties: variant, {_GEOMETRY}>>, properties variant, {_GEOMETRY}, _corrupt_record string"
_FORMS = ("Feature", "FeatureCollection")
_POSITION = "array<double>"
# A file of features may differ in its properties, but not in more than so many.
MAX_PROPERTIES = 10_000


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of a path: one a line, which splits over tasks, if every
    line is a feature or a collection; else one a file, which may span lines."""
    known = F.coalesce(F.col("type").isin(*_FORMS), F.lit(False))
    lines = spark.read.schema(_EITHER).json(path)
    if lines.where(~known).isEmpty():
        return lines
    whole = spark.read.schema(_EITHER).json(path, multiLine=True)
    if not whole.where(~known).isEmpty():
        raise ValueError(f"{path} holds JSON that is neither a feature nor a feature collection")
    return whole


# JSON text up to a brace that opens an object, strings and what they hold aside.
_TO_BRACE = r'(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'
_ONE = "type string, properties variant, " + _GEOMETRY


def _outside(text: Column, inside: int) -> Column:
    """Text without strings, escapes being gone; ``inside``: it begins in one."""
    text = F.regexp_replace(text, '^[^"]*("|$)', "") if inside else text
    return F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), '"[^"]*$', "")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text of all files, cut behind every closing brace by Spark's reader, which
    splits a file over tasks; ``block`` and ``pos`` give the order in a file."""
    return spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value",
    )


def _all_collections(pieces: DataFrame) -> bool:
    """Whether every file says at its beginning that it is a collection."""
    heads = pieces.where("block = 0").groupBy("source").agg(F.min_by("value", "pos").alias("head"))
    said = F.col("head").rlike(r'^\s*\{[^{]*"type"\s*:\s*"FeatureCollection"')
    row = heads.agg(F.count(F.lit(1)).alias("n"), F.sum(said.cast("int")).alias("yes")).first()
    return bool(row["n"]) and row["n"] == row["yes"]


def _split_features(pieces: DataFrame) -> DataFrame:
    """One row per element of the collections, without any task that reads a whole file.

    Whether a piece begins in a string, and how deep, depends on all text before it.
    So each block is counted for both beginnings, the blocks of a file are chained,
    and each piece then picks the count that holds.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    counted = pieces.withColumns({"__b": bare, "q": _count(bare, '"')})
    for s in (0, 1):
        text = _outside(F.col("__b"), s)
        closes = (F.lit(s) + F.col("q")) % 2 == 0
        counted = counted.withColumns({
            f"up{s}": _count(text, "{"), f"shut{s}": closes.cast("int"), f"square{s}": _count(text, "[") - _count(text, "]")
        })
    block = Window.partitionBy("source", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # a block at most
    placed = counted.drop("__b").withColumn("odd", (F.sum("q").over(block) - F.col("q")) % 2)
    begun = {h: (F.col("odd") + h) % 2 == 1 for h in (0, 1)}

    def chosen(name: str, inside: Column) -> Column:
        return F.when(inside, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    for h, inside in begun.items():
        placed = placed.withColumns({
            f"deep{h}": F.sum(chosen("up", inside) - chosen("shut", inside)).over(block),
            f"wide{h}": F.sum(chosen("square", inside)).over(block),
        })
    placed = keep(placed)
    last = {c: F.max_by(c, "pos").alias(c) for c in ("deep0", "deep1", "wide0", "wide1")}
    totals = placed.groupBy("source", "block").agg(F.sum("q").alias("q"), *last.values())
    file = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = totals.withColumn("h", F.coalesce(F.sum("q").over(file), F.lit(0)) % 2)
    own = {c: F.when(F.col("h") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0")) for c in ("deep", "wide")}
    starts = starts.select("source", "block", "h", own["deep"].alias("d"), own["wide"].alias("w"))
    starts = lookup(starts.select(
        "source", "block", "h", "d", "w", F.coalesce(F.sum("d").over(file), F.lit(0)).alias("d0"), F.coalesce(F.sum("w").over(file), F.lit(0)).alias("w0")
    ))
    # What follows the last brace, such as a line end, counts as one brace more.
    broken = starts.groupBy("source").agg(F.sum("d").alias("d"), F.sum("w").alias("w")).where("d NOT IN (0, -1) OR w <> 0")
    if not broken.isEmpty():
        raise ValueError("a feature collection ends too early")
    inside = (F.col("odd") + F.col("h")) % 2 == 1
    rows = placed.join(starts.drop("d", "w"), ["source", "block"]).select(
        "source", "block", "pos", "value", inside.alias("inside"), chosen("shut", inside).alias("shut"), chosen("up", inside).alias("up"),
        (F.col("d0") + F.when(F.col("h") == 1, F.col("deep1")).otherwise(F.col("deep0"))).alias("deep"),
        (F.col("w0") + F.when(F.col("h") == 1, F.col("wide1")).otherwise(F.col("wide0"))).alias("wide"),
    )
    top = F.col("deep") + F.col("shut")  # after what opens, before the brace that ends the piece
    before = top - F.col("up")
    cut = F.when(before == 0, F.regexp_extract("value", r"(?s)^" + _TO_BRACE + r"\{" + _TO_BRACE + r"(\{.*)$", 1)).when(
        F.col("inside"), F.regexp_extract("value", r'(?s)^(?:[^"\\]++|\\.)*+"' + _TO_BRACE + r"(\{.*)$", 1)
    ).otherwise(F.regexp_extract("value", r"(?s)^" + _TO_BRACE + r"(\{.*)$", 1))
    text = F.when(top < 2, "").otherwise(F.concat(F.when(before < 2, cut).otherwise(F.col("value")), F.lit("}")))
    ends = (F.col("shut") == 1) & (F.col("deep") <= 1)
    rows = rows.select(
        "source", "block", "pos", text.alias("t"), ends.cast("int").alias("end"),
        (ends & (F.col("deep") == 1) & (F.col("wide") == 1)).cast("int").alias("held"),
    )
    rows = rows.withColumns({f"{c}s": F.sum(c).over(block) - F.col(c) for c in ("end", "held")})
    rows = keep(rows)
    sums = rows.groupBy("source", "block").agg(F.sum("end").alias("e"), F.sum("held").alias("n"))
    sums = lookup(sums.select("source", "block", *[F.coalesce(F.sum(c).over(file), F.lit(0)).alias(c) for c in ("e", "n")]))
    numbered = rows.join(sums, ["source", "block"]).select(
        "source", (F.col("e") + F.col("ends")).alias("object"), (F.col("n") + F.col("helds")).alias("feature"), "block", "pos", "t", "held"
    )
    # Dealt by place, so that features come in the order of their file.
    objects = numbered.repartitionByRange("source", "object").groupBy("source", "object", "feature").agg(
        F.max("held").alias("held"), F.array_sort(F.collect_list(F.struct("block", "pos", "t"))).alias("p")
    ).sortWithinPartitions("source", "object")  # the pieces of one feature
    # An explode and no filter, as a filter may change places with the error below.
    text = F.array_join(F.transform("p", lambda x: x["t"]), "")
    parsed = objects.select("source", "feature", F.explode(F.when(F.col("held") == 1, F.array(text)).otherwise(F.array().cast("array<string>"))).alias("t"))
    wrong = F.raise_error(F.concat(F.lit("an element of a feature collection is no feature: "), "source"))
    known = F.coalesce(F.get_json_object("t", "$.type") == "Feature", F.lit(False))
    return parsed.select("source", "feature", F.from_json(F.when(known, F.col("t")).otherwise(wrong), _ONE).alias("f"))


def _features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature of either form; its number counts within its document,
    or its file where all files begin as collections, which are then split over tasks."""
    pieces = _pieces(spark, path)
    if _all_collections(pieces):
        found = _split_features(pieces)
    else:
        documents = _documents(spark, path).withColumn("source", F.input_file_name())
        own = F.array(F.struct("properties", "geometry"))
        held = F.when(F.col("type") == "Feature", own).otherwise(F.col("features"))
        found = documents.select("source", F.posexplode(held).alias("feature", "f"))
    return found.select(
        "source", F.col("feature").cast("long").alias("feature"), F.col("f.properties").alias("properties"),
        F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"),
    )


def _path(name: str) -> str:
    require("'" not in name and "\\" not in name, f"unsupported property name {name}")
    return f"$['{name}']"


def _typed(properties: Mapping[str, str]) -> list[Column]:
    return [F.try_variant_get("properties", _path(name), kind).alias(name) for name, kind in properties.items()]


def property_types(rows: DataFrame) -> dict[str, str]:
    """Names and types of the properties, from one aggregate of their schemas."""
    found = rows.agg(F.schema_of_variant_agg("properties").alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        return {}
    ddl = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", found).replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    schema = DataType.fromDDL(ddl)
    require(len(schema.fields) <= MAX_PROPERTIES, f"more than {MAX_PROPERTIES} properties")
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def read_feature_lines(spark: SparkSession, path: str, properties: Mapping[str, str]) -> DataFrame:
    """Features with the named properties, ``properties`` mapping names to types."""
    return _features(spark, path).select(*_typed(properties), "geometry_type", "coordinates")


def read_geojson(spark: SparkSession, path: str, properties: Mapping[str, str] | None = None) -> DataFrame:
    """One row per feature: ``feature``, one typed column per property and the
    geometry as its type and coordinate text. Types that are given spare the
    pass that finds them; a value of another type is NULL."""
    rows = _features(spark, path)
    kinds = dict(sorted(property_types(rows).items())) if properties is None else properties
    return rows.select("feature", *_typed(kinds), "geometry_type", "coordinates")


def _parsed(kind: str, depth: int) -> Column:
    schema = _POSITION
    for _ in range(depth):
        schema = f"array<{schema}>"
    return F.when(F.col("geometry_type") == kind, F.from_json("coordinates", schema))


def polygon_edges(features: DataFrame, keys: list[str]) -> DataFrame:
    """Edge table ``keys, part, ring, seq, x1, y1, x2, y2`` of polygon features."""
    polygons = F.coalesce(_parsed("MultiPolygon", 3), F.array(_parsed("Polygon", 2)))
    rings = (
        features.where(F.col("geometry_type").isin("Polygon", "MultiPolygon"))
        .select(*keys, F.posexplode(polygons).alias("part", "rings"))
        .select(*keys, "part", F.posexplode("rings").alias("ring", "p"))
    )
    return _edges(rings, [*keys, "part", "ring"])


def line_edges(features: DataFrame, keys: list[str]) -> DataFrame:
    lines = F.coalesce(_parsed("MultiLineString", 2), F.array(_parsed("LineString", 1)))
    rows = features.where(F.col("geometry_type").isin("LineString", "MultiLineString")).select(
        *keys, F.posexplode(lines).alias("part", "p")
    )
    return _edges(rows, [*keys, "part"])


def _edges(rows: DataFrame, keys: list[str]) -> DataFrame:
    last = F.size("p") - 1
    pairs = F.arrays_zip(F.slice("p", 1, last).alias("a"), F.slice("p", 2, last).alias("b"))
    return rows.select(*keys, F.posexplode(pairs).alias("seq", "e")).select(
        *keys, "seq", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"),
        F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"),
    )


def feature_points(features: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    at = _parsed("Point", 0)
    return features.where(F.col("geometry_type") == "Point").withColumns({x: at[0], y: at[1]})


# File suffix of each administrative level.
LEVEL_SUFFIX = {1: "adm1", 2: "adm2", 3: "adm3"}


def read_boundaries(
    spark: SparkSession, folder: str, level: int = 2, prefix: str = "admin2"
) -> tuple[DataFrame, DataFrame]:
    """Units and their edges from all ``{country}_adm{level}.geojson`` files of
    a folder, in one scan. A missing ISO code is NULL."""
    require(level in LEVEL_SUFFIX, f"unsupported administrative level {level}")
    rows = _features(spark, f"{folder}/*_{LEVEL_SUFFIX[level]}.geojson")
    country = F.regexp_extract("source", rf"([^/]+)_{LEVEL_SUFFIX[level]}\.geojson(?:/[^/]*)?$", 1)  # a file, or a folder of parts
    unit, name, iso = f"{prefix}_id", f"{prefix}_name", f"{prefix}_iso"
    features = rows.select(
        country.alias("country_iso"),
        *[c.alias(out) for c, out in zip(_typed({"shapeID": "string", "shapeName": "string", "shapeISO": "string"}), (unit, name, iso), strict=True)],
        "geometry_type", "coordinates",
    )
    if not features.where(F.col(unit).isNull() | F.col(name).isNull()).isEmpty():
        raise MissingColumns("a boundary feature lacks shapeName or shapeID")
    edges = polygon_edges(features, ["country_iso", unit])
    return features.select("country_iso", unit, name, iso), edges


def to_features(df: DataFrame) -> DataFrame:
    """GeoJSON feature text, one per row, from ``geometry_type`` and
    ``coordinates`` text, or from ``lon, lat``."""
    if "coordinates" in df.columns:
        geometry = F.concat(
            F.lit('{"type":"'), F.col("geometry_type"), F.lit('","coordinates":'), F.col("coordinates"), F.lit("}")
        )
        shape = ("geometry_type", "coordinates", "feature")
    else:
        point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
        geometry, shape = F.to_json(point), ()
    rest = [c for c in df.columns if c not in shape]
    properties = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    return df.select(F.concat(
        F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}")
    ).alias("value"))

import json

import pytest

from conftest import rows
from pyspark.sql import functions as F
from tessera.runtime import MissingColumns
from tessera.sources import geojson, points, tables
from tessera.streaming import rowwise


@pytest.mark.parametrize("suffix", ["csv", "tsv", "jsonl", "parquet"])
def test_round_trip(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None)], "id int, s string, v double")
    path = str(tmp_path / f"t.{suffix}")
    tables.write_table(df, path)
    back = tables.read_table(spark, path, "id int, s string, v double")
    assert rows(back.select("id", "s", "v"), "id") == rows(df, "id")
    assert tables.read_table(spark, path).count() == 2


def test_unknown_formats(spark):
    with pytest.raises(tables.UnsupportedFormat):
        tables.read_table(spark, "x.gpkg")
    with pytest.raises(tables.UnsupportedFormat):
        tables.write_table(spark.range(1), "x.shp")


def test_nested_values_become_text(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], {"k": "v"})], "id int, l array<int>, m map<string,string>")
    assert rows(tables.flatten(df))[0] == {"id": 1, "l": "[1,2]", "m": '{"k":"v"}'}
    tables.write_table(df, str(tmp_path / "n.csv"))
    assert tables.read_table(spark, str(tmp_path / "n.csv")).first()["l"] == "[1,2]"


def test_json_document(spark, tmp_path):
    df = spark.range(1).select(F.create_map(F.lit("A"), F.struct(F.lit(None).cast("double").alias("x"))).alias("cities"))
    tables.write_json(df, str(tmp_path / "doc"))
    document = json.loads(spark.read.text(str(tmp_path / "doc")).first()[0])
    assert document["cities"] == {"A": {"x": None}} and document["generated_at_utc"].endswith("Z")


def feature(name, kind, coordinates, **more):
    return {"type": "Feature", "properties": {"shapeName": name, "shapeID": name[0], **more},
            "geometry": {"type": kind, "coordinates": coordinates}}


def square(x):
    return [[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]


def test_boundaries(spark, tmp_path):
    for country, features in (
        ("KEN", [feature("Alpha", "Polygon", [square(0), square(0.2)], shapeISO="K-A"), feature("Beta", "MultiPolygon", [[square(1)], [square(5)]])]),
        ("TZA", [feature("Gamma", "Polygon", [square(9)])]),
    ):
        (tmp_path / f"{country}_adm2.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    units, edges = geojson.read_boundaries(spark, str(tmp_path), 2)
    assert [(r["country_iso"], r["admin2_name"], r["admin2_iso"]) for r in rows(units, "admin2_id")] == [
        ("KEN", "Alpha", "K-A"), ("KEN", "Beta", None), ("TZA", "Gamma", None)]
    counts = {(r["admin2_id"], r["part"], r["ring"]): r["count"] for r in edges.groupBy("admin2_id", "part", "ring").count().collect()}
    assert counts == {("A", 0, 0): 4, ("A", 0, 1): 4, ("B", 0, 0): 4, ("B", 1, 0): 4, ("G", 0, 0): 4}
    with pytest.raises(ValueError):
        geojson.read_boundaries(spark, str(tmp_path), 7)
    (tmp_path / "UGA_adm1.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"shapeName": "x"}, "geometry": None}]}))
    with pytest.raises(MissingColumns):
        geojson.read_boundaries(spark, str(tmp_path), 1)


def test_geojson_round_trip(spark, tmp_path):
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [
        feature("Road", "LineString", [[0, 0], [1, 1], [2, 1]]), feature("Stop", "Point", [3, 4])]}))
    df = tables.read_table(spark, str(path))
    assert set(df.columns) == {"feature", "shapeName", "shapeID", "geometry_type", "coordinates"}
    assert geojson.line_edges(df, ["shapeID"]).count() == 2
    stop = geojson.feature_points(df).first()
    assert (stop["lon"], stop["lat"]) == (3.0, 4.0)
    tables.write_table(df, str(tmp_path / "out.geojson"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out.geojson")).collect()]
    assert sorted(x["geometry"]["type"] for x in lines) == ["LineString", "Point"]
    points_text = geojson.to_features(spark.createDataFrame([("a", 1.0, 2.0)], "id string, lon double, lat double"))
    assert json.loads(points_text.first()[0])["geometry"] == {"type": "Point", "coordinates": [1.0, 2.0]}


def test_samples_of_all_countries(spark, tmp_path):
    for country, value in (("KEN", "0.5"), ("TZA", "bad")):
        (tmp_path / f"{country}_relative_wealth_index.csv").write_text(f"latitude,longitude,rwi,error\n1,2,{value},0.1\n")
    out = rows(points.read_samples(spark, str(tmp_path)), "country_iso")
    assert [(r["country_iso"], r["rwi"]) for r in out] == [("KEN", 0.5), ("TZA", None)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "X_y.csv").write_text("latitude,longitude\n1,2\n")
    with pytest.raises(MissingColumns):
        points.read_samples(spark, str(tmp_path / "bad"))


def test_layers_and_arrays_prune_partitions(spark, tmp_path):
    df = spark.createDataFrame([("roads", "A", 1), ("roads", "B", 2), ("amenities", "A", 3)], "layer string, city string, osmid int")
    tables.write_layers(df, str(tmp_path / "layers"))
    out = tables.read_layer(spark, str(tmp_path / "layers"), "roads", ["A"])
    assert [r["osmid"] for r in out.collect()] == [1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "layer" in plan.split("PartitionFilters: [")[1]
    assert "osmid" in tables.layer_columns(out, "roads").columns
    cells = spark.createDataFrame([(1, "A", 2.0, "x", None)], "cell_id int, city string, f double, g string, rwi_mean double")
    cells = cells.withColumns({"rwi_bottom_quantile_flag": F.lit(True), "patch": F.array(F.lit(1.0))})
    data = points.array_dataset(cells, ["f", "g"])
    points.write_arrays(data, str(tmp_path / "arrays"))
    row = points.read_arrays(spark, str(tmp_path / "arrays"), ["A"]).first()
    assert row["features"] == [2.0, None] and row["label_mask"] is False and row["classification_target"] == 1.0


def test_row_local_operators_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.0), ("b", "x", 9.0), ("c", "y", None)], "id string, kind string, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = rowwise.read_stream(spark, str(tmp_path / "in"), df.schema)
    assert stream.isStreaming
    conditions = [{"column": "v", "op": ">", "value": 0}]
    labelled = rowwise.mask_and_label(stream, conditions, labels=["id", "kind"], scenario="s")
    for _ in range(2):  # a restart reads nothing twice
        rowwise.write_stream(labelled, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    out = rows(spark.read.parquet(str(tmp_path / "out")), "id")
    assert [(r["scenario"], r["label"]) for r in out] == [("s", "a__missing"), ("s", "b__x")]
    batch = rowwise.mask_and_label(df, conditions, labels=["id", "kind"], scenario="s")
    assert rows(batch, "id") == out


def test_geojson_of_either_form_keeps_types(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "007", 2.5, True, 10.0, 20.0), (2, "b", None, None, 11.0, 21.0)], "id long, name string, v double, ok boolean, lon double, lat double"
    )
    path = str(tmp_path / "points.geojson")
    tables.write_table(df, path)
    back = tables.read_table(spark, path)
    assert {"id": "bigint", "name": "string", "v": "double", "ok": "boolean"}.items() <= dict(back.dtypes).items()
    assert sorted(back.select("id", "name", "v", "ok").collect()) == sorted(df.select("id", "name", "v", "ok").collect())
    feature = {"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}}
    for indent in (None, 2):
        one = tmp_path / f"set{indent}.geojson"
        one.write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}, indent=indent))
        rows = tables.read_table(spark, str(one)).collect()
        assert [(r["feature"], r["a"], r["geometry_type"]) for r in rows] == [(0, 1, "Point"), (1, 1, "Point")]
    (tmp_path / "other.geojson").write_text('{"hello": 1}')
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "other.geojson"))


@pytest.mark.parametrize("indent", [None, 1])
def test_large_collection_is_read_by_many_tasks(spark, tmp_path, indent):
    random = __import__("random").Random(3)
    odd = ["", "}", "{", '"', "\\", '\\"}', "[{", "]}]", "ü}\n{", 'a"b{c}"', "\\\\}"]
    features = [
        {"type": "Feature", "properties": {"id": i, "s": random.choice(odd) + random.choice(odd), "o": {"k": [{"x": "}"}, {}]}, "e": {}},
         "geometry": {"type": "Point", "coordinates": [i / 8, -1.5]}}
        for i in range(1500)
    ]
    head = {"type": "FeatureCollection", "name": 'x}"{[', "crs": {"type": "name", "properties": {"name": "n}"}}}
    one, two = tmp_path / "one.geojson", tmp_path / "two.geojson"
    one.write_text(json.dumps({**head, "features": features}, indent=indent, ensure_ascii=False) + "\n")
    two.write_text(json.dumps({"type": "FeatureCollection", "features": [], "bbox": [1, 2]}, indent=indent))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(one.stat().st_size // 20))
    try:
        pieces = geojson._pieces(spark, str(tmp_path))
        assert pieces.where("value <> ''").select(F.spark_partition_id()).distinct().count() > 10
        out = geojson.read_geojson(spark, str(tmp_path), {"id": "int", "s": "string"}).orderBy("feature").collect()
        assert [(r["feature"], r["id"], r["s"]) for r in out] == [(i, i, f["properties"]["s"]) for i, f in enumerate(features)]
        assert json.loads(out[9]["coordinates"]) == [9 / 8, -1.5]
        two.write_text(one.read_text()[:-40])
        with pytest.raises(ValueError):
            geojson.read_geojson(spark, str(two))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_element_of_a_collection_that_is_no_feature_is_an_error(spark, tmp_path):
    one = tmp_path / "one.geojson"
    one.write_text('{"type": "FeatureCollection", "features": [{"type": "Point", "coordinates": [1, 2]}]}')
    with pytest.raises(Exception, match="is no feature"):
        geojson.read_geojson(spark, str(one), {"id": "int"}).collect()

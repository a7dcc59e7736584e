import numpy as np
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import graph, places
from lodestone.streaming.upsert import upsert

from .test_functions import OSM


def test_delaunay_of_a_square_with_centre():
    edges = places.delaunay(np.array([[0, 0], [10, 0], [10, 10], [0, 10], [5, 5.5]], float))
    assert {(0, 4), (1, 4), (2, 4), (3, 4), (0, 1), (1, 2), (2, 3), (0, 3)} == edges


def test_neighbours_in_tiles_equal_one_triangulation(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 100, (60, 2))
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    want = places.delaunay(xy)
    got = {(min(r), max(r)) for r in places.neighbours(sites, 50.0, 200.0).collect()}
    assert got == want


def test_parents_and_closure(spark):
    rows = [(1, 2, 0, 0, 100, 100), (2, 4, 0, 0, 50, 50), (3, 6, 10, 10, 20, 20), (4, 6, 60, 60, 70, 70)]
    b = spark.createDataFrame(rows, "id long, lvl int, minx int, miny int, maxx int, maxy int")
    up = places.parents(b, 10.0, levels=5)
    assert {r["id"]: r["parent"] for r in up.collect()} == {1: None, 2: 1, 3: 2, 4: 1}
    assert {tuple(r) for r in graph.closure(up, 3).collect()} == {(2, 1, 1), (3, 2, 1), (3, 1, 2), (4, 1, 1)}


def test_merge_places(spark):
    hits = spark.createDataFrame([(1, "Ulm", 9, {"name": "Ulm"}), (1, "Ulm", 8, {"name:en": "Ulm"}), (2, "X", 8, {"name": "Ulm"})], "place long, name string, polygon long, names map<string,string>")
    assert [tuple(r) for r in places.merge_places(hits).collect()] == [(1, 8)]


def test_command_line(spark, tmp_path):
    (tmp_path / "m.osm").write_text(OSM.replace('<way id="12">', '<way id="13"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="building" v="yes"/></way><way id="12">'))
    cli.main(["split", str(tmp_path / "m.osm"), str(tmp_path / "data")])
    cli.main(["join", str(tmp_path / "data"), str(tmp_path / "out"), "--handlers", "out-json", "out-csv"])
    row = spark.read.json(str(tmp_path / "out/out-json")).first()
    assert row["text"] == "7, Elm, Land" and row["id"].startswith("adrpnt-") and row["id"].endswith("-n5--regular")
    cli.main(["tile-buildings", str(tmp_path / "data"), str(tmp_path / "tiles"), "--level", "3"])
    assert spark.read.json(str(tmp_path / "tiles")).first()["xml"].count("<nd ref") == 3


def test_streaming_upsert(spark, tmp_path):
    schema = "id string, ts long, v string"
    for n, rows in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("b", 0, "old")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = {r["id"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out/version=1")).collect()}
    assert got == {"a": "z", "b": "y"} and F is not None

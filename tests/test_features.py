import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import address, features


def test_text(spark):
    row = spark.range(1).select(
        text.fold_ascii(F.lit("Größe Ærø Łódź")), text.street_names_match(F.lit("Élite Street"), F.lit("elite")),
        text.languages(F.create_map(F.lit("name:de"), F.lit("x"), F.lit("name:xx"), F.lit("y"), F.lit("alt_name:fr-CA"), F.lit("z")), ("de", "fr")),
        text.contact(F.create_map(F.lit("contact:phone"), F.lit(" "), F.lit("phone"), F.lit("1")), "phone"), text.part_named(F.array(address.part("hn", F.lit("7"))), "hn"),
        text.names_match(F.lit("x"), F.create_map(F.lit("name"), F.lit("x"))), text.translated(F.create_map(F.lit("name"), F.lit("n")), "de"),
    ).first()
    assert tuple(row) == ("Grosse AEro Lodz", True, ["de", "fr"], "1", "7", True, "n")


def test_selected():
    assert features.selected(["no-pois"]) == {"boundaries", "places", "highways", "addresses"} and features.selected([]) == set(features.TYPES)
    with pytest.raises(ValueError):
        features.selected(["x"])


def test_points_links_and_streets(spark):
    tags = {"building": "yes"}
    nodes = spark.createDataFrame([(1, 0.0, 0.0, {}), (2, float("nan"), 0.0, {})], "id long, lon double, lat double, tags map<string,string>")
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    lines = spark.createDataFrame([(5, [1, 7, 8, 9, 1], ring, 0, tags)], "id long, nodes array<long>, line array<struct<lon:double,lat:double>>, missing int, tags map<string,string>")
    rels = spark.createDataFrame([(9, [ring], {})], "id long, outers array<array<struct<lon:double,lat:double>>>, tags map<string,string>")
    got = features.points(nodes, lines, rels)
    assert {(r["kind"], r["id"], r["lon"], r["lat"]) for r in got.collect()} == {("n", 1, 0.0, 0.0), ("w", 5, 1.0, 1.0), ("r", 9, 1.0, 1.0)}
    assert [tuple(r) for r in features.building_links(lines, got).collect()] == [(5, 1)]
    streets = spark.createDataFrame([(3, [("way", 5, "street"), ("way", 6, "house"), ("node", 7, None)], {"type": "associatedStreet"})], "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>")
    assert {tuple(r) for r in features.associated_streets(streets).collect()} == {(3, 5, "w6"), (3, 5, "n7")}
    junctions = spark.createDataFrame([(1, [5, 6])], "node long, ways array<long>")
    assert [r["way"] for r in features.junction_streets(junctions, lines).first()["refers"]] == [5]


def test_stored_and_merged(spark):
    stored = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "id string, ts long, wkt string")
    shapes = spark.createDataFrame([("a", None), ("b", "own")], "id string, wkt string")
    assert {r["id"]: r["wkt"] for r in features.with_stored(shapes, stored).collect()} == {"a": "new", "b": "own"}
    assert {r["id"]: r["wkt"] for r in features.store_back(stored, spark.createDataFrame([("a", 3, "x")], "id string, ts long, wkt string")).collect()} == {"a": "x"}
    nets = spark.createDataFrame([("n", [1, 2], "z"), ("n", [2, 3], "y")], "id string, members array<long>, record string")
    assert tuple(features.merge_networks(nets).first()) == ("n", [1, 2, 3], "y")


def test_best_address(spark):
    rows = [(1, 10, 1.0, False, False, False, 77), (1, 11, 2.0, False, False, False, 77), (2, 12, 1.0, False, False, False, None), (2, 13, 5.0, False, False, True, None), (3, 14, 9.0, True, True, True, 1), (3, 15, 1.0, False, True, False, 1)]
    df = spark.createDataFrame(rows, "poi long, addr long, d double, same_source boolean, same_building boolean, inside boolean, addr_building long")
    got = {r["poi"]: (r["addr"], r["class"]) for r in features.best_address(df).collect()}
    assert got == {1: (11, "nearestShareBuildingWay"), 2: (13, "contains"), 3: (14, "sameSource")}

import bz2

import pytest
from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.operators import address, build, spatial, streets
from lodestone.sources import osm, sinks


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_stripe_keys(spark):
    assert one(spark, geo.stripe_key(F.lit(55.0)), geo.stripe_key(F.lit(22.0), x10=True)) == ("2350", "20200")


@pytest.mark.parametrize("lon,want", [(0.0, -90.0), (100.0, 10.0), (-100.0, 170.0), (170.0, 80.0), (-170.0, 100.0)])
def test_antimeridian(spark, lon, want):
    assert one(spark, geo.shifted(F.lit(lon)), geo.unshifted(geo.shifted(F.lit(lon)))) == (want, lon)


@pytest.mark.parametrize("lon,lat,want", [(52.0404454, 53.2727444, 3965682819), (55.9561044, 54.7424822, 425079167)])
def test_hilbert(spark, lon, lat, want):
    x = F.floor((F.lit(lon) + 180) * 4294967295 / 360).cast("long")
    y = F.floor((F.lit(lat) + 90) * 4294967295 / 180).cast("long")
    assert one(spark, geo.hilbert(x, y)) == (want,)


def test_ids_and_hashes(spark):
    fid = geo.feature_id(F.lit("adrpnt"), F.lit(425079167), F.lit("w"), F.lit(90213286))
    assert one(spark, fid, geo.java_hash(F.lit("hello")), geo.java_hash(F.lit("Elite Road 12"))) == ("adrpnt-0425079167-w90213286", 99162322, _hash("Elite Road 12"))
    assert one(spark, geo.house_number(F.lit("12A")), geo.house_number(F.lit("x")), geo.hstore(F.create_map(F.lit("a"), F.lit("b")))) == (12, None, '"a"=>"b"')


def _hash(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def _ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])


SQUARE = ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))


def test_polygons(spark):
    inside = [geo.in_ring(F.lit(x), F.lit(y), _ring(*SQUARE), inc) for x, y, inc in ((5.0, 5.0, True), (10.0, 5.0, True), (10.0, 5.0, False), (11.0, 5.0, True))]
    hole = F.array(_ring((2, 2), (8, 2), (8, 8), (2, 8), (2, 2)))
    assert one(spark, *inside, build.polygon_area(F.array(_ring(*SQUARE)), hole), geo.in_polygon(F.lit(5.0), F.lit(5.0), F.array(_ring(*SQUARE)), hole)) == (True, True, False, False, 64.0, False)


def test_point_along(spark):
    at = geo.point_along(_ring((0, 0), (4, 0), (4, 4)), F.lit(6.0))
    assert one(spark, at["lon"], at["lat"], geo.line_length(_ring((0, 0), (4, 0), (4, 4)))) == (4.0, 2.0, 8.0)


def test_boundary_rows(spark):
    """One row grows; equal levels start a copy; higher boundaries join the rows whose last they hold."""
    b = [(40, 1, [9]), (40, 2, [8]), (80, 9, []), (80, 8, [])]
    rows = F.array(*[F.struct(F.lit(lvl).alias("lvl"), F.lit(i).cast("long").alias("id"), F.array(*map(F.lit, ins)).cast("array<bigint>").alias("inside")) for lvl, i, ins in b])
    ids = F.transform(streets.boundary_rows(rows), lambda r: F.transform(r, lambda x: x["id"]))
    assert one(spark, ids)[0] == [[1, 9], [2], [1, 8]]


def test_filter_and_languages(spark):
    parts = F.array(address.part("street", F.lit("Ave")), address.part("boundary:6", F.lit("Ave District")), address.part("boundary:4", F.lit("Great Ave District")))
    langs = address.languages_of_all(F.array(geo.lits(["de", "en"]), geo.lits(["en", "fr"])))
    assert one(spark, address.filter_levels(parts, geo.lits([20, 90, 110]), geo.lits(["x"])), langs) == (["Ave", "Ave District"], ["en"])


def test_nearest_finds_far_points(spark):
    left = spark.createDataFrame([(1, 0, 0), (2, 500_000, 0)], "id long, x long, y long")
    right = spark.createDataFrame([(7, 3, 4), (8, 4, 3), (9, 100_000, 0)], "rid long, rx long, ry long")
    got = {r["id"]: (r["rid"], r["d2"]) for r in spatial.nearest(left, right, 10, 1_000_000).collect()}
    assert got == {1: (7, 25), 2: (9, 400_000**2)}


OSM = """<?xml version='1.0'?><osm>
<node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="10"/><node id="3" lat="10" lon="10"/><node id="4" lat="10" lon="0"/>
<node id="5" lat="5" lon="5" timestamp="2014-01-01T00:00:00Z"><tag k="addr:housenumber" v="7"/><tag k="addr:street" v="Elm"/></node>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/></way>
<way id="11"><nd ref="3"/><nd ref="4"/><nd ref="1"/></way>
<way id="12"><nd ref="1"/><nd ref="99"/></way>
<relation id="20"><member type="way" ref="10" role="outer"/><member type="way" ref="11" role=""/><tag k="boundary" v="administrative"/><tag k="admin_level" v="4"/><tag k="name" v="Land"/></relation>
<relation id="21"><member type="way" ref="12" role="outer"/><tag k="boundary" v="administrative"/><tag k="admin_level" v="6"/></relation>
</osm>"""


def test_osm_to_addresses(spark, tmp_path):
    path = str(tmp_path / "map.osm.bz2")
    with bz2.open(path, "wt") as f:
        f.write(OSM)
    nodes, ways, rels = osm.nodes(spark, path), osm.ways(spark, path), osm.relations(spark, path)
    assert osm.youngest(nodes).first()["youngest"].year == 2014
    lines = build.way_lines(ways, nodes)
    assert {r["id"]: r["missing"] for r in lines.collect()} == {10: 0, 11: 0, 12: 1}
    bounds = build.relation_polygons(rels.filter(osm.is_boundary(F.col("tags"))), lines, (("outers", osm.outer_refs(F.col("members"))), ("inners", osm.inner_refs(F.col("members")))))
    none = F.array().cast(build.RINGS)
    area = bounds.withColumn("area", F.when(F.col("outers").isNotNull(), build.polygon_area(F.col("outers"), F.col("inners"))))
    assert {r["id"]: r["area"] for r in area.collect()} == {20: 100.0, 21: None}
    boxed = bounds.filter("outers is not null").withColumn("b", build.bbox(F.col("outers"))).select("outers", "inners", F.col("tags.name").alias("bname"), "b.*")
    points = nodes.filter(osm.is_address(F.col("tags"))).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "tags")
    hit = spatial.points_in_boxes(points, boxed, 2.5).filter(geo.in_polygon(F.col("x"), F.col("y"), F.col("outers"), F.coalesce("inners", none)))
    row = address.schemes(hit).select("id", address.text(F.array(address.part("hn", F.col("hn")), address.part("street", F.col("street")), address.part("boundary:4", F.col("bname"))), "hn_street_city").alias("text"))
    assert [tuple(r) for r in row.collect()] == [(5, "7, Elm, Land")]
    left = osm.drop_listed(nodes, "n", spark.createDataFrame([("n5",)], "ref string"))
    assert left.count() == 4
    catalog = spark.createDataFrame([("house", "b", "addr:street", "*")], "class string, branch string, tag_key string, tag_val string")
    assert [r["classes"] for r in osm.poi_classes(nodes, catalog).collect()] == [["house"]]


def test_stitch_shapes():
    line = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    assert len(build.stitch([line((1, 1), (1, 2), (2, 2)), line((2, 2), (2, 1), (1, 1))])) == 1
    assert len(build.stitch([line(*SQUARE), line((20, 0), (30, 0), (30, 10), (20, 0))])) == 2
    assert build.stitch([line((0, 0), (1, 1))]) == []


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", "x", None), ("a", "y", "z"), ("a", "y", "z")], "id string, hhash string, v string")
    sinks.write_all(rows, {str(tmp_path / "j"): sinks.JsonSink("id"), str(tmp_path / "c"): sinks.CsvSink([["v", "hhash"], "id"]), str(tmp_path / "t"): sinks.TextSink()})
    assert [r["id"] for r in spark.read.json(str(tmp_path / "j")).orderBy("id").collect()] == ["a", "b"]
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()) == ["x\tb", "z\ta"]
    stats = sinks.tag_statistics(spark.createDataFrame([("c", {"k": "v"}), ("c", {"k": "v"})], "class string, tags map<string,string>"))
    assert stats.first()["value"] == '{"name":"c","tags_info":{"k":{"total":2,"values":{"v":2}}}}'
    assert sinks.parse_options(["x", "sort=id", "out a b"], {"sort", "out"}) == {"": ["x"], "sort": ["id"], "out": ["a", "b"]}
    nodes = spark.createDataFrame([("t", "node", 1, 2.0, 3.0, None, None, {"k": "<v>"})], "tile string, kind string, id long, lat double, lon double, refs array<long>, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>")
    assert '<node id="1" version="1" lat="2.0000000" lon="3.0000000"><tag k="k" v="&lt;v&gt;"/></node>' in sinks.tiles(nodes).first()["xml"]

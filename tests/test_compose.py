"""Ids, canonical texts, short texts and lines cut by length, against values worked out by hand or by plain Python."""

import hashlib

from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.operators import compose


def _java(text):
    h = 0
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_hashes(spark):
    texts = ["", "a", "Ünïcode", "🙂 smile", "x" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", geo.java_hash(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in got} == {t: _java(t) for t in texts}
    bounds = [("b2", {"admin_level": "2", "name": "Land"}), ("b9", {"admin_level": "9"}), ("p1", {"place": "town", "name": "T"})]
    df = spark.createDataFrame([(1, bounds), (2, [])], "id int, b array<struct<id:string,tags:map<string,string>>>")
    rows = df.select("id", compose.boundaries_hash(compose.by_size(F.col("b"))).alias("h"), F.transform(compose.boundary_row(F.col("b"), F.get("b", F.lit(2))), lambda p: p["lvl"]).alias("l")).collect()
    assert [(r["h"], r["l"]) for r in rows] == [(_java("p1b2"), ["boundary:2", "place:town", "place:town"]), (0, [])]
    df = spark.createDataFrame([(-5, ["Main St", "Main", "Old Main St"])], "h int, n array<string>")
    assert df.select(compose.network_id(F.col("h"), F.col("n")).alias("i")).first()["i"] == "hghnet-m5-" + str(_java("old main st")).replace("-", "m")


def test_short_text(spark):
    df = spark.createDataFrame([([("boundary:4", "Paris Region"), ("street", "Paris"), ("place:city", "Paris"), ("boundary:2", "France"), ("boundary:6", "Gone")],)], "p array<struct<lvl:string,name:string>>")
    df = df.select(F.transform("p", lambda p: compose.part(p["lvl"], p["name"])).alias("p"))
    by = compose.Strategy(skip=("boundary:6",))
    got = df.select(compose.joined(compose.arranged(compose.kept_parts(F.col("p"), by), by.order)).alias("t")).first()["t"]
    assert got == "Paris, Paris, France"


def test_canonical_and_ids(spark):
    df = spark.createDataFrame([(2, ["b", "a"], {"y": "1", "timestamp": "t"}, None)], "z int, a array<string>, m map<string,string>, n string")
    assert compose.with_md5(df).first()["md5"] == hashlib.md5(b'{"a":{[a,b]}"m":{{"y":{1}}}"z":{2}}').hexdigest()
    df = spark.createDataFrame([("adrpnt-0000000012-n5--regular",), ("hghway-0000000012-w5",)], "i string").select(compose.id_parts(F.col("i")).alias("p"))
    assert [(r["p"]["type"], r["p"]["parts"], r["p"]["tail"]) for r in df.collect()] == [("adrpnt", ["0000000012", "n5"], "regular"), ("hghway", ["0000000012", "w5"], None)]


def test_line_between(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)],)], "l array<struct<lon:double,lat:double>>")
    got = df.select(geo.line_between(F.col("l"), F.lit(1.0), F.lit(5.5)).alias("p")).first()["p"]
    assert [tuple(x) for x in got] == [(1.0, 0.0), (4.0, 0.0), (4.0, 1.5)]

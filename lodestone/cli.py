"""Command line: split, join, synchronize, diff, tile-buildings."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .operators import address, build, spatial, versions
from .session import session
from .sources import osm, sinks


def addresses(spark: SparkSession, data: str, order: str = "hn_street_city") -> DataFrame:
    """Address rows of a split dump: points in their boundaries, schemes and composed texts."""
    read = lambda name: spark.read.parquet(f"{data}/{name}")
    lines = build.way_lines(read("ways"), read("nodes"))
    shapes = build.relation_polygons(read("relations").filter(osm.is_boundary(F.col("tags"))), lines, (("outers", osm.outer_refs(F.col("members"))), ("inners", osm.inner_refs(F.col("members")))))
    none = F.array().cast(build.RINGS)
    boxed = shapes.filter(F.size("outers") > 0).select(F.col("id").alias("bid"), F.concat(F.lit("boundary:"), F.col("tags.admin_level")).alias("lvl"), F.col("tags.name").alias("bname"), "outers", F.coalesce("inners", none).alias("inners"), build.bbox(F.col("outers")).alias("b")).select("*", "b.*").drop("b")
    points = read("nodes").filter(osm.is_address(F.col("tags"))).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "tags")
    hit = spatial.points_in_boxes(points, boxed, 0.1).filter(geo.in_polygon(F.col("x"), F.col("y"), F.col("outers"), F.col("inners")))
    bounds = hit.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("lvl", F.col("bname").alias("name")))).alias("bounds"))
    rows = address.schemes(points.join(bounds, "id", "left"))
    own = F.array(address.part("hn", F.col("hn")), address.part("street", F.col("street")))
    parts = F.concat(own, F.coalesce("bounds", F.array().cast("array<struct<lvl:string,name:string>>")))
    fid = geo.feature_id(F.lit("adrpnt"), geo.hilbert(F.floor((F.col("x") + 180) * 4294967295 / 360).cast("long"), F.floor((F.col("y") + 90) * 4294967295 / 180).cast("long")), F.lit("n"), F.col("id"))
    return rows.select(F.concat(fid, F.lit("--"), "scheme").alias("id"), F.lit("adrpnt").alias("ftype"), "scheme", address.text(parts, order).alias("text"), F.round("x", 8).alias("lon"), F.round("y", 8).alias("lat"), parts.alias("parts"))


def building_tiles(spark: SparkSession, data: str, level: int) -> DataFrame:
    """OSM documents of building ways and their nodes, by slippy-map tile."""
    zoom = level if 0 <= level <= 22 else 13
    ways = spark.read.parquet(f"{data}/ways").filter(osm.is_building(F.col("tags")))
    refs = ways.select(F.col("id").alias("way"), F.explode("nodes").alias("id"))
    at = refs.join(spark.read.parquet(f"{data}/nodes"), "id")
    box = at.groupBy("way").agg(((F.min("lon") + F.max("lon")) / 2).alias("x"), ((F.min("lat") + F.max("lat")) / 2).alias("y"))
    tile = box.select("way", F.concat_ws("/", F.lit(str(zoom)), geo.tile_x(F.col("x"), zoom).cast("string"), geo.tile_y(F.col("y"), zoom).cast("string")).alias("tile"))
    members = F.lit(None).cast("array<struct<type:string,ref:bigint,role:string>>").alias("members")
    nodes = at.join(tile, "way").select("tile", F.lit("node").alias("kind"), "id", "lat", "lon", F.lit(None).cast("array<bigint>").alias("refs"), members, "tags").dropDuplicates(["tile", "id"])
    whole = ways.join(tile, ways["id"] == tile["way"]).select("tile", F.lit("way").alias("kind"), "id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.col("nodes").alias("refs"), members, "tags")
    return sinks.tiles(nodes.unionByName(whole))


def main(words: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in {"split": ("osm", "out"), "join": ("data", "out"), "synchronize": ("rows", "out"), "diff": ("old", "new", "out"), "tile-buildings": ("data", "out")}.items():
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a)
        if name == "split":
            sub.add_argument("--append", action="store_true")
        if name == "join":
            sub.add_argument("--addr-order", default="hn_street_city", choices=sorted(address.ORDERS))
            sub.add_argument("--handlers", nargs="+", default=["out-json"], choices=["out-json", "out-csv", "out-print"])
        if name == "tile-buildings":
            sub.add_argument("--level", type=int, default=12)
    got = parser.parse_args(words)
    spark = session()
    if got.command == "split":
        osm.split(spark, got.osm, got.out, got.append)
    elif got.command == "join":
        kinds = {"out-json": sinks.JsonSink("id"), "out-csv": sinks.CsvSink(["id", "scheme", "text", "lon", "lat"], header=True), "out-print": sinks.TextSink()}
        sinks.write_all(addresses(spark, got.data, got.addr_order), {f"{got.out}/{h}": kinds[h] for h in got.handlers})
    elif got.command == "synchronize":
        versions.synchronize(spark.read.json(got.rows), "id", "timestamp").write.json(got.out, compression="gzip")
    elif got.command == "diff":
        read = lambda p: spark.read.schema("id string, timestamp timestamp, md5 string, type string").json(p).filter("type is null or type <> 'mtainf'").select("id", F.col("timestamp").alias("ts"), F.col("md5").alias("hash")).dropDuplicates(["id"])
        versions.diff_lines(versions.diff(read(got.old), read(got.new))).write.text(got.out)
    else:
        building_tiles(spark, got.data, got.level).write.json(got.out)


if __name__ == "__main__":
    main()

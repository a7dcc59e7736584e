"""Features from nodes, ways and relations: points with their full geometry, links, stored boundaries, best addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial

TYPES = ("boundaries", "places", "highways", "addresses", "pois")


def selected(wanted: list[str]) -> set[str]:
    """Feature types to build: names of TYPES, all, or no-pois."""
    out: set[str] = set()
    for w in wanted or ["all"]:
        out |= set(TYPES) if w == "all" else set(TYPES) - {"pois"} if w == "no-pois" else {w}
    if out - set(TYPES):
        raise ValueError(f"unknown feature types: {sorted(out - set(TYPES))}")
    return out


def line_centroid(line: Column) -> Column:
    """Centre of a line's segments weighed by their length; the first vertex of a line without length."""
    edges = F.slice(geo._edges(line), 1, F.greatest(F.size(line) - 1, F.lit(0)))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(a: Column, e: Column) -> Column:
        d = F.hypot(e["b"]["lon"] - e["a"]["lon"], e["b"]["lat"] - e["a"]["lat"])
        return F.struct((a["w"] + d).alias("w"), (a["x"] + d * (e["a"]["lon"] + e["b"]["lon"]) / 2).alias("x"), (a["y"] + d * (e["a"]["lat"] + e["b"]["lat"]) / 2).alias("y"))

    total = F.aggregate(edges, zero, step)
    weight = F.nullif(total["w"], F.lit(0.0))
    return F.struct(F.coalesce(total["x"] / weight, F.get(line, F.lit(0))["lon"]).alias("lon"), F.coalesce(total["y"] / weight, F.get(line, F.lit(0))["lat"]).alias("lat"))


def points(nodes: DataFrame, lines: DataFrame, polygons: DataFrame) -> DataFrame:
    """kind (n, w, r), id, lon, lat, tags and rings of objects: nodes themselves, the centre of a way's line or a relation's first ring.

    lines: ways with `line` and `missing`; polygons: relations with `outers`.
    Objects without a finite centre are left out.
    """
    none = F.lit(None).cast("array<array<struct<lon:double,lat:double>>>")
    own = nodes.select(F.lit("n").alias("kind"), "id", "lon", "lat", "tags", none.alias("rings"))
    closed = (F.size("line") > 3) & (F.get("line", F.lit(0)) == F.element_at("line", -1)) & (F.col("missing") == 0)
    centre = F.when(closed, line_centroid(F.col("line"))).otherwise(F.get("line", F.lit(0)))
    ways = lines.filter(F.size("line") > 0).withColumn("c", centre).select(F.lit("w").alias("kind"), "id", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"), "tags", F.when(closed, F.array("line")).alias("rings"))
    rels = polygons.filter(F.size("outers") > 0).withColumn("c", line_centroid(F.get("outers", F.lit(0)))).select(F.lit("r").alias("kind"), "id", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"), "tags", F.col("outers").alias("rings"))
    every = own.unionByName(ways).unionByName(rels)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) <= 360)
    return every.filter(finite("lon") & finite("lat"))


def building_links(ways: DataFrame, objects: DataFrame) -> DataFrame:
    """way and node of each object node on a building's contour; the repeated last node of a contour does not count."""
    contour = ways.filter(F.col("tags.building").isNotNull() & (F.get("nodes", F.lit(0)) == F.element_at("nodes", -1)) & (F.size("nodes") > 1))
    refs = contour.select(F.col("id").alias("way"), F.explode(F.slice("nodes", F.lit(1), F.size("nodes") - 1)).alias("node"))
    return refs.join(objects.filter("kind = 'n'").select(F.col("id").alias("node")), "node").select("way", "node").distinct()


def associated_streets(relations: DataFrame) -> DataFrame:
    """relation, building (kind letter and id) and street way of associatedStreet relations."""
    street = lambda m: (m["type"] == "way") & (F.coalesce(m["role"], F.lit("")) != "house")
    rel = relations.filter("tags.type = 'associatedStreet'").select(F.col("id").alias("relation"), F.filter("members", street).alias("ways"), F.filter("members", lambda m: ~street(m)).alias("houses"))
    each = rel.select("relation", F.explode("ways").alias("w"), "houses").select("relation", F.col("w.ref").alias("way"), F.explode("houses").alias("h"))
    return each.select("relation", "way", F.concat(F.substring("h.type", 1, 1), F.col("h.ref").cast("string")).alias("building"))


def junction_streets(junctions: DataFrame, streets: DataFrame) -> DataFrame:
    """node and the references (way, tags as JSON) of the streets that meet there."""
    each = junctions.select("node", F.explode("ways").alias("way"))
    return each.join(streets.select(F.col("id").alias("way"), "tags"), "way").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("way", F.to_json("tags").alias("tags")))).alias("refers"))


def with_stored(shapes: DataFrame, stored: DataFrame) -> DataFrame:
    """Shapes (id, wkt) with the newest stored WKT where they have none."""
    newest = stored.groupBy("id").agg(F.max_by("wkt", "ts").alias("_wkt"))
    return shapes.join(newest, "id", "left").withColumn("wkt", F.coalesce("wkt", "_wkt")).drop("_wkt")


def store_back(stored: DataFrame, built: DataFrame) -> DataFrame:
    """The stored table with newly built geometries added, the newest of each id."""
    return stored.select("id", "ts", "wkt").unionByName(built.select("id", "ts", "wkt")).groupBy("id").agg(F.max("ts").alias("ts"), F.max_by("wkt", "ts").alias("wkt"))


def merge_networks(rows: DataFrame) -> DataFrame:
    """Networks of one id from several parts: all members once, fields of the smallest record."""
    return rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"), F.min("record").alias("record"))


def best_address(candidates: DataFrame, most: int = 10) -> DataFrame:
    """candidates: poi, addr, d, same_source, same_building, inside, addr_building.  The best address of each POI, with its d.

    Among its nearest: of the same object, in or around it, on the same
    building, on the building of the nearest one, else the nearest.
    """
    order = Window.partitionBy("poi").orderBy("d", "addr")
    near = candidates.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    first = F.first("addr_building").over(order)
    shared = F.col("addr_building").isNotNull() & (F.col("addr_building") == first) & (F.col("rn") > 1)
    kind = F.when(F.col("same_source"), 0).when(F.col("inside"), 1).when(F.col("same_building"), 2).when(shared, 3).otherwise(F.when(F.col("rn") == 1, 4))
    ranked = near.withColumn("kind", kind).filter("kind is not null").groupBy("poi").agg(F.min(F.struct("kind", "rn", "addr", "d")).alias("b"))
    return ranked.select("poi", "b.addr", "b.d", F.element_at(geo.lits(["sameSource", "contains", "shareBuildingWay", "nearestShareBuildingWay", "nearest"]), F.col("b.kind") + 1).alias("class"))


def with_required(rows: DataFrame, boundaries: str, required: list[int]) -> DataFrame:
    """Rows of which some joined boundary (an array of ids) is required."""
    return rows.filter(F.arrays_overlap(boundaries, F.lit(required).cast("array<bigint>")))


def append_common(rows: DataFrame, common: DataFrame, most: int = 10_000) -> DataFrame:
    """rows with `common`: the list of all common objects (structs), which comes from a file of a user; none if there are no objects.

    The list goes to every row, so more than `most` objects are an error.
    """
    if common.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} common objects")
    one = common.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("common")).filter(F.size("common") > 0)
    return rows.crossJoin(F.broadcast(one))


def absorbed_points(points: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """area and point of point objects strictly inside an area object (a box) of their class.  points: id, cls, x, y; areas: id, cls, box."""
    boxes = areas.select(F.col("id").alias("area"), F.col("cls").alias("_cls"), "minx", "miny", "maxx", "maxy")
    strict = (F.col("x") > F.col("minx")) & (F.col("x") < F.col("maxx")) & (F.col("y") > F.col("miny")) & (F.col("y") < F.col("maxy"))
    hits = spatial.points_in_boxes(points.select("id", "cls", "x", "y"), boxes, size)
    return hits.filter(strict & (F.col("cls") == F.col("_cls")) & (F.col("area") != F.col("id"))).select("area", F.col("id").alias("point"))


def merge_pois(pois: DataFrame, hits: DataFrame) -> DataFrame:
    """pois (id, x, y, cls, tags) without those that areas absorb; an area gets the tags of its points that it lacks, and moves to the last point's place."""
    moved = hits.join(pois.select(F.col("id").alias("point"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("tags").alias("ptags")), "point")
    entries = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("point", F.map_entries("ptags").alias("e")))), lambda s: s["e"]))
    gained = moved.groupBy(F.col("area").alias("id")).agg(F.count(F.lit(1)).alias("absorbed"), F.max_by(F.struct("px", "py"), "point").alias("at"), F.map_from_entries(entries).alias("more"))
    kept = pois.join(hits.select(F.col("point").alias("id")).distinct(), "id", "left_anti").join(gained, "id", "left")
    tags = F.when(F.col("more").isNull(), F.col("tags")).otherwise(F.map_concat("more", "tags"))
    return kept.select("id", F.coalesce("at.px", "x").alias("x"), F.coalesce("at.py", "y").alias("y"), "cls", tags.alias("tags"), F.coalesce("absorbed", F.lit(0)).cast("long").alias("absorbed"))


def counters(tables: dict[str, DataFrame]) -> DataFrame:
    """Features by type: kind and n."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)

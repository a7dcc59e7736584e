"""What features take from other tables: neighbours, buildings, references; boundaries by level, lines of the city index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compose import refer


def neighbour_places(places: DataFrame, cells: DataFrame) -> DataFrame:
    """places (id) with `neighbour_cities` of their cells (id with the prefix of cells, neighbour_cities); null without a cell."""
    of_place = F.replace(F.col("id"), F.lit("plcdln"), F.lit("plcpnt"))
    return places.join(cells.select(of_place.alias("id"), "neighbour_cities"), "id", "left")


def with_building(objects: DataFrame, links: DataFrame, buildings: DataFrame) -> DataFrame:
    """objects (kind, osm_id) with `building` (id, properties): of node objects on contours of buildings, that of the smallest way.

    links: way and node; buildings: osm_id, id and tags.  Objects that are no nodes have none.
    """
    first = links.groupBy("node").agg(F.min("way").alias("way"))
    found = first.join(buildings.select(F.col("osm_id").alias("way"), refer(F.struct("id", "tags")).alias("building")), "way").select(F.lit("n").alias("kind"), F.col("node").alias("osm_id"), "building")
    return objects.join(found, ["kind", "osm_id"], "left")


def with_nearby(rows: DataFrame, near: DataFrame, key: str, distance: str, value: str, most: int, name: str) -> DataFrame:
    """rows with `name`: references of the nearest `most` objects (column value: struct id, tags), by distance to a millionth of a degree, then id; empty without any."""
    entry = F.struct(F.round(distance, 6).alias("d"), F.col(f"{value}.id").alias("id"), F.map_entries(f"{value}.tags").alias("e"))
    lists = near.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, most).alias("_n"))
    refs = F.transform("_n", lambda x: F.struct(x["id"].alias("id"), F.map_from_entries(x["e"]).alias("properties")))
    none = F.array().cast("array<struct<id:string,properties:map<string,string>>>")
    return rows.join(lists.select(key, refs.alias(name)), key, "left").withColumn(name, F.coalesce(name, none))


def by_level(boundaries: DataFrame) -> DataFrame:
    """Boundaries (id, tags) with a positive admin level `lvl`, by level, then id downwards."""
    level = F.expr("try_cast(tags['admin_level'] AS INT)")
    return boundaries.withColumn("lvl", level).filter("lvl > 0").orderBy("lvl", F.desc("id"))


def levels(boundaries: DataFrame) -> DataFrame:
    """lvl and n: boundaries of each admin level."""
    level = F.expr("try_cast(tags['admin_level'] AS INT)")
    return boundaries.select(level.alias("lvl")).filter("lvl > 0").groupBy("lvl").agg(F.count(F.lit(1)).alias("n"))


def city_index(cities: DataFrame) -> DataFrame:
    """Lines of the city index: node, longitude, latitude, kind (city or neighbour) and the record, by tabs.  cities: osm_id, lon, lat, neighbour (boolean), body."""
    kind = F.when(F.col("neighbour"), "neighbour").otherwise("city")
    return cities.select(F.concat_ws("\t", F.col("osm_id").cast("string"), F.col("lon").cast("string"), F.col("lat").cast("string"), kind, "body").alias("value"))


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Parts of one table, by column names; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

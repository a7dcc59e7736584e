"""Geometry of ways and relations from their references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

RINGS = "array<array<struct<lon:double,lat:double>>>"


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with `line`, their nodes' coordinates in order; missing nodes are left out and counted in `missing`."""
    refs = ways.select("id", F.posexplode("nodes").alias("pos", "node"))
    found = refs.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node")
    lines = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("l"))
    line = F.transform("l", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
    return ways.join(lines, "id", "left").withColumn("line", F.coalesce(line, F.array().cast("array<struct<lon:double,lat:double>>"))).drop("l").withColumn("missing", F.size("nodes") - F.size("line"))


def stitch(lines: list) -> list:
    """Closed rings out of open and closed lines by joining equal ends; open rests are left out."""
    rings, rest = [], []
    for line in ([(p["lon"], p["lat"]) for p in x] for x in lines):
        (rings if len(line) > 3 and line[0] == line[-1] else rest).append(line)
    while rest:
        own = rest.pop()
        grown = True
        while grown and own[0] != own[-1]:
            grown = False
            for i, other in enumerate(rest):
                for cand in (other, other[::-1]):
                    if cand[0] == own[-1]:
                        own, grown = own + cand[1:], True
                    elif cand[-1] == own[0]:
                        own, grown = cand + own[1:], True
                    if grown:
                        break
                if grown:
                    rest.pop(i)
                    break
        if len(own) > 3 and own[0] == own[-1]:
            rings.append(own)
    return [[{"lon": x, "lat": y} for x, y in r] for r in rings]


def rings(lines: Column | str) -> Column:
    """Rings of each relation's member lines; a relation's members are one object, bounded by the data model."""

    @F.pandas_udf(RINGS)
    def udf(column: pd.Series) -> pd.Series:
        return column.map(lambda x: stitch(x) if x is not None else None)

    return udf(lines)


def relation_polygons(relations: DataFrame, lines: DataFrame, members: tuple[tuple[str, Column], ...]) -> DataFrame:
    """id and, for each (name, members), its rings; null rings of relations with an incomplete way, which a stored geometry may replace."""
    out = relations
    for name, chosen in members:
        refs = relations.select("id", F.explode(chosen).alias("m")).select("id", F.col("m.ref").alias("way"))
        got = refs.join(lines.select(F.col("id").alias("way"), "line", "missing"), "way", "left")
        whole = F.min(F.coalesce(F.col("missing") == 0, F.lit(False)).cast("int")) == 1
        each = got.groupBy("id").agg(whole.alias("whole"), F.collect_list("line").alias("lines"))
        out = out.join(each.select("id", F.when(F.col("whole"), rings("lines")).alias(name)), "id", "left")
    return out


def polygon_area(outers: Column, inners: Column) -> Column:
    total = lambda rs: F.aggregate(F.coalesce(rs, F.array().cast(RINGS)), F.lit(0.0), lambda s, r: s + geo.ring_area(r))
    return total(outers) - total(inners)


def bbox(outers: Column) -> Column:
    at = lambda f, c: f(F.flatten(F.transform(outers, lambda r: F.transform(r, lambda p: p[c]))))
    return F.struct(at(F.array_min, "lon").alias("minx"), at(F.array_min, "lat").alias("miny"), at(F.array_max, "lon").alias("maxx"), at(F.array_max, "lat").alias("maxy"))

"""Places: neighbours by Delaunay triangulation, merging of place nodes with place polygons, boundary parents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import cells


def delaunay(points: np.ndarray) -> set[tuple[int, int]]:
    """Edges of the Delaunay triangulation of distinct points, by insertion."""
    n = len(points)
    if n < 2:
        return set()
    mid, span = points.mean(axis=0), max(1.0, float(np.ptp(points, axis=0).max())) * 1e4
    p = np.vstack([points, mid + [[-span, -span], [span, -span], [0, span]]])
    triangles = [(n, n + 1, n + 2)]
    for i in range(n):
        t = np.array(triangles)
        a, b, c = p[t[:, 0]] - p[i], p[t[:, 1]] - p[i], p[t[:, 2]] - p[i]
        det = (a**2).sum(1) * (b[:, 0] * c[:, 1] - c[:, 0] * b[:, 1]) - (b**2).sum(1) * (a[:, 0] * c[:, 1] - c[:, 0] * a[:, 1]) + (c**2).sum(1) * (a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1])
        bad = det > 0
        edges: dict[tuple[int, int], tuple[int, int]] = {}
        for x, y, z in t[bad].tolist():
            for e in ((x, y), (y, z), (z, x)):
                if edges.pop((e[1], e[0]), None) is None:
                    edges[e] = e
        triangles = [tuple(x) for x in t[~bad].tolist()] + [(x, y, i) for x, y in edges]
    return {(min(e), max(e)) for t in triangles for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])) if max(e) < n}


def neighbours(sites: DataFrame, size: float, halo: float) -> DataFrame:
    """sites: id, x, y.  id and neighbour: Delaunay edges, found in tiles of `size` with the sites within `halo` around.

    An edge is told by the tile that holds its smaller site, so it comes once.
    Edges longer than the halo can differ from those of one triangulation.
    """
    around = sites.withColumn("cx", F.explode(cells(F.col("x") - halo, F.col("x") + halo, size))).withColumn("cy", F.explode(cells(F.col("y") - halo, F.col("y") + halo, size)))

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("id").drop_duplicates(["x", "y"]).reset_index(drop=True)
        home = (np.floor(own["x"] / size) == own["cx"]) & (np.floor(own["y"] / size) == own["cy"])
        pairs = [(own["id"][a], own["id"][b]) for a, b in delaunay(own[["x", "y"]].to_numpy(float)) if home[a]]
        return pd.DataFrame(pairs, columns=["id", "neighbour"])

    kind = sites.schema["id"].dataType.simpleString()
    one = around.groupBy("cx", "cy").applyInPandas(tile, f"id {kind}, neighbour {kind}")
    return one.union(one.select("neighbour", "id")).distinct()


def merge_places(hits: DataFrame) -> DataFrame:
    """hits: place, name, polygon, names (map), of places inside polygons.  The first polygon of each place that bears its name."""
    named = hits.filter(F.array_contains(F.map_values(F.map_filter("names", lambda k, v: F.contains(k, F.lit("name")))), F.col("name")))
    return named.withColumn("rn", F.row_number().over(Window.partitionBy("place").orderBy("polygon"))).filter("rn = 1").select("place", "polygon")


def parents(boundaries: DataFrame, size: float, levels: int = 4) -> DataFrame:
    """boundaries: id, lvl and a box.  id and parent: the deepest boundary of the levels just above that covers it.

    The cells of a child's centre meet the cells of parents; covering is told by boxes,
    exact polygons filter further where they are at hand.
    """
    up = boundaries.select(F.col("id").alias("parent"), F.col("lvl").alias("plvl"), *[F.col(c).alias(f"p{c}") for c in ("minx", "miny", "maxx", "maxy")])
    up = up.withColumn("_cx", F.explode(cells(F.col("pminx"), F.col("pmaxx"), size))).withColumn("_cy", F.explode(cells(F.col("pminy"), F.col("pmaxy"), size)))
    low = boundaries.withColumns({"_cx": F.floor((F.col("minx") + F.col("maxx")) / 2 / size).cast("long"), "_cy": F.floor((F.col("miny") + F.col("maxy")) / 2 / size).cast("long")})
    covers = (F.col("pminx") <= F.col("minx")) & (F.col("pmaxx") >= F.col("maxx")) & (F.col("pminy") <= F.col("miny")) & (F.col("pmaxy") >= F.col("maxy"))
    near = (F.col("plvl") < F.col("lvl")) & (F.col("plvl") > F.col("lvl") - levels)
    found = low.join(up, ["_cx", "_cy"]).filter(covers & near).groupBy("id").agg(F.max(F.struct("plvl", "parent")).alias("m"))
    return boundaries.select("id").join(found.select("id", "m.parent"), "id", "left")

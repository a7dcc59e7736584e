"""Street operators: junctions, links, networks, interpolation, rows of boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components


def junctions(ways: DataFrame, way_col: str = "way", node_col: str = "node") -> DataFrame:
    """Nodes that two or more references of ways share, with the ways."""
    return ways.groupBy(node_col).agg(F.count(F.lit(1)).alias("refs"), F.array_sort(F.collect_set(way_col)).alias("ways")).filter("refs > 1")


def networks(segments: DataFrame) -> DataFrame:
    """segments: way, name, a, b.  way, name and network: connected segments of one name, by the smallest way."""
    ends = segments.select("way", "name", F.explode(F.array("a", "b")).alias("node"))
    first = ends.groupBy("name", "node").agg(F.min("way").alias("w"))
    edges = ends.join(first, ["name", "node"]).filter("way <> w").select(F.col("way").alias("a"), F.col("w").alias("b"))
    return segments.join(components(edges).withColumnRenamed("node", "way"), "way", "left").select("way", "name", F.coalesce("component", "way").alias("network"))


def interpolation_step(value: Column) -> Column:
    """all is 1, even and odd are 2, a positive integer is itself; others are unsupported."""
    number = F.try_to_number(F.nullif(F.regexp_extract(value, r"^(\d{1,4})$", 1), F.lit("")), F.lit("9999")).cast("int")
    return F.when(value == "all", 1).when(value.isin("even", "odd"), 2).when(number > 0, number)


def interpolate(nodes: DataFrame, way: str = "way", pos: str = "pos", number: str = "hn", step: str = "step") -> DataFrame:
    """Addresses between consecutive numbered nodes of a way, both ends included, at equal shares of the straight piece.

    Numbers run from the node before to the node after, also downwards.
    """
    order = Window.partitionBy(way).orderBy(pos)
    numbered = nodes.filter(F.col(number).isNotNull())
    pairs = numbered.select(way, pos, step, F.lag(number).over(order).alias("n0"), F.lag("x").over(order).alias("x0"), F.lag("y").over(order).alias("y0"), F.col(number).alias("n1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    pairs = pairs.filter(f"n0 is not null and {step} > 0 and n0 <> n1")
    steps = F.floor(F.abs(F.col("n1") - F.col("n0")) / F.col(step)).cast("int")
    at = pairs.withColumn("steps", steps).filter("steps > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    share = F.col("i") / F.col("steps")
    hn = F.when(F.col("n1") > F.col("n0"), F.col("n0") + F.col("i") * F.col(step)).otherwise(F.col("n0") - F.col("i") * F.col(step))
    point = lambda a, b: F.col(a) + share * (F.col(b) - F.col(a))
    return at.select(way, pos, hn.alias("hn"), point("x0", "x1").alias("x"), point("y0", "y1").alias("y"), (F.col("i") == 0).alias("first"), (F.col("i") == F.col("steps")).alias("last"))


def boundary_rows(boundaries: Column) -> Column:
    """Rows of boundaries of a street from its boundaries (structs lvl, id and inside: ids of those that hold its centre), in order.

    One row grows until two boundaries have one level; then a copy with the last
    replaced starts a row of its own.  Of several rows, those before the first
    whose last has the level of the next boundary grow where that holds their
    last's centre, and that first one is copied; without such a row all may grow.
    """
    kind = "array<array<struct<lvl:int,id:bigint,inside:array<bigint>>>>"

    def step(rows: Column, b: Column) -> Column:
        last = lambda r: F.element_at(r, -1)
        swapped = lambda r: F.concat(F.slice(r, 1, F.size(r) - 1), F.array(b))
        same = lambda r: (last(r)["lvl"] > 0) & (last(r)["lvl"] == b["lvl"])
        one = F.get(rows, F.lit(0))
        single = F.when(same(one), F.array(one, swapped(one))).otherwise(F.array(F.concat(one, F.array(b))))
        at = F.array_position(F.transform(rows, same), True)  # 1 for the first row, 0 for none
        grown = F.transform(rows, lambda r, i: F.when(((at == 0) | (i + 1 < at)) & F.array_contains(last(r)["inside"], b["id"]), F.concat(r, F.array(b))).otherwise(r))
        several = F.when(at > 0, F.concat(grown, F.array(swapped(F.get(rows, (at - 1).cast("int")))))).otherwise(grown)
        return F.when(F.size(rows) == 0, F.array(F.array(b))).when(F.size(rows) == 1, single).otherwise(several)

    return F.aggregate(boundaries, F.array().cast(kind), step)

"""Spatial joins as equi-joins on grid cells; exact tests follow the cell match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the boxes (minx, miny, maxx, maxy) that hold them, edges included.

    A point has one cell, so no pair comes twice and only boxes are replicated.
    """
    dealt = boxes.withColumn("_cx", F.explode(cells(F.col("minx"), F.col("maxx"), size))).withColumn("_cy", F.explode(cells(F.col("miny"), F.col("maxy"), size)))
    at = points.withColumns({"_cx": F.floor(F.col(x) / size).cast("long"), "_cy": F.floor(F.col(y) / size).cast("long")})
    return at.join(dealt, ["_cx", "_cy"]).filter(F.col(x).between(F.col("minx"), F.col("maxx")) & F.col(y).between(F.col("miny"), F.col("maxy"))).drop("_cx", "_cy")


def boxes_meet_points(shapes: DataFrame, points: DataFrame, margin: float, size: float) -> DataFrame:
    """Pairs of shapes (with a box) and points (x, y) of which the point is in the box grown by margin."""
    grown = shapes.withColumn("_cx", F.explode(cells(F.col("minx") - margin, F.col("maxx") + margin, size))).withColumn("_cy", F.explode(cells(F.col("miny") - margin, F.col("maxy") + margin, size)))
    at = points.withColumns({"_cx": F.floor(F.col("x") / size).cast("long"), "_cy": F.floor(F.col("y") / size).cast("long")})
    near = F.col("x").between(F.col("minx") - margin, F.col("maxx") + margin) & F.col("y").between(F.col("miny") - margin, F.col("maxy") + margin)
    return grown.join(at, ["_cx", "_cy"]).filter(near).drop("_cx", "_cy")


def nearest(left: DataFrame, right: DataFrame, size: float, extent: float) -> DataFrame:
    """Each left row (id, x, y) with its nearest right row (rid, rx, ry) by planar distance, ties to the smallest rid.

    With cells of a size, the 3 x 3 cells around a point hold everything within
    that size of it: a candidate no farther is the nearest.  Rows without one go
    on to cells twice as large, up to the extent.  All levels are one plan.
    """
    found, level = None, size
    todo = left.select("id", "x", "y")
    while True:
        s = float(level)
        around = todo.withColumn("_dx", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))).withColumn("_dy", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
        around = around.withColumns({"_cx": (F.floor(F.col("x") / s) + F.col("_dx")).cast("long"), "_cy": (F.floor(F.col("y") / s) + F.col("_dy")).cast("long")})
        dealt = right.withColumns({"_cx": F.floor(F.col("rx") / s).cast("long"), "_cy": F.floor(F.col("ry") / s).cast("long")})
        d2 = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
        last = level >= extent
        best = around.join(dealt, ["_cx", "_cy"]).groupBy("id", "x", "y").agg(F.min(F.struct(d2.alias("d2"), F.col("rid").alias("rid"))).alias("best"))
        sure = best if last else best.filter(F.col("best.d2") <= s * s)
        sure = sure.select("id", "best.rid", "best.d2")
        found = sure if found is None else found.unionByName(sure)
        if last:
            return found
        todo = todo.join(sure.select("id"), "id", "left_anti")
        level = min(level * 4, extent)


#: Distances made at once by nearest_in_squares.
_PAIRS = 1 << 17


def _nearest_of(px: np.ndarray, py: np.ndarray, ax: np.ndarray, ay: np.ndarray, margin: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of p and a: of each p (all different) the nearest `most` of a in its square, ties to the first of a.

    Halved by its longer side until the distances are few.  Where a part's box holds
    `most` of a, its diagonal bounds their distance, so others need not be looked at.
    """
    todo = [(np.arange(len(px)), np.arange(len(ax)))]
    while todo:
        p, a = todo.pop()
        if not len(p) or not len(a):
            continue
        x, y, u, v = px[p], py[p], ax[a], ay[a]
        low_x, high_x, low_y, high_y = x.min(), x.max(), y.min(), y.max()
        reach = margin
        if len(p) * len(a) > _PAIRS:
            own = (u >= low_x) & (u <= high_x) & (v >= low_y) & (v <= high_y)
            if np.count_nonzero(own) >= most:
                reach = min(margin, float(np.hypot(float(high_x - low_x), float(high_y - low_y))) * (1 + 1e-9))
        near = (u >= low_x - reach) & (u <= high_x + reach) & (v >= low_y - reach) & (v <= high_y + reach)
        a, u, v = a[near], u[near], v[near]
        if len(p) > 1 and len(p) * len(a) > _PAIRS:
            along = x if high_x - low_x >= high_y - low_y else y
            order = np.argsort(along, kind="stable")
            todo += [(p[order[: len(p) // 2]], a), (p[order[len(p) // 2 :]], a)]
            continue
        dx, dy = x[:, None] - u, y[:, None] - v
        d = dx * dx + dy * dy
        inside = (np.abs(dx) <= margin) & (np.abs(dy) <= margin)
        if len(a) > most:
            far = np.iinfo(d.dtype).max if d.dtype.kind == "i" else np.inf
            inside &= d <= np.partition(np.where(inside, d, far), most - 1, axis=1)[:, most - 1 : most]
        row, col = np.nonzero(inside)
        order = np.lexsort((d[row, col], row))  # stable: ties stay in the order of a
        row, col = row[order], col[order]
        first = np.searchsorted(row, np.arange(len(p)))
        kept = np.arange(len(row)) - first[row] < most
        yield p[row[kept]], a[col[kept]]


def _by_cell(pairs):
    """Rows (_cx, _cy, _left, ...) by cell, right ones first -> what pairs makes of the left rows of a cell, batch by batch, and all its right ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, right = None, [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            cx, cy, is_left = (t[c].to_numpy() for c in ("_cx", "_cy", "_left"))
            cut = np.flatnonzero(np.append(True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]) | (is_left[1:] != is_left[:-1])))
            for lo, hi in zip(cut, np.append(cut[1:], len(cx)), strict=True) if len(cx) else ():
                if cell != (here := (cx[lo], cy[lo])):
                    cell, held, right = here, [], None
                if not is_left[lo]:
                    held.append(t.slice(lo, hi - lo))
                elif held or right is not None:
                    right = pa.concat_tables(held).combine_chunks() if right is None else right
                    held = []
                    yield from pairs(t.slice(lo, hi - lo).combine_chunks(), right)

    return run


def _taken(left: pa.Table, rows: np.ndarray, right: pa.Table, others: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    columns = [t[c].combine_chunks().take(pa.array(at)) for t, c, at in ((left, "l", rows), (right, "r", others))]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in more.values())], ["l", "r", *more])


def _nearest(margin: float, most: int):
    def pairs(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        places, at = np.unique(np.stack([left["x"].to_numpy(), left["y"].to_numpy()]), axis=1, return_inverse=True)
        at = at.reshape(-1)
        order, n = np.argsort(at, kind="stable"), np.bincount(at, minlength=places.shape[1])
        first = np.cumsum(n) - n
        for p, a in _nearest_of(places[0], places[1], right["x"].to_numpy(), right["y"].to_numpy(), margin, most):
            many = n[p]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield _taken(left, order[np.repeat(first[p], many) + step], right, np.repeat(a, many))

    return _by_cell(pairs)


def _near_segments(distance: float):
    def pairs(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        x1, y1, x2, y2 = (left[c].to_numpy() for c in ("x", "y", "x2", "y2"))
        px, py = right["x"].to_numpy(), right["y"].to_numpy()
        box = np.stack([np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)])
        dx, dy = (x2 - x1).astype(float), (y2 - y1).astype(float)
        n = dx * dx + dy * dy
        todo = [(np.arange(len(x1)), np.arange(len(px)))]
        while todo:
            s, p = todo.pop()
            own = box[:, s]
            low, high = own.min(axis=1), own.max(axis=1)
            u, v = px[p], py[p]
            near = (u >= low[0] - distance) & (u <= high[1] + distance) & (v >= low[2] - distance) & (v <= high[3] + distance)
            p = p[near]
            if not len(p):
                continue
            if len(s) > 1 and len(s) * len(p) > _PAIRS // 2:
                order = np.argsort(own[np.argmax(high - low)], kind="stable")
                todo += [(s[order[: len(s) // 2]], p), (s[order[len(s) // 2 :]], p)]
                continue
            u, v = px[p], py[p]
            col = lambda x: x[s][:, None]  # noqa: B023, E731
            ax, ay, ex, ey, size = col(x1), col(y1), col(dx), col(dy), col(n)
            share = ((u - ax) * ex + (v - ay) * ey) / np.where(size == 0, 1.0, size)
            np.clip(share, 0.0, 1.0, out=share)
            gx, gy = u - (ax + share * ex), v - (ay + share * ey)
            d2 = gx * gx + gy * gy
            row, at = np.nonzero(d2 <= distance * distance)
            yield _taken(left, s[row], right, p[at], d2=d2[row, at])

    return _by_cell(pairs)


def _dealt(left: DataFrame, right: DataFrame, *order: str) -> DataFrame:
    """Left and right rows (_cx, _cy, l, r and more) together by cell, right ones first."""
    both = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    return both.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_cx", "_cy").sortWithinPartitions("_cx", "_cy", "_left", *order)


def _located(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of which no coordinate is missing."""
    return df.filter(" and ".join(f"{c} is not null and not isnan({c})" for c in columns))


def nearest_in_squares(left: DataFrame, right: DataFrame, margin: float, most: int, size: float, ties: str) -> DataFrame:
    """l and r: each left row (x, y) with its nearest `most` right rows (x, y) by planar distance, ties by a column, in the square of a margin around it.

    A left row has one cell and a right row comes to the cells its square meets.
    A task reads the cells one after the other, the right rows of a cell first:
    these are in memory at once, the left ones by batches.
    """
    kind = T.StructType([T.StructField("l", left.schema), T.StructField("r", right.schema)])
    at = [F.floor(F.col(v) / size).cast("long").alias(c) for c, v in (("_cx", "x"), ("_cy", "y"))]
    own = _located(left, "x", "y").select(*at, F.struct(*left.columns).alias("l"), F.lit(None).cast(right.schema).alias("r"), "x", "y")
    other = _located(right, "x", "y").select(F.struct(*right.columns).alias("r"), "x", "y").withColumn("_cx", F.explode(cells(F.col("x") - margin, F.col("x") + margin, size))).withColumn("_cy", F.explode(cells(F.col("y") - margin, F.col("y") + margin, size)))
    return _dealt(own, other.withColumn("l", F.lit(None).cast(left.schema)), f"r.{ties}").mapInArrow(_nearest(margin, most), kind)


def points_near_segments(segments: DataFrame, points: DataFrame, distance: float, size: float, segment: str, point: str) -> DataFrame:
    """segment, point (their columns of these names) and d2: points (x, y) within a distance of segments (x1, y1, x2, y2), and its square.

    A point has one cell and a segment comes to the cells its box meets, so no
    pair comes twice.  A task holds the points of one cell in memory.
    """
    low, high = (lambda c, f=f: f(f"{c}1", f"{c}2") for f in (F.least, F.greatest))
    dealt = _located(segments, "x1", "y1", "x2", "y2").select(F.col(segment).alias("l"), F.col("x1").alias("x"), F.col("y1").alias("y"), "x2", "y2", low("x").alias("_a"), high("x").alias("_b"), low("y").alias("_c"), high("y").alias("_d"))
    dealt = dealt.withColumn("_cx", F.explode(cells(F.col("_a") - distance, F.col("_b") + distance, size))).withColumn("_cy", F.explode(cells(F.col("_c") - distance, F.col("_d") + distance, size)))
    at = _located(points, "x", "y").select(*[F.floor(F.col(v) / size).cast("long").alias(c) for c, v in (("_cx", "x"), ("_cy", "y"))], F.col(point).alias("r"), "x", "y")
    kind = T.StructType([T.StructField("l", segments.schema[segment].dataType), T.StructField("r", points.schema[point].dataType), T.StructField("d2", T.DoubleType())])
    return _dealt(dealt.drop("_a", "_b", "_c", "_d"), at).mapInArrow(_near_segments(distance), kind).select(F.col("l").alias(segment), F.col("r").alias(point), "d2")

"""Queries that apply each operator to the generic tables, and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import address, compose, features, graph, places, spatial, streets, versions
from ..sources import osm, sinks
from .views import frame

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CELL = 18_000.0


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _box_points(spark: SparkSession, d: str) -> DataFrame:
    return spatial.points_in_boxes(frame(spark, d, "addr_pts"), frame(spark, d, "nation_box"), CELL)


@query("""SELECT a.id, b.bid AS nation_id, concat(CAST(a.hn AS STRING), ', ', a.street, ', ', b.bname, ', ', r.r_name) AS text
FROM {addr_pts} a JOIN {nation_box} b ON a.x BETWEEN b.minx AND b.maxx AND a.y BETWEEN b.miny AND b.maxy JOIN {region} r ON r.r_regionkey = b.region""")
def q_addr_pip(spark, d):
    """Address points in boundaries, with the composed address text."""
    hit = _box_points(spark, d).join(frame(spark, d, "region"), F.col("region") == F.col("r_regionkey"))
    parts = F.array(address.part("hn", F.col("hn")), address.part("street", F.col("street")), address.part("boundary:4", F.col("bname")), address.part("boundary:2", F.col("r_name")), address.part("postcode", F.lit("")))
    return hit.select("id", F.col("bid").alias("nation_id"), address.text(parts, "hn_street_city").alias("text"))


def _layout(order: str, sql: str) -> None:
    @query(f"SELECT a.id, b.bid AS nation_id, {sql} AS text FROM {{addr_pts}} a JOIN {{nation_box}} b ON a.x BETWEEN b.minx AND b.maxx AND a.y BETWEEN b.miny AND b.maxy JOIN {{region}} r ON r.r_regionkey = b.region")
    def run(spark, d):
        hit = _box_points(spark, d).join(frame(spark, d, "region"), F.col("region") == F.col("r_regionkey"))
        parts = F.array(address.part("boundary:2", F.col("r_name")), address.part("street", F.col("street")), address.part("boundary:4", F.col("bname")), address.part("hn", F.col("hn")))
        return hit.select("id", F.col("bid").alias("nation_id"), address.text(parts, order).alias("text"))

    for table in (QUERIES, ORACLES):
        table[f"q_addr_text_{order}"] = table.pop("run")


_layout("hn_street_city", "concat(CAST(a.hn AS STRING), ', ', a.street, ', ', b.bname, ', ', r.r_name)")
_layout("street_hn_city", "concat(a.street, ', ', CAST(a.hn AS STRING), ', ', b.bname, ', ', r.r_name)")
_layout("city_street_hn", "concat(r.r_name, ', ', b.bname, ', ', a.street, ', ', CAST(a.hn AS STRING))")


@query("""SELECT b.bid AS id, 4 AS lvl, max(r.rid) AS ancestor, 1 AS distance FROM {nation_box} b JOIN (SELECT region AS rid, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM {nation_box} GROUP BY region) r
ON b.minx >= r.minx AND b.maxx <= r.maxx AND b.miny >= r.miny AND b.maxy <= r.maxy GROUP BY b.bid
UNION ALL SELECT b.bid, 4, -1, 2 FROM {nation_box} b UNION ALL SELECT DISTINCT region + 1000, 2, -1, 1 FROM {nation_box}""")
def q_pip_hierarchy(spark, d):
    """Boundaries to the deepest boundary that covers them, and all ancestors up to the root (-1)."""
    low = frame(spark, d, "nation_box")
    box = ("minx", "miny", "maxx", "maxy")
    up = low.groupBy("region").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    boundaries = low.select(F.col("bid").alias("id"), F.lit(4).alias("lvl"), *box).unionByName(up.select((F.col("region") + 1000).alias("id"), F.lit(2).alias("lvl"), *box))
    found = graph.closure(places.parents(boundaries, CELL).withColumn("parent", F.coalesce("parent", F.lit(-1))), 3).join(boundaries.select("id", "lvl"), "id")
    return found.select("id", "lvl", F.when(F.col("ancestor") >= 1000, F.col("ancestor") - 1000).otherwise(F.col("ancestor")).alias("ancestor"), "distance")


@query("""SELECT id, rid AS place_id, d2 FROM (SELECT a.id, p.rid, (a.x - p.rx) * (a.x - p.rx) + (a.y - p.ry) * (a.y - p.ry) AS d2, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - p.rx) * (a.x - p.rx) + (a.y - p.ry) * (a.y - p.ry), p.rid) AS rn FROM {addr_pts} a, {places} p WHERE p.kind < 3) WHERE rn = 1""")
def q_nearest_place(spark, d):
    """Nearest city, town or village of each address point."""
    near = spatial.nearest(frame(spark, d, "addr_pts"), frame(spark, d, "places").filter("kind < 3"), 8_000, 600_000)
    return near.select("id", F.col("rid").alias("place_id"), "d2")


@query("""SELECT id, hood, city FROM (SELECT a.id, h.rid AS hood, c.rid AS city, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - h.rx) * (a.x - h.rx) + (a.y - h.ry) * (a.y - h.ry), h.rid) AS rn
FROM {addr_pts} a, {places} h, {places} c WHERE h.kind = 3 AND h.rid - 3 = c.rid) WHERE rn = 1""")
def q_nearest_neighbourhood(spark, d):
    """Nearest neighbourhood and the city it belongs to."""
    places = frame(spark, d, "places")
    near = spatial.nearest(frame(spark, d, "addr_pts"), places.filter("kind = 3"), 12_000, 600_000)
    return near.select("id", F.col("rid").alias("hood"), (F.col("rid") - 3).alias("city"))


@query("SELECT p.pid, a.id FROM {pois} p JOIN {addr_pts} a ON abs(a.x - p.x) <= 900 AND abs(a.y - p.y) <= 900")
def q_poi_nearby_addr(spark, d):
    """Addresses in the square around each POI."""
    return spatial.boxes_meet_points(_poi_boxes(spark, d), frame(spark, d, "addr_pts").select("id", "x", "y"), 900, 2_000.0).select("pid", "id")


def _poi_boxes(spark, d):
    pois = frame(spark, d, "pois")
    return pois.select("pid", F.col("x").alias("minx"), F.col("x").alias("maxx"), F.col("y").alias("miny"), F.col("y").alias("maxy"), F.col("x").alias("px"), F.col("y").alias("py"), "size")


@query("""SELECT pid, id, d2, CASE WHEN pid = id THEN 'sameSource' WHEN abs(x - px) <= size * 20 AND abs(y - py) <= size * 20 THEN 'contains' ELSE 'nearest' END AS class FROM (
SELECT *, row_number() OVER (PARTITION BY pid ORDER BY CASE WHEN pid = id THEN 0 WHEN abs(x - px) <= size * 20 AND abs(y - py) <= size * 20 THEN 1 ELSE 2 END, rn) AS best FROM (
SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, id) AS rn FROM (SELECT p.pid, p.x AS px, p.y AS py, p.size, a.id, a.x, a.y, (a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y) AS d2 FROM {pois} p JOIN {addr_pts} a ON abs(a.x - p.x) <= 2500 AND abs(a.y - p.y) <= 2500)) WHERE rn <= 10) WHERE best = 1""")
def q_poi_best_address(spark, d):
    """Best address of each POI among its ten nearest: same source, contained, else nearest."""
    pois, points = frame(spark, d, "pois").select("pid", "x", "y", "size"), frame(spark, d, "addr_pts").select("id", "x", "y")
    met = spatial.nearest_in_squares(pois, points, 2_500, 10, 5_000.0, "id").select("l.pid", F.col("l.x").alias("px"), F.col("l.y").alias("py"), "l.size", "r.*")
    met = met.withColumn("d2", (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    inside = (F.abs(F.col("x") - F.col("px")) <= F.col("size") * 20) & (F.abs(F.col("y") - F.col("py")) <= F.col("size") * 20)
    none = F.lit(None).cast("long")
    candidates = met.select(F.col("pid").alias("poi"), F.col("id").alias("addr"), F.col("d2").alias("d"), (F.col("pid") == F.col("id")).alias("same_source"), F.lit(False).alias("same_building"), inside.alias("inside"), none.alias("addr_building"))
    return features.best_address(candidates).select(F.col("poi").alias("pid"), F.col("addr").alias("id"), F.col("d").alias("d2"), "class")


@query("""SELECT s.way, a.id, round(d2, 3) AS d2 FROM (SELECT s.way, a.id, (a.x - (s.x1 + t * (s.x2 - s.x1))) * (a.x - (s.x1 + t * (s.x2 - s.x1))) + (a.y - (s.y1 + t * (s.y2 - s.y1))) * (a.y - (s.y1 + t * (s.y2 - s.y1))) AS d2 FROM (
SELECT s.*, a.id, a.x, a.y, CASE WHEN s.x1 = s.x2 AND s.y1 = s.y2 THEN 0.0 ELSE greatest(0.0, least(1.0, CAST((a.x - s.x1) * (s.x2 - s.x1) + (a.y - s.y1) * (s.y2 - s.y1) AS DOUBLE) / CAST((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1) AS DOUBLE))) END AS t FROM {seg_lines} s JOIN {addr_pts} a ON a.x BETWEEN least(s.x1, s.x2) - 450 AND greatest(s.x1, s.x2) + 450 AND a.y BETWEEN least(s.y1, s.y2) - 450 AND greatest(s.y1, s.y2) + 450) s, (SELECT 1) a2, LATERAL (SELECT s.id AS id, s.x AS x, s.y AS y) a) s, LATERAL (SELECT s.id AS id) a WHERE d2 <= 202500""")
def q_street_within(spark, d):
    """Addresses within a distance of each street segment."""
    lines, points = frame(spark, d, "seg_lines").select("way", "x1", "y1", "x2", "y2"), frame(spark, d, "addr_pts").select("id", "x", "y")
    met = spatial.points_near_segments(lines, points, 450, 12_000.0, "way", "id")
    return met.select("way", "id", geo.rounded(F.col("d2"), 3).alias("d2"))


@query("SELECT DISTINCT way, bid FROM (SELECT way, x1 AS x, y1 AS y FROM {seg_lines} UNION ALL SELECT way, x2, y2 FROM {seg_lines}) v JOIN {nation_box} b ON v.x > b.minx AND v.x < b.maxx AND v.y > b.miny AND v.y < b.maxy")
def q_highway_bnd_rows(spark, d):
    """Boundaries that hold a vertex of a street strictly inside."""
    ends = frame(spark, d, "seg_lines").select("way", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("v")).select("way", "v.x", "v.y")
    inside = (F.col("x") > F.col("minx")) & (F.col("x") < F.col("maxx")) & (F.col("y") > F.col("miny")) & (F.col("y") < F.col("maxy"))
    return spatial.points_in_boxes(ends, frame(spark, d, "nation_box"), CELL).filter(inside).select("way", "bid").distinct()


@query("""SELECT pid, x, y, cls, CAST(absorbed AS BIGINT) AS absorbed FROM (SELECT p.*, (SELECT count(*) FROM {pois} q WHERE q.size < 10 AND p.size >= 40 AND q.cls = p.cls AND q.pid <> p.pid AND abs(q.x - p.x) < p.size * 20 AND abs(q.y - p.y) < p.size * 20) AS absorbed FROM {pois} p)
WHERE NOT (size < 10 AND EXISTS (SELECT 1 FROM {pois} q WHERE q.size >= 40 AND q.cls = cls AND q.pid <> pid AND abs(q.x - x) < q.size * 20 AND abs(q.y - y) < q.size * 20))""".replace("q.cls = cls AND q.pid <> pid AND abs(q.x - x) < q.size * 20 AND abs(q.y - y) < q.size * 20", "q.cls = t.cls AND q.pid <> t.pid AND abs(q.x - t.x) < q.size * 20 AND abs(q.y - t.y) < q.size * 20").replace("FROM {pois} p)\nWHERE", "FROM {pois} p) t\nWHERE"))
def q_poi_merge(spark, d):
    """Area POIs absorb point POIs of their class strictly inside; absorbed ones go."""
    pois = frame(spark, d, "pois")
    areas = pois.filter("size >= 40").select(F.col("pid").alias("aid"), F.col("cls").alias("acls"), *[(F.col(c) + s * F.col("size") * 20).alias(n) for c, s, n in (("x", -1, "minx"), ("x", 1, "maxx"), ("y", -1, "miny"), ("y", 1, "maxy"))])
    points = pois.filter("size < 10")
    strict = (F.col("x") > F.col("minx")) & (F.col("x") < F.col("maxx")) & (F.col("y") > F.col("miny")) & (F.col("y") < F.col("maxy"))
    hits = spatial.points_in_boxes(points, areas, 2_000.0).filter(strict & (F.col("cls") == F.col("acls")) & (F.col("aid") != F.col("pid"))).select("aid", "pid")
    kept = pois.join(hits.select("pid").distinct(), "pid", "left_anti")
    counts = hits.groupBy(F.col("aid").alias("pid")).agg(F.count(F.lit(1)).alias("absorbed"))
    return kept.join(counts, "pid", "left").select("pid", "x", "y", "cls", F.coalesce("absorbed", F.lit(0)).cast("long").alias("absorbed"))


@query("SELECT node, count(*) AS refs, string_agg(DISTINCT CAST(way AS STRING), ',' ORDER BY CAST(way AS STRING)) AS ways FROM (SELECT way, a AS node FROM {segs} UNION ALL SELECT way, b + 1000000 FROM {segs}) GROUP BY node HAVING count(*) > 1")
def q_junctions(spark, d):
    """Nodes shared by streets."""
    ends = frame(spark, d, "segs").select(F.col("way").cast("string").alias("way"), F.explode(F.array(F.col("a"), F.col("b") + 1_000_000)).alias("node"))
    return streets.junctions(ends).select("node", "refs", F.array_join("ways", ",").alias("ways"))


@query("SELECT o.o_orderkey AS rel, l.way, a.id FROM {orders} o JOIN {segs} l ON l.way {div} 8 = o.o_orderkey JOIN {addr_pts} a ON a.id = o.o_custkey WHERE o.o_orderstatus = 'F'")
def q_assoc_street(spark, d):
    """Addresses joined to the streets of the relation that names them."""
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), ref.alias("ref"), F.lit(role).alias("role"))
    ways = frame(spark, d, "segs").groupBy(F.expr("way div 8").alias("id")).agg(F.collect_list(member("way", F.col("way"), "street")).alias("ways"))
    rel = frame(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.array(member("node", F.col("o_custkey"), "house")).alias("houses"))
    relations = rel.join(ways, "id").select("id", F.concat("ways", "houses").alias("members"), F.create_map(F.lit("type"), F.lit("associatedStreet")).alias("tags"))
    found = features.associated_streets(relations)
    points = frame(spark, d, "addr_pts").select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("building"))
    return found.join(points, "building").select(F.col("relation").alias("rel"), "way", "id")


@query("SELECT DISTINCT l.way, a.id FROM {segs} l JOIN {addr_pts} a ON a.id IN (l.a, l.b)")
def q_building_link(spark, d):
    """Address nodes that are part of a building's contour."""
    ways = frame(spark, d, "segs").select(F.col("way").alias("id"), F.array("a", "b", "a").alias("nodes"), F.create_map(F.lit("building"), F.lit("yes")).alias("tags"))
    objects = frame(spark, d, "addr_pts").select(F.lit("n").alias("kind"), "id")
    return features.building_links(ways, objects).select("way", F.col("node").alias("id"))


@query()
def q_network_components(spark, d):
    """Street networks: connected segments of one name.  A recursive oracle can't close whole tables; tests compare it with union-find."""
    return streets.networks(frame(spark, d, "segs").select("way", "name", "a", (F.col("b") + 1_000_000).alias("b"))).select("way", "network")


@query("""SELECT way, pos, n0 + CASE WHEN n1 > n0 THEN 1 ELSE -1 END * i * 2 AS hn, round(x0 + (CAST(i AS DOUBLE) / steps) * (x1 - x0), 6) AS x, round(y0 + (CAST(i AS DOUBLE) / steps) * (y1 - y0), 6) AS y FROM (
SELECT *, unnest(range(0, steps + 1)) AS i FROM (SELECT *, abs(n1 - n0) {div} 2 AS steps FROM (SELECT o_custkey AS way, o_orderkey AS pos, o_orderkey % 90 AS n1, lag(o_orderkey % 90) OVER w AS n0, (o_orderkey * 50021) % 360000 AS x1, lag((o_orderkey * 50021) % 360000) OVER w AS x0, (o_orderkey * 30011) % 170000 AS y1, lag((o_orderkey * 30011) % 170000) OVER w AS y0
FROM {orders} WHERE o_orderkey % 3 <> 0 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE n0 IS NOT NULL AND n0 <> n1) WHERE steps > 0)""")
def q_interpolation(spark, d):
    """Addresses interpolated between numbered nodes of a way; nodes without a number are passed over."""
    nodes = frame(spark, d, "orders").select(F.col("o_custkey").alias("way"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 90).alias("hn"), ((F.col("o_orderkey") * 50021) % 360000).alias("x"), ((F.col("o_orderkey") * 30011) % 170000).alias("y"), streets.interpolation_step(F.lit("even")).alias("step"))
    return streets.interpolate(nodes).select("way", "pos", "hn", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_TAGS = "map_from_entries(filter(array(named_struct('key', 'addr:housenumber', 'value', CASE WHEN id % 6 = 1 THEN concat(hn, '/', hn + 1) ELSE cast(hn as string) END), named_struct('key', 'addr:street', 'value', street), named_struct('key', 'addr:housenumber2', 'value', CASE WHEN id % 6 = 2 THEN cast(hn + 2 as string) END), named_struct('key', 'addr:street2', 'value', CASE WHEN id % 6 IN (1, 3) THEN 'Side' END), " + "".join(f"named_struct('key', 'addr{n}:housenumber', 'value', CASE WHEN id % 6 = 4 THEN cast(hn + {n} as string) END), " for n in (*range(2, 13), 14)) + "named_struct('key', 'addr12:street', 'value', CASE WHEN id % 6 = 4 THEN 'Far' END), named_struct('key', 'addr:conscriptionnumber', 'value', CASE WHEN id % 6 = 5 THEN cast(hn + 9 as string) END)), x -> x.value IS NOT NULL))"


@query("""SELECT id, 'regular' AS scheme, CAST(hn AS STRING) AS hn, street FROM {addr_pts} WHERE id % 6 = 0
UNION ALL SELECT id, 'addr:street2.1', CAST(hn AS STRING), street FROM {addr_pts} WHERE id % 6 = 1 UNION ALL SELECT id, 'addr:street2.2', CAST(hn + 1 AS STRING), 'Side' FROM {addr_pts} WHERE id % 6 = 1
UNION ALL SELECT id, 'addr:hn2.1', CAST(hn AS STRING), street FROM {addr_pts} WHERE id % 6 = 2 UNION ALL SELECT id, 'addr:hn2.2', CAST(hn + 2 AS STRING), NULL FROM {addr_pts} WHERE id % 6 = 2
UNION ALL SELECT id, '', CAST(hn AS STRING), street FROM {addr_pts} WHERE id % 6 = 3
UNION ALL SELECT id, 'addrN.1', CAST(hn AS STRING), street FROM {addr_pts} WHERE id % 6 = 4 UNION ALL SELECT id, concat('addrN.', CAST(n AS STRING)), CAST(hn + n AS STRING), CASE WHEN n = 12 THEN 'Far' END FROM {addr_pts}, (SELECT unnest(range(2, 13)) AS n) WHERE id % 6 = 4
UNION ALL SELECT id, 'addr:conscriptionnumber', CAST(hn + 9 AS STRING), street FROM {addr_pts} WHERE id % 6 = 5""")
def q_addr_schemes(spark, d):
    """Address schemes: one row for each address that the tags of an object hold."""
    tagged = frame(spark, d, "addr_pts").withColumn("tags", F.expr(_TAGS)).select("id", "tags")
    return address.schemes(tagged).select("id", "scheme", "hn", "street")


@query("""SELECT bid AS id, CASE WHEN bid % 3 = 0 THEN concat(bname, ', Great ', bname, ', ', upper(bname), ' Union') WHEN bid % 3 = 1 THEN concat(bname, ', City') ELSE concat(bname, ', Land') END AS text FROM {nation_box}""")
def q_fulltext_filter(spark, d):
    """Levels of a full text: a larger unit that repeats the name before it is left out, as are levels to skip."""
    box = frame(spark, d, "nation_box")
    second = F.when(F.col("bid") % 3 == 0, F.concat(F.lit("Great "), F.col("bname"))).when(F.col("bid") % 3 == 1, "City").otherwise("Skipped")
    third = F.when(F.col("bid") % 3 == 2, "Land").when(F.col("bid") % 3 == 1, "cityland").otherwise(F.concat(F.upper("bname"), F.lit(" Union")))
    parts = F.array(address.part("street", F.col("bname")), address.part(("boundary:6"), second), address.part("boundary:4", third))
    parts = F.transform(parts, lambda p: F.struct(F.when(p["name"] == "Skipped", "boundary:5").otherwise(p["lvl"]).alias("lvl"), p["name"].alias("name")))
    kept = address.filter_levels(parts, geo.lits([20, 90, 110]), F.array(F.lit("boundary:5")))
    return box.select(F.col("bid").alias("id"), F.array_join(kept, ", ").alias("text"))


@query("""SELECT a.id, b.bid AS nation_id, r.r_name AS admin0, b.bname AS admin2, CASE WHEN a.id % 4 = 0 THEN concat('Town ', CAST(a.id % 50 AS STRING)) END AS locality, a.street, concat_ws('/', r.r_name, b.bname, CASE WHEN a.id % 4 = 0 THEN concat('Town ', CAST(a.id % 50 AS STRING)) END, a.street, concat('adrpnt-', CAST(a.id AS STRING), '--regular')) AS hhash
FROM {addr_pts} a JOIN {nation_box} b ON a.x BETWEEN b.minx AND b.maxx AND a.y BETWEEN b.miny AND b.maxy JOIN {region} r ON r.r_regionkey = b.region""")
def q_admin_levels(spark, d):
    """Output levels and the hierarchy path."""
    hit = _box_points(spark, d).join(frame(spark, d, "region"), F.col("region") == F.col("r_regionkey"))
    town = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Town "), (F.col("id") % 50).cast("string")))
    levels = F.create_map(F.lit("boundary:2"), F.col("r_name"), F.lit("boundary:4"), F.col("bname"), F.lit("place:town"), town, F.lit("street"), F.col("street"))
    out = address.output_levels(levels)
    uid = geo.row_uid(F.lit("adrpnt"), F.concat(F.lit("adrpnt-"), F.col("id").cast("string")), F.lit("regular"), F.lit(0), F.lit(None).cast("string"))
    return hit.select("id", F.col("bid").alias("nation_id"), out["admin0"].alias("admin0"), out["admin2"].alias("admin2"), out["locality"].alias("locality"), out["street"].alias("street"), address.hierarchy_path(out, uid).alias("hhash"))


@query("SELECT a.id FROM {addr_pts} a WHERE EXISTS (SELECT 1 FROM {nation_box} b WHERE b.bid IN (3, 7, 11) AND a.x BETWEEN b.minx AND b.maxx AND a.y BETWEEN b.miny AND b.maxy)")
def q_required_boundary(spark, d):
    """Only objects of which some joined boundary is required."""
    joined = _box_points(spark, d).groupBy("id").agg(F.collect_set("bid").alias("bids"))
    return features.with_required(joined, "bids", [3, 7, 11]).select("id")


@query("SELECT id, event_id, value FROM (SELECT concat(CAST(user_id AS STRING), '-', event_type) AS id, event_id, value, rank() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM {events} WHERE event_type <> 'error') WHERE r = 1")
def q_synchronize(spark, d):
    """Latest version of each id; tombstones dropped."""
    rows = frame(spark, d, "events").withColumn("id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")))
    return versions.synchronize(rows, removed="event_type = 'error'").select("id", "event_id", "value")


@query("SELECT user_id, max(value) AS value FROM (SELECT user_id, value, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM {events}) WHERE r = 1 GROUP BY user_id")
def q_fallback_latest(spark, d):
    """Newest stored value of each id."""
    return versions.newest(frame(spark, d, "events"), "user_id", "ts", "value").select("user_id", "value")


_DIFF = "SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN '+' WHEN n.id IS NULL THEN '-' WHEN o.ts < n.ts THEN 'N' ELSE 'O' END AS op FROM {snap_old} o FULL JOIN {snap_new} n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.hash <> n.hash"


@query(_DIFF)
def q_diff(spark, d):
    """Difference of two snapshots."""
    return versions.diff(frame(spark, d, "snap_old"), frame(spark, d, "snap_new")).select("id", "op")


@query(f"SELECT op, count(*) AS n FROM ({_DIFF}) GROUP BY op")
def q_diff_counts(spark, d):
    return q_diff(spark, d).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat(op, ' ', CAST(id AS STRING)) AS value FROM (" + _DIFF + ")")
def q_diff_lines(spark, d):
    """Lines of a diff file."""
    return versions.diff_lines(q_diff(spark, d))


@query("SELECT DISTINCT concat('hghway-', CAST(o_custkey AS STRING)) AS id FROM {orders} WHERE o_orderstatus = 'O' UNION ALL SELECT concat('adrpnt-', CAST(o_orderkey AS STRING)) FROM {orders} WHERE o_orderstatus <> 'O'")
def q_sort_unique(spark, d):
    """Unique sort: streets once for each row id, other features as they are."""
    way = F.col("o_orderstatus") == "O"
    rows = frame(spark, d, "orders").select(F.when(way, F.concat(F.lit("hghway-"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("adrpnt-"), F.col("o_orderkey").cast("string"))).alias("id"), "o_orderkey")
    return sinks.JsonSink().arranged(rows).select("id")


@query("SELECT o_custkey AS id, min(o_orderkey) AS first FROM {orders} GROUP BY o_custkey ORDER BY id")
def q_sort_id(spark, d):
    """Sorted by id, one row each."""
    rows = frame(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first"))
    return sinks.JsonSink("id").arranged(rows)


@query("SELECT hhash, min(o_orderkey) AS first FROM (SELECT concat_ws('/', o_orderpriority, o_orderstatus, CAST(o_custkey AS STRING)) AS hhash, o_orderkey FROM {orders}) GROUP BY hhash ORDER BY hhash DESC")
def q_sort_hierarchy(spark, d):
    """Sorted by hierarchy path, descending, one row each."""
    path = F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string"))
    return sinks.JsonSink("hierarchy").arranged(frame(spark, d, "orders").select(path.alias("hhash"), F.col("o_orderkey").alias("first")))


@query("SELECT o_orderkey AS id FROM {orders} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P')")
def q_drop_list(spark, d):
    """Elements whose id is not on the drop list."""
    o = frame(spark, d, "orders")
    listed = o.filter("o_orderstatus = 'P'").select(F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("ref"))
    return osm.drop_listed(o.select(F.col("o_orderkey").alias("id")), "w", listed)


@query("SELECT a.id, string_agg(r.r_name, ',' ORDER BY r.r_name) AS common FROM {addr_pts} a, {region} r GROUP BY a.id")
def q_common_append(spark, d):
    """Common objects (a list given as a file) appended to every feature, from a table of one row."""
    out = features.append_common(frame(spark, d, "addr_pts").select("id"), frame(spark, d, "region").select("r_name"))
    return out.select("id", F.array_join(F.transform("common", lambda x: x["r_name"]), ",").alias("common"))


_CURVE = """WITH RECURSIVE h AS (SELECT id, x + 180000 AS x, y + 85000 AS y, 15 AS i, 0 AS s, CAST(0 AS BIGINT) AS pos FROM {addr_pts}
UNION ALL SELECT id, x, y, i - 1, [3, 0, 1, 0, 1, 1, 0, 2, 2, 3, 2, 1, 0, 2, 3, 3][s * 4 + ((x >> i) & 1) * 2 + ((y >> i) & 1) + 1], pos * 4 + [0, 1, 3, 2, 2, 1, 3, 0, 2, 3, 1, 0, 0, 3, 1, 2][s * 4 + ((x >> i) & 1) * 2 + ((y >> i) & 1) + 1] FROM h WHERE i >= 0) """


@query(_CURVE + "SELECT id, pos FROM h WHERE i = -1")
def q_hilbert(spark, d):
    """Hilbert positions."""
    return frame(spark, d, "addr_pts").select("id", geo.hilbert(F.col("x") + 180000, F.col("y") + 85000).alias("pos"))


@query("SELECT id, lpad(CAST(CAST(floor((x / 1000.0 + 180) * 10) AS BIGINT) AS STRING), 4, '0') AS stripe, lpad(CAST(CAST(floor((x / 1000.0 + 180) * 100) AS BIGINT) AS STRING), 5, '0') AS fine FROM {addr_pts}")
def q_stripe_key(spark, d):
    lon = F.col("x") / 1000.0
    return frame(spark, d, "addr_pts").select("id", geo.stripe_key(lon).alias("stripe"), geo.stripe_key(lon, x10=True).alias("fine"))


@query("SELECT id, CAST(greatest(0, least(4095, floor((x / 1000.0 + 180) / 360 * 4096))) AS INT) AS tx, CAST(greatest(0, least(4095, floor((1 - ln(tan(radians(y / 1000.0)) + 1 / cos(radians(y / 1000.0))) / 3.141592653589793) / 2 * 4096))) AS INT) AS ty FROM {addr_pts}")
def q_tile(spark, d):
    """Slippy-map tiles."""
    return frame(spark, d, "addr_pts").select("id", geo.tile_x(F.col("x") / 1000.0, 12).alias("tx"), geo.tile_y(F.col("y") / 1000.0, 12).alias("ty"))


@query("SELECT id, concat('adrpnt-', lpad(CAST(x + 180000 AS STRING), 10, '0'), '-n', CAST(id AS STRING), CASE WHEN id % 2 = 0 THEN concat('-', CAST(hn AS STRING)) ELSE '' END) AS fid FROM {addr_pts}")
def q_feature_id(spark, d):
    return frame(spark, d, "addr_pts").select("id", geo.feature_id(F.lit("adrpnt"), F.col("x") + 180000, F.lit("n"), F.col("id"), F.when(F.col("id") % 2 == 0, F.col("hn"))).alias("fid"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN CASE WHEN x = 0 THEN concat('f', CAST(id AS STRING)) ELSE concat('f', CAST(id AS STRING), '--', CASE WHEN x < 0 THEN concat('m', CAST(-x AS STRING)) ELSE CAST(x AS STRING) END) END WHEN 1 THEN concat('f', CAST(id AS STRING), '--regular') WHEN 2 THEN concat('f', CAST(id AS STRING), '-w9--regular') ELSE concat('f', CAST(id AS STRING)) END AS uid FROM {addr_pts}")
def q_row_uid(spark, d):
    ftype = F.element_at(geo.lits(["hghway", "adrpnt", "poipnt", "plcpnt"]), (F.col("id") % 4).cast("int") + 1)
    return frame(spark, d, "addr_pts").select("id", geo.row_uid(ftype, F.concat(F.lit("f"), F.col("id").cast("string")), F.lit("regular"), F.col("x"), F.lit("w9")).alias("uid"))


@query("""WITH h AS (SELECT id, unnest(string_split(concat('f', CAST(id AS STRING)), '')) AS c, generate_subscripts(string_split(concat('f', CAST(id AS STRING)), ''), 1) AS i, length(concat('f', CAST(id AS STRING))) AS n FROM {addr_pts}),
s AS (SELECT id, CAST(sum((ascii(c) * CAST(pow(31, n - i) AS HUGEINT)) % 4294967296) % 4294967296 AS BIGINT) AS v FROM h GROUP BY id) SELECT id, CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS INT) AS h FROM s""")
def q_java_hash(spark, d):
    """32-bit polynomial string hash."""
    return frame(spark, d, "addr_pts").select("id", geo.java_hash(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("h"))


@query("SELECT min(x / 1000.0) AS minx, max(x / 1000.0) AS maxx, min(s) AS smin, max(s) AS smax, sum(CASE WHEN abs(b - x / 1000.0) < 0.0000001 THEN 1 ELSE 0 END) AS back FROM (SELECT x, s, CASE WHEN s + 90 > 180 THEN s - 270 ELSE s + 90 END AS b FROM (SELECT x, CASE WHEN x / 1000.0 - 90 < -180 THEN x / 1000.0 + 270 ELSE x / 1000.0 - 90 END AS s FROM {addr_pts}))")
def q_antimeridian(spark, d):
    """Bounding boxes, plain and shifted by a quarter."""
    lon = F.col("x") / 1000.0
    moved = frame(spark, d, "addr_pts").select(lon.alias("lon"), geo.shifted(lon).alias("s"))
    back = F.sum(F.when(F.abs(geo.unshifted(F.col("s")) - F.col("lon")) < 1e-7, 1).otherwise(0))
    return moved.agg(F.min("lon").alias("minx"), F.max("lon").alias("maxx"), F.min("s").alias("smin"), F.max("s").alias("smax"), back.alias("back"))


@query("SELECT event_type AS class, 'k' AS tag, json_extract_string(props, '$.k') AS value, count(*) AS n FROM {events} GROUP BY ALL")
def q_tag_stats(spark, d):
    """Counts of each tag's values by class, read back from the statistics' lines."""
    lines = sinks.tag_statistics(frame(spark, d, "events").select(F.col("event_type").alias("class"), F.from_json("props", "map<string,string>").alias("tags")))
    info = F.from_json("value", "name string, tags_info map<string,struct<total:bigint,values:map<string,bigint>>>")
    by_tag = lines.select(info.alias("x")).select(F.col("x.name").alias("class"), F.explode("x.tags_info").alias("tag", "i"))
    return by_tag.select("class", "tag", F.explode("i.values").alias("value", "n"))


@query("SELECT count(*) AS n, CAST(CAST(sum(CAST(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT) AS HUGEINT)) AS HUGEINT) AS STRING) AS head, CAST(CAST(sum(CAST(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT) AS HUGEINT)) AS HUGEINT) AS STRING) AS tail FROM (SELECT md5(concat(CAST(o_orderkey AS STRING), '|', CAST(o_custkey AS STRING), '|', o_orderstatus)) AS h FROM {orders})")
def q_checksum(spark, d):
    """Order-insensitive checksum of a dump."""
    rows = frame(spark, d, "orders").select(F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")).alias("md5"))
    return versions.dump_checksum(rows)


@query("""SELECT id, concat('"hn"=>"', CAST(hn AS STRING), '","street"=>"', street, '"') AS tags FROM {addr_pts}""")
def q_hstore(spark, d):
    tags = F.create_map(F.lit("street"), F.col("street"), F.lit("hn"), F.col("hn").cast("string"))
    return frame(spark, d, "addr_pts").select("id", geo.hstore(tags).alias("tags"))


@query("SELECT id, concat('SRID=4326;POINT (', CAST(x AS STRING), ' ', CAST(y AS STRING), ')') AS geom FROM {addr_pts}")
def q_ewkt(spark, d):
    return frame(spark, d, "addr_pts").select("id", geo.ewkt_point(F.col("x"), F.col("y")).alias("geom"))


@query("SELECT DISTINCT concat_ws(chr(9), c_mktsegment, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE 'rich' END, c_name), CAST(c_nationkey AS STRING)) AS line FROM {customer}")
def q_csv_coalesce(spark, d):
    """CSV columns, with groups of which the first present is taken; distinct lines."""
    rows = frame(spark, d, "customer").select("c_mktsegment", F.when(F.col("c_acctbal") >= 0, "rich").alias("rich"), "c_name", F.col("c_nationkey").cast("string").alias("nation"))
    out = sinks.CsvSink(["c_mktsegment", ["rich", "c_name"], "nation"]).arranged(rows)
    return out.select(F.concat_ws("\t", *out.columns).alias("line"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN lang = 'en' THEN 'en' ELSE '' END AS langs FROM {documents}")
def q_lang_intersection(spark, d):
    """Languages that all levels of an address have."""
    lists = F.array(F.array("lang"), F.when(F.col("doc_id") % 3 == 0, F.array("lang", F.lit("xx"))).otherwise(F.array(F.lit("en"), F.lit("xx"))))
    return frame(spark, d, "documents").select("doc_id", F.array_join(address.languages_of_all(lists), ",").alias("langs"))


@query("SELECT event_type AS region, day, (DATE '2024-02-01' - day <= 3) OR (DATE '2024-02-01' - day <= 30 AND dayofweek(day) = 1) AS keep, coalesce(day - lag(day) OVER (PARTITION BY event_type ORDER BY day) = 1, FALSE) AS diff_with_previous FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM {events})")
def q_retention(spark, d):
    """Which daily dumps stay, and which follow the day before."""
    dumps = frame(spark, d, "events").select(F.col("event_type").alias("region"), F.to_date("ts").alias("day")).distinct()
    return versions.retention(dumps, "2024-02-01")


@query("SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'place:city' WHEN s_suppkey % 5 = 1 THEN 'boundary:4' WHEN s_suppkey % 5 = 2 THEN 'street' END AS lvl, CASE WHEN s_suppkey % 5 = 0 THEN 70 WHEN s_suppkey % 5 = 1 THEN 110 WHEN s_suppkey % 5 = 2 THEN 20 END AS size, count(*) AS n FROM {supplier} GROUP BY ALL")
def q_level_sizes(spark, d):
    """Levels and sizes of tags."""
    k = F.col("s_suppkey") % 5
    tags = F.map_from_arrays(F.array(F.when(k == 0, "place").when(k == 1, "admin_level").when(k == 2, "highway").otherwise("shop")), F.array(F.when(k == 0, "city").when(k == 1, "4").otherwise("residential")))
    lvl = frame(spark, d, "supplier").select(geo.addr_level(tags).alias("lvl"))
    return lvl.groupBy("lvl", geo.level_size(F.col("lvl")).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT pid, CAST(regexp_extract(name_hn, '^([0-9]+)', 1) AS INT) AS hn FROM (SELECT pid, concat(CAST(pid % 300 AS STRING), 'A') AS name_hn FROM {pois})")
def q_house_number(spark, d):
    return frame(spark, d, "pois").select("pid", geo.house_number(F.concat((F.col("pid") % 300).cast("string"), F.lit("A"))).alias("hn"))


@query("""SELECT a.id, min(p.rid) AS place FROM {addr_pts} a JOIN {places} p ON a.street = concat('Street ', CAST(p.rid % 37 AS STRING)) AND abs(a.x - p.rx) <= 5000 AND abs(a.y - p.ry) <= 5000 GROUP BY a.id""")
def q_place_boundary_match(spark, d):
    """The first polygon around each place that bears its name."""
    boxes = frame(spark, d, "places").select("rid", F.create_map(F.lit("name"), F.concat(F.lit("Street "), (F.col("rid") % 37).cast("string"))).alias("names"), *[(F.col(c) + s).alias(n) for c, s, n in (("rx", -5000, "minx"), ("rx", 5000, "maxx"), ("ry", -5000, "miny"), ("ry", 5000, "maxy"))])
    hits = spatial.points_in_boxes(frame(spark, d, "addr_pts"), boxes, 10_000.0)
    merged = places.merge_places(hits.select(F.col("id").alias("place"), F.col("street").alias("name"), F.col("rid").alias("polygon"), "names"))
    return merged.select(F.col("place").alias("id"), F.col("polygon").alias("place"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'adrpnt' AS kind FROM {addr_pts} UNION ALL SELECT 'poipnt' FROM {pois} UNION ALL SELECT 'plcpnt' FROM {places} UNION ALL SELECT 'hghway' FROM {segs}) GROUP BY kind")
def q_counters(spark, d):
    """Features by type."""
    return features.counters({kind: frame(spark, d, name) for kind, name in {"adrpnt": "addr_pts", "poipnt": "pois", "plcpnt": "places", "hghway": "segs"}.items()})

def _all_levels(order: str) -> None:
    rank = address.ranks(order)
    levels = sorted(rank) + ["boundary:9"]
    values = ", ".join(f"({i}, {rank.get(x, -1)})" for i, x in enumerate(levels))
    n = len(levels)

    @query(f"""SELECT p.p_partkey AS id, string_agg(concat('N', CAST((p.p_partkey + k) % {n} AS STRING)), ', ' ORDER BY l.rank, k) AS text
FROM {{part}} p, (SELECT unnest(range(0, {n})) AS k) ks, (SELECT * FROM (VALUES {values}) AS v(lvl, rank)) l
WHERE l.lvl = (p.p_partkey + k) % {n} AND l.rank >= 0 AND (p.p_partkey + k) % 7 <> 0 GROUP BY p.p_partkey""")
    def run(spark, d):
        i = lambda k: (F.col("p_partkey") + k) % n
        parts = F.array(*[F.struct(F.element_at(geo.lits(levels), (i(k) + 1).cast("int")).alias("lvl"), F.when((F.col("p_partkey") + k) % 7 != 0, F.concat(F.lit("N"), i(k).cast("string"))).otherwise(" ").alias("name")) for k in range(n)])
        return frame(spark, d, "part").select(F.col("p_partkey").alias("id"), address.text(parts, order).alias("text"))

    for table in (QUERIES, ORACLES):
        table[f"q_addr_levels_{order}"] = table.pop("run")


for _order in address.ORDERS:
    _all_levels(_order)


@query()
def q_boundary_rows(spark, d):
    """Rows of boundaries of each order, from its line items as boundaries; the tests compare them with a fold of their own."""
    b = F.struct(F.col("l_linenumber").alias("lvl"), F.col("l_partkey").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: (F.col("l_partkey") + i * 5).cast("long")).alias("inside"))
    own = frame(spark, d, "lineitem").withColumn("l_linenumber", F.expr("3 + l_linenumber % 3")).groupBy("l_orderkey").agg(F.sort_array(F.collect_set(b)).alias("bs"))
    rows = streets.boundary_rows(F.col("bs"))
    return own.select(F.col("l_orderkey").alias("id"), F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: x["id"].cast("string")), "-")), ",").alias("rows"))


@query("SELECT id, (x + 180000) & 65535 AS x, (y + 85000) & 65535 AS y FROM {addr_pts}")
def q_hilbert_decode(spark, d):
    """Coordinates from Hilbert positions: the low bits come back."""
    at = frame(spark, d, "addr_pts").select("id", geo.hilbert(F.col("x") + 180000, F.col("y") + 85000).alias("pos"))
    return at.select("id", geo.hilbert_decode(F.col("pos")).alias("c")).select("id", "c.x", "c.y")


@query("""SELECT a.id, concat_ws(', ', CASE WHEN a.id % 3 = 0 THEN CAST(a.id AS STRING) END, CAST(a.hn AS STRING), CASE WHEN a.id % 35 = 0 THEN 'Other' ELSE a.street END, CASE WHEN a.id % 4 = 0 THEN concat('Town ', CAST(a.id % 50 AS STRING)) END, b.bname, r.r_name) AS text,
CASE WHEN a.id % 7 = 0 OR a.id % 5 <> 0 THEN concat('hghway-', CAST(a.id % 37 AS STRING)) END AS street_lnk, CASE WHEN a.id % 8 = 0 THEN concat('plcpnt-', CAST(a.id AS STRING)) END AS city_lnk, 5 + CASE WHEN a.id % 4 = 0 THEN 1 ELSE 0 END AS parts
FROM {addr_pts} a JOIN {nation_box} b ON a.x BETWEEN b.minx AND b.maxx AND a.y BETWEEN b.miny AND b.maxy JOIN {region} r ON r.r_regionkey = b.region""")
def q_address_rows(spark, d):
    """Whole address rows: postcode, number, street by relation or name, city by nearest place or tag, boundaries."""
    text = lambda c: c.cast("string")
    tags = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    hit = _box_points(spark, d).join(frame(spark, d, "region"), F.col("region") == F.col("r_regionkey"))
    i = F.col("id")
    town = F.concat(F.lit("Town "), text(i % 50))
    of = lambda prefix, key, t: F.struct(F.concat(F.lit(prefix), text(key)).alias("id"), t.alias("tags"))
    bounds = F.array(of("bnd4-", F.col("bid"), tags(admin_level=F.lit("4"), name=F.col("bname"))), of("bnd2-", F.col("region"), tags(admin_level=F.lit("2"), name=F.col("r_name"))))
    called = F.when(i % 5 != 0, F.col("street")).otherwise("Other")
    near = F.struct(F.concat(F.lit("hghway-"), text(i % 37)).alias("id"), (i % 37).alias("way"), tags(name=called).alias("tags"), F.array(F.lit(7)).alias("hashes"))
    rows = hit.select(text(i).alias("id"), tags(**{"addr:postcode": F.when(i % 3 == 0, text(i)), "addr:city": F.when(i % 4 == 0, town)}).alias("tags"), F.lit("regular").alias("scheme"), text(F.col("hn")).alias("hn"), "street", bounds.alias("boundaries"), of("plcpnt-", i, tags(place=F.lit("town"), name=F.when(i % 8 == 0, town).otherwise("Elsewhere"))).alias("nearest"), F.array(near).alias("streets"), F.when(i % 7 == 0, F.array(i % 37)).alias("ways"), F.lit(None).cast("map<string,string>").alias("relation_tags"))
    link = lambda *levels: F.get(F.transform(F.filter("parts", lambda p: p["lvl"].isin(*levels)), lambda p: p["lnk"]), F.lit(0))
    return compose.address_rows(rows).select(F.col("id").cast("long").alias("id"), "text", link("street").alias("street_lnk"), link("place:town", "place:city").alias("city_lnk"), F.size("parts").alias("parts"))


@query("SELECT o_custkey AS id, concat('[', string_agg(part, ',' ORDER BY part), ']') AS text FROM (SELECT o_custkey, replace(replace(concat('<\"key\":<', CAST(o_orderkey AS STRING), '>\"tags\":<<\"p\":<', o_orderpriority, '>\"s\":<', o_orderstatus, '>>>>'), '<', chr(123)), '>', chr(125)) AS part FROM {orders}) GROUP BY o_custkey")
def q_canonical(spark, d):
    """Canonical text of nested records."""
    one = F.struct(F.create_map(F.lit("s"), F.col("o_orderstatus"), F.lit("p"), F.col("o_orderpriority")).alias("tags"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("timestamp"))
    lists = frame(spark, d, "orders").select(F.col("o_custkey").alias("id"), one.alias("one"))
    each = lists.select("id", compose.canonical(F.col("one"), lists.schema["one"].dataType).alias("t"))
    return each.groupBy("id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("t")), ","), F.lit("]")).alias("text"))

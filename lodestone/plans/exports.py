"""Queries over what is exported: columns, attachments, whole diff files, ids of boundaries and networks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import attach, columns, compose, features, spatial, versions
from .queries import query
from .views import frame


def _tags(**kv) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def _text(c: Column) -> Column:
    return c.cast("string")


def _line(cols: list[Column]) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])


@query("""SELECT id, concat_ws('|', concat('f', CAST(id AS STRING)), ftype, CAST(id AS STRING), concat('n', CAST(id AS STRING)), concat('SRID=4326;POINT (', CAST(x AS STRING), ' ', CAST(y AS STRING), ')'),
CASE WHEN ftype <> 'plcpnt' THEN 'SRID=4326;P' WHEN id % 2 = 0 THEN 'SRID=4326;M' ELSE '-' END, concat('N', CAST(nation AS STRING)), concat('c', CAST(nation AS STRING)), '-', CASE WHEN id % 3 = 0 THEN 'd' ELSE '-' END,
concat('"admin_level"=>"4",', CASE WHEN id % 3 = 0 THEN '"description"=>"d",' ELSE '' END, '"name"=>"', street, '","name:de"=>"S"', CASE WHEN id % 2 = 0 THEN ',"place"=>"town"' ELSE '' END),
CASE ftype WHEN 'jncton' THEN '-' WHEN 'plcpnt' THEN CASE WHEN id % 2 = 0 THEN 'place:town' ELSE 'boundary:4' END ELSE ftype END, 'S', '-') AS line
FROM (SELECT *, CASE id % 5 WHEN 0 THEN 'hghway' WHEN 1 THEN 'adrpnt' WHEN 2 THEN 'poipnt' WHEN 3 THEN 'plcpnt' ELSE 'jncton' END AS ftype FROM {addr_pts})""")
def q_feature_columns(spark, d):
    """Columns of features by name."""
    i, n = F.col("id"), _text(F.col("nation"))
    ftype = F.element_at(geo.lits(["hghway", "adrpnt", "poipnt", "plcpnt", "jncton"]), (i % 5).cast("int") + 1)
    tags = _tags(**{"name": F.col("street"), "name:de": F.lit("S"), "admin_level": F.lit("4"), "place": F.when(i % 2 == 0, "town"), "description": F.when(i % 3 == 0, "d")})
    near = F.struct(F.concat(F.lit("c"), n).alias("id"), _tags(name=F.concat(F.lit("N"), n)).alias("tags"))
    rows = frame(spark, d, "addr_pts").select(F.concat(F.lit("f"), _text(i)).alias("id"), ftype.alias("ftype"), F.lit("node").alias("osm_type"), i.alias("osm_id"), F.col("x").alias("lon"), F.col("y").alias("lat"), tags.alias("tags"), F.lit("P").alias("wkt"), F.when(i % 2 == 0, "M").alias("matched_wkt"), near.alias("nearest_city"), F.when(F.lit(False), near).alias("nearest_hood"))
    names = ["id", "type", "osm-id", "osm-type-id", "centroid", "full-geometry", "nearest:city", "nearest:city.id", "nearest:neighbourhood", "description", "tags.hstore", "type-verbose", "name:de", "unknown"]
    return rows.select(F.col("osm_id").alias("id"), _line(columns.chosen(names, columns.feature)).alias("line"))


@query("""SELECT id, concat_ws('|', '-', CAST(hn AS STRING), street, concat('hghway-', CAST(id AS STRING)), concat('hghway-', CAST(id AS STRING), CASE id % 3 WHEN 0 THEN '-m1' WHEN 1 THEN '' ELSE '-1' END),
concat('Town ', street), '70', CASE WHEN id % 2 = 0 THEN 'B' ELSE '-' END, 'short', CAST(id AS STRING), '-') AS line FROM {addr_pts}""")
def q_address_columns(spark, d):
    """Columns of address rows by name."""
    i, lnk = F.col("id"), F.concat(F.lit("hghway-"), _text(F.col("id")))
    parts = F.array(compose.part("hn", F.col("hn")), compose.part("street", F.col("street"), None, lnk, (i % 3 - 1).cast("int")), compose.part("place:town", F.concat(F.lit("Town "), F.col("street"))))
    rows = frame(spark, d, "addr_pts").select("id", _text(i).alias("uid"), F.lit("short").alias("text"), F.lit("long").alias("long_text"), _tags(**{"addr:letter": F.when(i % 2 == 0, "B")}).alias("tags"), parts.alias("parts"))
    names = ["postcode", "hn", "street", "street.id", "street.uid", "place:town", "place:town.lvl-size", "letter", "addr-text", "uid", "boundary:4"]
    return rows.select("id", _line(columns.chosen(names, columns.address)).alias("line"))


@query("""SELECT pid, concat_ws('|', cls, concat('T ', cls), CASE WHEN pid % 2 = 0 THEN 'op' ELSE '-' END, CASE WHEN pid % 3 = 1 THEN '1' ELSE '2' END, concat('"cuisine"=>"', c, '","fee"=>"yes&#36;"'),
concat(CASE WHEN pid % 2 = 0 THEN '"Kitchen"=>"Pizza",' ELSE '' END, '"fee"=>"yes&#36;"'), concat(chr(123), '"cuisine":"', c, '","fee":"yes$"', chr(125)), CASE WHEN pid % 2 = 0 THEN 'op' ELSE 'none' END) AS line
FROM (SELECT *, CASE WHEN pid % 2 = 0 THEN 'pizza' ELSE 'other' END AS c FROM {pois})""")
def q_poi_columns(spark, d):
    """Columns of POIs by name, a caller's own provider first."""
    i = F.col("pid")
    one = lambda v: F.create_map(F.lit("en"), v)
    tags = _tags(**{"cuisine": F.when(i % 2 == 0, "pizza").otherwise("other"), "fee": F.lit("yes$"), "operator": F.when(i % 2 == 0, "op"), "contact:phone": F.when(i % 3 == 0, " ").when(i % 3 == 1, "1"), "phone": F.lit("2")})
    rows = frame(spark, d, "pois").select("pid", tags.alias("tags"), F.col("cls").alias("poi_class"), one(F.concat(F.lit("T "), F.col("cls"))).alias("titles"), geo.lits(["cuisine", "fee", "level"]).alias("more"), one(_tags(cuisine=F.lit("Kitchen"))).alias("tag_titles"), one(_tags(**{"cuisine=pizza": F.lit("Pizza")})).alias("value_titles"), geo.lits(["cuisine"]).alias("listed"))
    own = lambda name: F.coalesce(F.col("tags")["operator"], F.lit("none")) if name == "who" else None
    names = ["poi-class", "poi-class:en", "operator", "phone", "more-tags", "more-tags:en", "more-tags.json", "who"]
    return rows.select("pid", _line(columns.chosen(names, own, columns.poi)).alias("line"))


@query("SELECT concat('plcpnt-', CAST(rid AS STRING)) AS id, CASE WHEN kind < 3 THEN rid + 1 END AS neighbour FROM {places}")
def q_neighbour_places(spark, d):
    """Places with the neighbours of their cells."""
    p = frame(spark, d, "places")
    cells = p.filter("kind < 3").select(F.concat(F.lit("plcdln-"), _text(F.col("rid"))).alias("id"), F.array(F.col("rid") + 1).alias("neighbour_cities"))
    return attach.neighbour_places(p.select(F.concat(F.lit("plcpnt-"), _text(F.col("rid"))).alias("id")), cells).select("id", F.get("neighbour_cities", F.lit(0)).alias("neighbour"))


@query("SELECT a.id, CASE WHEN a.id % 4 <> 0 THEN 'w' || CAST(min(l.way) AS STRING) END AS building, CASE WHEN a.id % 4 <> 0 AND min(l.way) IS NOT NULL THEN 'yes' END AS tag FROM {addr_pts} a LEFT JOIN (SELECT way, a AS node FROM {segs} UNION ALL SELECT way, b FROM {segs}) l ON a.id = l.node GROUP BY a.id")
def q_building_attach(spark, d):
    """Node objects with the building on whose contour they are."""
    ways = frame(spark, d, "segs").select(F.col("way").alias("id"), F.array("a", "b", "a").alias("nodes"), F.create_map(F.lit("building"), F.lit("yes")).alias("tags"))
    objects = frame(spark, d, "addr_pts").select(F.when(F.col("id") % 4 == 0, "w").otherwise("n").alias("kind"), F.col("id").alias("osm_id"))
    links = features.building_links(ways, objects.select("kind", F.col("osm_id").alias("id")))
    out = attach.with_building(objects, links, ways.select(F.col("id").alias("osm_id"), F.concat(F.lit("w"), _text(F.col("id"))).alias("id"), "tags"))
    return out.select(F.col("osm_id").alias("id"), F.col("building.id").alias("building"), F.col("building.properties")["building"].alias("tag"))


@query("""SELECT p.pid, coalesce(string_agg(n.ref, ',' ORDER BY n.rn), '') AS refs FROM {pois} p LEFT JOIN (SELECT pid, ref, rn FROM (SELECT p.pid, concat('a', CAST(a.id AS STRING), '=', a.street) AS ref,
row_number() OVER (PARTITION BY p.pid ORDER BY (a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y), concat('a', CAST(a.id AS STRING))) AS rn FROM {pois} p JOIN {addr_pts} a ON abs(a.x - p.x) <= 2500 AND abs(a.y - p.y) <= 2500) WHERE rn <= 3) n ON n.pid = p.pid GROUP BY p.pid""")
def q_nearby_refs(spark, d):
    """References of the three nearest addresses of each POI."""
    pois = frame(spark, d, "pois").select("pid", "x", "y")
    points = frame(spark, d, "addr_pts").select(F.concat(F.lit("a"), _text(F.col("id"))).alias("ref"), "street", "x", "y")
    met = spatial.nearest_in_squares(pois, points, 2_500, 3, 5_000.0, "ref")
    d2 = (F.col("r.x") - F.col("l.x")) * (F.col("r.x") - F.col("l.x")) + (F.col("r.y") - F.col("l.y")) * (F.col("r.y") - F.col("l.y"))
    near = met.select("l.pid", d2.cast("double").alias("d"), F.struct(F.col("r.ref").alias("id"), _tags(name=F.col("r.street")).alias("tags")).alias("o"))
    out = attach.with_nearby(pois.select("pid"), near, "pid", "d", "o", 3, "refs")
    return out.select("pid", F.array_join(F.transform("refs", lambda r: F.concat(r["id"], F.lit("="), r["properties"]["name"])), ",").alias("refs"))


@query("SELECT CAST(nation % 5 AS INT) AS lvl, count(*) AS n FROM {addr_pts} WHERE nation % 5 > 0 AND id % 7 <> 0 GROUP BY ALL")
def q_boundary_levels(spark, d):
    """Boundaries by admin level; those without a level go."""
    level = F.when(F.col("id") % 7 == 0, "none").otherwise(_text(F.col("nation") % 5))
    return attach.levels(frame(spark, d, "addr_pts").select("id", _tags(admin_level=level).alias("tags")))


@query("SELECT concat_ws(chr(9), CAST(rid AS STRING), CAST(rx AS STRING), CAST(ry AS STRING), CASE WHEN kind = 3 THEN 'neighbour' ELSE 'city' END, name) AS value FROM {places}")
def q_city_index(spark, d):
    """Lines of the city index."""
    p = frame(spark, d, "places")
    return attach.city_index(p.select(F.col("rid").alias("osm_id"), F.col("rx").alias("lon"), F.col("ry").alias("lat"), (F.col("kind") == 3).alias("neighbour"), F.col("name").alias("body")))


_SUM = "CAST(CAST(sum(CAST(CAST(concat('0x', substr(m, {at}, 15)) AS BIGINT) AS HUGEINT)) AS HUGEINT) AS STRING)"


def _head(which: str) -> str:
    sums = ", ".join(_SUM.replace("{at}", str(at)) for at in (1, 16))
    table = "{snap_" + which + "}"
    return f"""SELECT concat('@{which}-timestamp ', strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%gZ')) AS value FROM {table}
UNION ALL SELECT concat('@{which}-hash ', concat_ws('-', CAST(count(*) AS STRING), {sums})) FROM (SELECT md5(concat_ws('|', CAST(id AS STRING), hash)) AS m FROM {table})"""


def _diff_file(full: bool) -> None:
    gone = "concat('old ', CAST(id AS STRING))" if full else "concat(chr(123), '\"id\":\"', CAST(id AS STRING), '\"', chr(125))"

    @query(f"""SELECT unnest(['@diff-generation-ts 2024-01-01', '@old-file a.json', '@new-file b.json']) AS value UNION ALL {_head("old")} UNION ALL {_head("new")}
UNION ALL SELECT concat(op, ' ', CASE WHEN op IN ('+', 'N') THEN concat('new ', CAST(id AS STRING)) ELSE {gone} END) FROM (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN '+' WHEN n.id IS NULL THEN '-' WHEN o.ts < n.ts THEN 'N' ELSE 'O' END AS op
FROM {{snap_old}} o FULL JOIN {{snap_new}} n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.hash <> n.hash)""")
    def run(spark, d):
        body = lambda which: frame(spark, d, f"snap_{which}").withColumn("body", F.concat(F.lit(f"{which} "), _text(F.col("id"))))
        return versions.diff_file(body("old"), body("new"), ("a.json", "b.json"), "2024-01-01", full)

    from .queries import ORACLES, QUERIES

    for table in (QUERIES, ORACLES):
        table["q_diff_file_full" if full else "q_diff_file"] = table.pop("run")


_diff_file(False)
_diff_file(True)


@query("SELECT max(n) AS n FROM (SELECT max(length(CAST(id AS STRING))) AS n FROM {snap_old} UNION ALL SELECT max(length(CAST(id AS STRING))) FROM {snap_new})")
def q_longest_key(spark, d):
    """Length in bytes of the longest id of two dumps."""
    return versions.longest_key(frame(spark, d, "snap_old"), frame(spark, d, "snap_new"))


@query("""SELECT id, count(DISTINCT v) FILTER (v > lo AND v < hi) AS n, min(v) FILTER (v > lo AND v < hi) AS first, max(v) FILTER (v > lo AND v < hi) AS last FROM
(SELECT id, lo, hi, round(floor((lo + i * CAST(0.1 AS DOUBLE)) / CAST(0.1 AS DOUBLE) + 0.5) * CAST(0.1 AS DOUBLE), 4) AS v FROM (SELECT id, lo, lo + CAST(0.35 AS DOUBLE) AS hi, unnest(range(0, 4)) AS i FROM (SELECT id, CAST(x AS DOUBLE) / 1000 AS lo FROM {addr_pts}))) GROUP BY id""")
def q_blades(spark, d):
    """Stripe edges that cut a box."""
    lo = F.col("x").cast("double") / 1000
    cut = frame(spark, d, "addr_pts").select("id", geo.blades(lo, lo + 0.35).alias("b"))
    return cut.select("id", F.size("b").cast("long").alias("n"), F.array_min("b").alias("first"), F.array_max("b").alias("last"))


@query("SELECT id, CASE WHEN id % 3 < 2 THEN hn END AS hn, CASE WHEN id % 3 = 2 THEN street END AS street FROM {addr_pts}")
def q_union_parts(spark, d):
    """Parts of a table, some without a column."""
    a = frame(spark, d, "addr_pts")
    return attach.union_parts([a.filter("id % 3 = 0").select("id", "hn"), a.filter("id % 3 = 1").select("hn", "id"), a.filter("id % 3 = 2").select("id", "street")])


@query("""WITH t AS (SELECT bid, 1 AS k, concat('b4-', CAST(bid AS STRING), 'b2-', CAST(region AS STRING)) AS s FROM {nation_box} UNION ALL SELECT bid, 2, concat('old ', lower(bname), ' x') FROM {nation_box}),
c AS (SELECT bid, k, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i, length(s) AS n FROM t),
p AS (SELECT bid, k, list_reduce(list(ascii(c) ORDER BY i), lambda a, b: (a * 31 + b) % 4294967296) AS v FROM (SELECT bid, k, i, CAST(ascii(c) AS BIGINT) AS c0, c FROM c) GROUP BY bid, k),
h AS (SELECT bid, max(CASE WHEN k = 1 THEN v END) AS b, max(CASE WHEN k = 2 THEN v END) AS s FROM (SELECT bid, k, CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS v FROM p) GROUP BY bid)
SELECT bid AS id, CAST(b AS INT) AS hash, replace(concat('hghnet-', replace(CAST(b AS STRING), '-', 'm'), '-', replace(CAST(s AS STRING), '-', 'm')), '.0', '') AS net FROM h""".replace("list(ascii(c) ORDER BY i)", "list(c0 ORDER BY i)"))
def q_network_id(spark, d):
    """Hash of an object's boundaries, and the id of its street network."""
    box = frame(spark, d, "nation_box")
    of = lambda prefix, key, level: F.struct(F.concat(F.lit(prefix), _text(F.col(key))).alias("id"), _tags(admin_level=F.lit(level), name=F.lit("N")).alias("tags"))
    hashed = compose.boundaries_hash(compose.by_size(F.array(of("b2-", "region", "2"), of("b9-", "bid", "9"), of("b4-", "bid", "4"))))
    names = F.array(F.upper("bname"), F.concat(F.col("bname"), F.lit(" X")), F.concat(F.lit("Old "), F.col("bname"), F.lit(" x")), F.lit("zzz"))
    rows = box.select(F.col("bid").alias("id"), hashed.alias("hash"), names.alias("names"))
    return rows.select("id", "hash", compose.network_id(F.col("hash"), F.col("names")).alias("net"))


@query("SELECT way, (x1 + x2) / 2.0 AS x, (y1 + y2) / 2.0 AS y FROM {seg_lines}")
def q_midpoint(spark, d):
    """Points at half the length of lines."""
    at = lambda x, y: F.struct(F.col(x).cast("double").alias("lon"), F.col(y).cast("double").alias("lat"))
    lines = frame(spark, d, "seg_lines").select("way", F.array(at("x1", "y1"), at("x2", "y2")).alias("line"))
    return lines.select("way", geo.point_along(F.col("line"), geo.line_length(F.col("line")) / 2).alias("p")).select("way", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))

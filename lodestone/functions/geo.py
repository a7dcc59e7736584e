"""Scalar functions over coordinates, ids and geometry arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Hilbert states' quadrant numbers and next states, by state * 4 + 2 * x bit + y bit.
HILBERT_POSITION = (0, 1, 3, 2, 2, 1, 3, 0, 2, 3, 1, 0, 0, 3, 1, 2)
HILBERT_NEXT = (3, 0, 1, 0, 1, 1, 0, 2, 2, 3, 2, 1, 0, 2, 3, 3)
# Sizes of address levels.
LEVEL_SIZES = {
    "letter": 8, "hn": 10, "street": 20, "place:quarter": 30, "place:neighbourhood": 40, "place:suburb": 50,
    "boundary:10": 51, "boundary:9": 52, "postcode": 55, "place:allotments": 60, "place:locality": 70,
    "place:isolated_dwelling": 70, "place:village": 70, "place:hamlet": 70, "place:town": 70, "place:city": 70,
    "boundary:8": 80, "boundary:7": 85, "boundary:6": 90, "boundary:5": 100, "boundary:4": 110, "boundary:3": 120, "boundary:2": 130,
}


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def stripe_key(lon: Column, x10: bool = False) -> Column:
    """Longitude stripe of 0.1 degree (0.01 with x10), zero padded."""
    n, width = (100, 5) if x10 else (10, 4)
    return F.format_string(f"%0{width}d", F.floor((lon + 180) * n))


def snapped(lon: Column, width: float = 0.1, places: int = 4) -> Column:
    """The grid line of a width that is nearest to a longitude."""
    return F.round(F.floor(lon / width + 0.5) * width, places)


def blades(minx: Column, maxx: Column, width: float = 0.1) -> Column:
    """Grid lines that cut a box: of steps of the width from its left edge, the nearest line if it is strictly inside."""
    steps = F.sequence(F.lit(0), F.floor((maxx - minx) / width).cast("int"))
    return F.array_distinct(F.filter(F.transform(steps, lambda i: snapped(minx + i * width, width)), lambda x: (x > minx) & (x < maxx)))


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lon + 180) / 360 * n))).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    n, r = 1 << zoom, F.radians(lat)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / 3.141592653589793) / 2 * n))).cast("int")


def shifted(lon: Column) -> Column:
    """Longitude moved by -90 degrees around the globe, so that the antimeridian is inside."""
    return F.when(lon - 90 < -180, lon + 270).otherwise(lon - 90)


def unshifted(lon: Column) -> Column:
    return F.when(lon + 90 > 180, lon - 270).otherwise(lon + 90)


def hilbert(x: Column, y: Column) -> Column:
    """Position of integer coordinates on a Hilbert curve over their 16 low bits."""
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("pos"))

    def step(a: Column, i: Column) -> Column:
        bit = lambda v: F.call_function("getbit", v.cast("long"), i).cast("int")
        at = a["state"] * 4 + bit(x) * 2 + bit(y) + 1
        return F.struct(F.element_at(lits(HILBERT_NEXT), at).alias("state"), (a["pos"] * 4 + F.element_at(lits(HILBERT_POSITION), at)).alias("pos"))

    return F.aggregate(lits(range(15, -1, -1)), start, step, lambda a: a["pos"])


def feature_id(ftype: Column, hilbert_pos: Column, kind: Column, osm_id: Column, counter: Column | None = None) -> Column:
    base = F.concat(ftype, F.format_string("-%010d-", hilbert_pos), kind, osm_id.cast("string"))
    return F.concat(base, F.coalesce(F.concat(F.lit("-"), counter.cast("string")), F.lit(""))) if counter is not None else base


def hilbert_decode(pos: Column) -> Column:
    """x and y (16 bits) of a position on the curve."""
    corner = [HILBERT_POSITION[state * 4 : state * 4 + 4].index(q) for state in range(4) for q in range(4)]
    after = [HILBERT_NEXT[i // 4 * 4 + k] for i, k in enumerate(corner)]
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("state"), zero.alias("x"), zero.alias("y"))

    def step(a: Column, i: Column) -> Column:
        at = (a["state"] * 4 + F.call_function("getbit", pos, i * 2 + 1).cast("int") * 2 + F.call_function("getbit", pos, i * 2).cast("int") + 1).cast("int")
        k = F.element_at(lits(corner), at)
        return F.struct(F.element_at(lits(after), at).alias("state"), (a["x"] * 2 + F.floor(k / 2)).cast("long").alias("x"), (a["y"] * 2 + k % 2).cast("long").alias("y"))

    return F.aggregate(lits(range(15, -1, -1)), start, step, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y")))


def java_hash(text: Column) -> Column:
    """The 32-bit polynomial hash over UTF-16 units."""
    h = F.hex(F.encode(text, "UTF-16BE"))
    places = F.when(F.length(h) > 0, F.sequence(F.lit(0).cast("long"), (F.length(h) / 4 - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    unit = lambda i: F.conv(F.substring(h, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long")
    low = F.aggregate(places, F.lit(0).cast("long"), lambda a, i: (a * 31 + unit(i)).bitwiseAND(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def row_uid(ftype: Column, fid: Column, scheme: Column, boundaries_hash: Column, linked: Column) -> Column:
    """Id of an address row: streets by the hash of their boundaries, addresses and POIs by scheme."""
    signed = F.when(boundaries_hash < 0, F.concat(F.lit("m"), (-boundaries_hash.cast("long")).cast("string"))).otherwise(boundaries_hash.cast("string"))
    street = F.when(boundaries_hash == 0, fid).otherwise(F.concat(fid, F.lit("--"), signed))
    poi = F.concat(fid, F.coalesce(F.concat(F.lit("-"), linked), F.lit("")), F.lit("--"), F.coalesce(scheme, F.lit("")))
    return F.when(ftype == "hghway", street).when(ftype == "adrpnt", F.concat(fid, F.lit("--"), F.coalesce(scheme, F.lit("")))).when(ftype == "poipnt", poi).otherwise(fid)


def house_number(text: Column) -> Column:
    """Leading integer of a house number, or null."""
    return F.expr("null").cast("int") if text is None else F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*(\d{1,5})", 1), F.lit("")), F.lit("99999")).cast("int")


def addr_level(tags: Column) -> Column:
    """place:<place> if supported, else boundary:<admin_level>, else street if it is a highway."""
    place, admin = F.concat(F.lit("place:"), tags["place"]), F.concat(F.lit("boundary:"), tags["admin_level"])
    return F.when(place.isin(list(LEVEL_SIZES)), place).when(admin.isin(list(LEVEL_SIZES)), admin).when(tags["highway"].isNotNull(), F.lit("street"))


def level_size(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in LEVEL_SIZES.items() for v in kv]), level)


def hstore(tags: Column, escaped: bool = False) -> Column:
    """Entries of a map by key, as "k"=>"v"; escaped also writes dollar signs as entities."""
    plain = lambda v: F.replace(v, F.lit('"'), F.lit('\\"'))
    value = (lambda v: F.replace(plain(v), F.lit("$"), F.lit("&#36;"))) if escaped else plain
    pair = lambda e: F.concat(F.lit('"'), e["key"], F.lit('"=>"'), value(e["value"]), F.lit('"'))
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), pair), ",")


def ewkt_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("SRID=4326;POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def _edges(ring: Column) -> Column:
    """Pairs of neighbours of a ring (array of structs lon, lat), closed if it isn't."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(ring, i).alias("a"), F.coalesce(F.get(ring, i + 1), F.get(ring, F.lit(0))).alias("b")))


def in_ring(x: Column, y: Column, ring: Column, inclusive: bool = True) -> Column:
    """Point in ring by crossing parity; points on the boundary are in or out as asked."""

    def on(e: Column) -> Column:
        cross = (e["b"]["lon"] - e["a"]["lon"]) * (y - e["a"]["lat"]) - (e["b"]["lat"] - e["a"]["lat"]) * (x - e["a"]["lon"])
        return (cross == 0) & x.between(F.least(e["a"]["lon"], e["b"]["lon"]), F.greatest(e["a"]["lon"], e["b"]["lon"])) & y.between(F.least(e["a"]["lat"], e["b"]["lat"]), F.greatest(e["a"]["lat"], e["b"]["lat"]))

    def crosses(e: Column) -> Column:
        high = (e["a"]["lat"] > y) != (e["b"]["lat"] > y)
        at = (e["b"]["lon"] - e["a"]["lon"]) * (y - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0)) + e["a"]["lon"]
        return high & F.coalesce(x < at, F.lit(False))

    edges = _edges(ring)
    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.exists(edges, on) | inside if inclusive else ~F.exists(edges, on) & inside


def in_polygon(x: Column, y: Column, outers: Column, inners: Column, inclusive: bool = True) -> Column:
    """In some outer ring and strictly inside no inner ring."""
    return F.exists(outers, lambda r: in_ring(x, y, r, inclusive)) & ~F.exists(inners, lambda r: in_ring(x, y, r, not inclusive))


def ring_area(ring: Column) -> Column:
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])) / 2


def line_length(line: Column) -> Column:
    return F.aggregate(F.slice(_edges(line), 1, F.greatest(F.size(line) - 1, F.lit(0))), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["lon"] - e["a"]["lon"], e["b"]["lat"] - e["a"]["lat"]))


def point_along(line: Column, length: Column) -> Column:
    """Point (struct lon, lat) at a length along a line; its last vertex beyond the end."""
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("struct<lon:double,lat:double>").alias("at"))

    def step(a: Column, e: Column) -> Column:
        d = F.hypot(e["b"]["lon"] - e["a"]["lon"], e["b"]["lat"] - e["a"]["lat"])
        share = (length - a["done"]) / F.nullif(d, F.lit(0.0))
        here = a["at"].isNull() & (a["done"] + d >= length)
        point = F.struct((e["a"]["lon"] + F.coalesce(share, F.lit(0.0)) * (e["b"]["lon"] - e["a"]["lon"])).alias("lon"), (e["a"]["lat"] + F.coalesce(share, F.lit(0.0)) * (e["b"]["lat"] - e["a"]["lat"])).alias("lat"))
        return F.struct((a["done"] + d).alias("done"), F.when(here, point).otherwise(a["at"]).alias("at"))

    segments = F.slice(_edges(line), 1, F.greatest(F.size(line) - 1, F.lit(0)))
    return F.coalesce(F.aggregate(segments, start, step, lambda a: a["at"]), F.element_at(line, -1))


def line_between(line: Column, start: Column, end: Column) -> Column:
    """The piece of a line between two lengths along it."""
    first = F.array(F.lit(0.0))
    far = F.aggregate(F.slice(_edges(line), 1, F.greatest(F.size(line) - 1, F.lit(0))), first, lambda a, e: F.concat(a, F.array(F.element_at(a, -1) + F.hypot(e["b"]["lon"] - e["a"]["lon"], e["b"]["lat"] - e["a"]["lat"]))))
    inner = F.filter(line, lambda v, i: (F.get(far, i) > start) & (F.get(far, i) < end))
    return F.concat(F.array(point_along(line, start)), inner, F.array(point_along(line, end)))


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = (bx - ax).cast("double"), (by - ay).cast("double")
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(n == 0, 1.0).otherwise(n))))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def rounded(value: Column, places: int) -> Column:
    """A double of at least zero and below 2**52 / 10**places, rounded half up in binary, without a decimal for each value."""
    v = value * float(10**places)
    low = F.floor(v)
    return (low + F.when(v - low >= 0.5, 1).otherwise(0)) / float(10**places)

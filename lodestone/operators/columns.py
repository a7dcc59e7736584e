"""CSV columns by name: of features, address rows and POIs.

A provider takes a name and gives a Column, or None if it does not know the
name; `chosen` asks the providers in turn, so a caller may put its own first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import contact
from .address import tag_names

Provider = Callable[[str], "Column | None"]
# The names of columns.
FEATURE = ("id", "type", "osm-id", "osm-type", "osm-type-id", "lon", "lat", "centroid", "full-geometry", "nearest:city", "nearest:city.id", "nearest:neighbourhood", "nearest:neighbourhood.id", "description", "wikipedia", "tags.json", "tags.hstore", "type-verbose")
CONTACTS = ("phone", "fax", "website", "email")
PLAIN = ("operator", "opening_hours", "brand")


def chosen(names: list[str], *providers: Provider) -> list[Column]:
    """A column for each name, null where no provider knows it."""
    return [next((c for p in providers if (c := p(n)) is not None), F.lit(None).cast("string")).alias(n) for n in names]


def verbose_type(ftype: Column, tags: Column) -> Column:
    """The type itself, but for places their kind or admin level; null for other types."""
    given = lambda key: F.nullif(F.trim(tags[key]), F.lit(""))
    place = F.coalesce(F.concat(F.lit("place:"), given("place")), F.concat(F.lit("boundary:"), given("admin_level")))
    return F.when(ftype.isin("hghway", "poipnt", "adrpnt"), ftype).when(ftype == "plcpnt", place)


def feature(name: str) -> Column | None:
    """Rows: id, ftype, osm_type, osm_id, lon, lat (of the centre), tags, wkt, matched_wkt (a place's boundary), nearest_city and nearest_hood (structs id, tags)."""
    c, tags = F.col, F.col("tags")
    plain = {"id": "id", "type": "ftype", "osm-type": "osm_type", "osm-id": "osm_id", "lon": "lon", "lat": "lat"}
    if name in plain:
        return c(plain[name])
    if name == "osm-type-id":
        return F.concat(F.substring("osm_type", 1, 1), c("osm_id").cast("string"))
    if name == "centroid":
        return geo.ewkt_point(c("lon"), c("lat"))
    if name == "full-geometry":
        return F.concat(F.lit("SRID=4326;"), F.when(c("ftype") == "plcpnt", c("matched_wkt")).otherwise(c("wkt")))
    if name.startswith("nearest:") and name in FEATURE:
        near = c("nearest_city" if "city" in name else "nearest_hood")
        return near["id"] if name.endswith(".id") else near["tags"]["name"]
    if name == "tags.json":
        return F.to_json(tags)
    if name == "tags.hstore":
        return geo.hstore(tags)
    if name == "type-verbose":
        return verbose_type(c("ftype"), tags)
    return tags[name] if name in ("description", "wikipedia") or "name" in name else None


def address(name: str) -> Column | None:
    """Rows: tags, uid, text, long_text and parts (as of an address row)."""
    if name in ("uid", "addr-text", "addr-long-text"):
        return F.col({"uid": "uid", "addr-text": "text", "addr-long-text": "long_text"}[name])
    if name == "letter":
        return F.col("tags")["addr:letter"]
    level, _, what = name.partition(".")
    if level not in geo.LEVEL_SIZES or what not in ("", "id", "uid", "lvl-size"):
        return None
    part = F.get(F.filter("parts", lambda p: p["lvl"] == level), F.lit(0))
    if what == "uid" and level == "street":
        signed = F.replace(part["uid"].cast("string"), F.lit("-"), F.lit("m"))
        return F.when(part["uid"] == 0, part["lnk"]).otherwise(F.concat(part["lnk"], F.lit("-"), signed))
    return {"": part["name"], "id": part["lnk"], "uid": part["lnk"], "lvl-size": part["size"].cast("string")}[what]


def poi(name: str) -> Column | None:
    """Rows: tags, poi_class, titles (language to class title), more (array of tag keys), tag_titles (language to key titles), value_titles (language to titles of key=value) and listed (keys whose values are a closed list).

    With a language, keys and the values of closed lists are translated; a value without a title is left out.
    """
    tags = F.col("tags")
    if name in PLAIN:
        return tags[name]
    if name in CONTACTS:
        return contact(tags, name)
    head, _, form = name.partition(".")
    head, _, lang = head.partition(":")
    if head == "poi-class" and not form:
        return F.col("titles")[lang] if lang else F.col("poi_class")
    if head != "more-tags" or form not in ("", "json", "hstore"):
        return None
    kept = F.map_filter(tags, lambda k, v: F.array_contains("more", k) & (F.coalesce(F.trim(v), F.lit("")) != ""))
    if lang:
        title = lambda k, v: F.col("value_titles")[lang][F.concat(k, F.lit("="), v)]
        kept = F.map_filter(F.transform_values(kept, lambda k, v: F.when(F.array_contains("listed", k), title(k, v)).otherwise(v)), lambda k, v: v.isNotNull())
        kept = F.transform_keys(kept, lambda k, v: F.coalesce(F.col("tag_titles")[lang][k], k))
    return F.to_json(kept) if form == "json" else geo.hstore(kept, escaped=True)


def keywords(tags: Column, titles: Column, words: Column) -> Column:
    """What a POI is searched by: its name tags, the titles of its class and the words of the catalog, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.map_values(tag_names(tags)), F.map_values(titles), words), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")))

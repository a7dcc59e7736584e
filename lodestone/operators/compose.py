"""Address rows: a part for each level from tags, streets, places and boundaries, ids of boundaries and networks.

Objects are structs with `id` (string) and `tags` (map); a part is a struct of
PART.  Every step is a Column expression, and `Strategy` holds those that a
caller may replace.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions import geo
from ..functions.text import names_match
from .address import ranks, tag_names

PART = "struct<lvl:string,size:int,name:string,names:map<string,string>,lnk:string,uid:int>"
# Levels whose boundaries make up the hash of an object's boundaries, and those that a city is taken from, in order.
HASHED = ("place:hamlet", "place:village", "place:town", "place:city", "boundary:8", "boundary:7", "boundary:6", "boundary:5", "boundary:4", "boundary:3", "boundary:2")
CITIES = ("place:hamlet", "place:village", "place:town", "place:city", "boundary:8")


@dataclass(frozen=True)
class Strategy:
    """What a caller may replace: the layout, how names match, levels left out of the short text, the size above which levels are compared."""

    order: str = "hn_street_city"
    street_match: Callable[[Column, Column], Column] = names_match
    place_match: Callable[[Column, Column], Column] = names_match
    skip: tuple[str, ...] = ()
    from_size: int = 55


def part(lvl: Column | str, name: Column, names: Column | None = None, lnk: Column | None = None, uid: Column | None = None) -> Column:
    lvl = F.lit(lvl) if isinstance(lvl, str) else lvl
    null = F.lit(None)
    own = F.struct(lvl.alias("lvl"), geo.level_size(lvl).alias("size"), name.cast("string").alias("name"), (null if names is None else names).cast("map<string,string>").alias("names"), (null if lnk is None else lnk).cast("string").alias("lnk"), (null if uid is None else uid).cast("int").alias("uid"))
    return own.cast(PART)


def of_object(o: Column) -> Column:
    """The part of an object at its own level."""
    return part(geo.addr_level(o["tags"]), o["tags"]["name"], tag_names(o["tags"]), o["id"])


def postcode(tags: Column) -> Column:
    """Always there; its name may be empty."""
    return part("postcode", F.coalesce(tags["addr:postcode"], F.lit("")))


def house_number(fid: Column, hn: Column, tags: Column) -> Column:
    return part("hn", F.coalesce(hn, F.lit("")), F.map_filter(tags, lambda k, v: k.isin("addr:housename", "addr:hn-orig")), fid)


def street_uid(street: Column, boundaries_hash: Column) -> Column:
    """The hash among those of a street's boundary rows, else the first of them, 0 for none."""
    return F.when(F.array_contains(street["hashes"], boundaries_hash), boundaries_hash).otherwise(F.coalesce(F.get(street["hashes"], F.lit(0)), F.lit(0)))


def street(name: Column, streets: Column, boundaries_hash: Column, ways: Column, relation_tags: Column, by: Strategy = Strategy()) -> Column:
    """The street part: the nearest associated street with a name, else the tag, linked to the nearest street of that name; null without either.

    streets: nearest first, structs id, way, tags, hashes; ways: those of the
    associated relation (null for none), whose names come before the street's.
    """
    names = lambda s: F.map_concat(tag_names(s["tags"]), F.coalesce(tag_names(relation_tags), F.create_map().cast("map<string,string>")))
    own = F.filter(streets, lambda s: F.array_contains(ways, s["way"]) & names(s)["name"].isNotNull())
    linked = F.get(F.transform(own, lambda s: part("street", names(s)["name"], names(s), s["id"], street_uid(s, boundaries_hash))), F.lit(0))
    same = F.filter(streets, lambda s: by.street_match(name, tag_names(s["tags"])))
    matched = F.get(F.transform(same, lambda s: part("street", name, tag_names(s["tags"]), s["id"], street_uid(s, boundaries_hash))), F.lit(0))
    return F.coalesce(linked, F.when(name.isNotNull(), F.coalesce(matched, part("street", name))))


def at_level(boundaries: Column, level: str) -> Column:
    return F.get(F.filter(boundaries, lambda b: geo.addr_level(b["tags"]) == level), F.lit(0))


def quarter(tags: Column, boundaries: Column, by: Strategy = Strategy()) -> Column:
    """Only where the tag is; linked to the quarter's polygon if that bears the name."""
    name, found = tags["addr:quarter"], at_level(boundaries, "place:quarter")
    hit = F.when(by.place_match(name, tag_names(found["tags"])), found)
    return F.when(name.isNotNull(), part("place:quarter", name, tag_names(hit["tags"]), hit["id"]))


def city(tags: Column, boundaries: Column, nearest: Column, by: Strategy = Strategy()) -> Column:
    """The first settlement polygon there is, else the nearest place if it bears the tag's name, else the tag."""
    name = tags["addr:city"]
    near = F.when(by.place_match(name, tag_names(nearest["tags"])) & geo.addr_level(nearest["tags"]).isNotNull(), nearest)
    found = F.coalesce(*[at_level(boundaries, level) for level in CITIES], near)
    called = F.coalesce(found["tags"]["name"], name)
    return F.when(found.isNotNull() & called.isNotNull(), part(geo.addr_level(found["tags"]), called, tag_names(found["tags"]), found["id"])).when(found.isNull() & name.isNotNull(), part("place:city", name))


def named_parts(boundaries: Column, linked: Column) -> Column:
    """Parts of the named boundaries with a level, without those already linked."""
    named = F.filter(boundaries, lambda b: geo.addr_level(b["tags"]).isNotNull() & b["tags"]["name"].isNotNull() & ~F.coalesce(F.array_contains(linked, b["id"]), F.lit(False)))
    return F.transform(named, of_object)


def by_size(boundaries: Column) -> Column:
    """Boundaries by the size of their level, then id; those without a level last."""
    at = F.transform(boundaries, lambda b, i: F.struct(F.coalesce(geo.level_size(geo.addr_level(b["tags"])), F.lit(1 << 30)).alias("size"), b["id"].alias("id"), i.alias("i")))
    return F.transform(F.array_sort(at), lambda x: F.get(boundaries, x["i"]))


def boundaries_hash(boundaries: Column) -> Column:
    """Hash of the joined ids of boundaries of the hashed levels, in their order; 0 for none."""
    ids = F.transform(F.filter(boundaries, lambda b: geo.addr_level(b["tags"]).isin(*HASHED)), lambda b: b["id"])
    return F.when(F.size(ids) > 0, geo.java_hash(F.array_join(ids, ""))).otherwise(F.lit(0))


def kept_parts(parts: Column, by: Strategy = Strategy()) -> Column:
    """Parts for the short text, by size: a larger unit goes if it is to be skipped or holds the name of the larger unit kept before it."""
    order = F.array_sort(F.transform(parts, lambda p, i: F.struct(p["size"].alias("s"), i.alias("i"))))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        p, large = F.get(parts, x["i"]), F.coalesce(x["s"] > by.from_size, F.lit(False))
        drop = large & (p["lvl"].isin(*by.skip) if by.skip else F.lit(False)) | large & F.coalesce(F.contains(F.lower(p["name"]), F.lower(a["last"])), F.lit(False))
        return F.when(drop, a).otherwise(F.struct(F.when(large, p["name"]).otherwise(a["last"]).alias("last"), F.concat(a["out"], F.array(x["i"])).alias("out")))

    return F.aggregate(order, start, step, lambda a: F.transform(a["out"], lambda i: F.get(parts, i)))


def arranged(parts: Column, order: str) -> Column:
    """Parts in a layout's order, those of one rank as they were, unknown levels last."""
    rank = F.create_map(*[F.lit(x) for kv in ranks(order).items() for x in kv])
    at = F.transform(parts, lambda p, i: F.struct(F.coalesce(F.element_at(rank, p["lvl"]), F.lit(1 << 30)).alias("r"), i.alias("i")))
    return F.transform(F.array_sort(at), lambda x: F.get(parts, x["i"]))


def joined(parts: Column, language: str | None = None) -> Column:
    """Names of the parts that have one, with commas; in a language where they have it."""
    name = lambda p: F.coalesce(p["names"][f"name:{language}"], p["name"]) if language else p["name"]
    return F.array_join(F.transform(F.filter(parts, lambda p: F.coalesce(F.trim(p["name"]), F.lit("")) != ""), name), ", ")


def address_rows(rows: DataFrame, by: Strategy = Strategy()) -> DataFrame:
    """rows: id, tags, scheme, hn, street (of the scheme), boundaries, nearest, streets, ways, relation_tags.

    Adds boundaries_hash, parts (in the layout's order), text (without levels
    that repeat), long_text (of all parts) and full (the tag of the whole address).
    """
    c, none = F.col, F.array().cast(f"array<{PART}>")
    out = rows.withColumn("boundaries_hash", boundaries_hash(c("boundaries")))
    out = out.withColumns({"_quarter": quarter(c("tags"), c("boundaries"), by), "_city": city(c("tags"), c("boundaries"), c("nearest"), by), "_street": street(c("street"), c("streets"), c("boundaries_hash"), c("ways"), c("relation_tags"), by)})
    own = F.array_compact(F.array(postcode(c("tags")), house_number(c("id"), c("hn"), c("tags")), c("_street"), c("_quarter"), c("_city")))
    out = out.withColumn("parts", F.concat(own, F.coalesce(named_parts(c("boundaries"), F.array("_quarter.lnk", "_city.lnk")), none)))
    out = out.withColumns({"_kept": kept_parts(c("parts"), by)}).withColumns({"text": joined(arranged(c("_kept"), by.order)), "parts": arranged(c("parts"), by.order)})
    return out.withColumns({"long_text": joined(c("parts")), "full": F.nullif(F.trim(c("tags")["addr:full"]), F.lit(""))}).drop("_quarter", "_city", "_street", "_kept")


def boundary_row(boundaries: Column, own: Column) -> Column:
    """Parts of an object that is no address: its named boundaries, then itself."""
    return F.concat(named_parts(boundaries, F.array().cast("array<string>")), F.filter(F.array(of_object(own)), lambda p: p["lvl"].isNotNull() & p["name"].isNotNull()))


def refer(o: Column) -> Column:
    """What another record keeps of an object."""
    return F.struct(o["id"].alias("id"), o["tags"].alias("properties"))


def nearest_first(rows: DataFrame, key: str, distance: str, value: str, most: int) -> DataFrame:
    """The nearest `most` values of each key, by distance to a millionth of a degree, then id."""
    order = Window.partitionBy(key).orderBy(F.round(distance, 6), f"{value}.id")
    near = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    return near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rn", f"{value}.id"))).alias("_n")).select(key, F.transform("_n", lambda x: x["id"]).alias("ids"))


def common_name(names: Column) -> Column:
    """Of names in order, the first, or a later one inside which or around which it stands: the longer gives way to none, the shorter to the longer."""
    return F.aggregate(F.transform(names, F.lower), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | F.contains(x, a), x).otherwise(a))


def network_id(hash_of_boundaries: Column, names: Column) -> Column:
    """Id of a street network: the hashes of its boundaries and of its common name, m for minus."""
    signed = lambda c: F.replace(c.cast("string"), F.lit("-"), F.lit("m"))
    return F.concat(F.lit("hghnet-"), signed(F.coalesce(hash_of_boundaries, F.lit(0))), F.lit("-"), signed(geo.java_hash(common_name(names))))


def canonical(value: Column, kind: DataType, skip: tuple[str, ...] = ("timestamp",)) -> Column:
    """Text of a value that does not depend on the order of keys or of list entries; null fields and skipped keys are left out."""
    entry = lambda k, v: F.concat(F.lit('"'), k, F.lit('":{'), v, F.lit("}"))
    if isinstance(kind, StructType):
        fields = sorted((f for f in kind.fields if f.name not in skip), key=lambda f: f.name)
        inner = [F.when(value[f.name].isNotNull(), entry(F.lit(f.name), canonical(value[f.name], f.dataType, skip))) for f in fields]
        return F.concat(F.lit("{"), F.concat_ws("", *inner), F.lit("}"))
    if isinstance(kind, MapType):
        keys = F.array_sort(F.filter(F.map_keys(value), lambda k: ~k.isin(*skip) & value[k].isNotNull()))
        return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: entry(k, canonical(value[k], kind.valueType, skip))), ""), F.lit("}"))
    if isinstance(kind, ArrayType):
        return F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(value, lambda x: canonical(x, kind.elementType, skip))), ","), F.lit("]"))
    return value.cast("string")


def with_md5(rows: DataFrame) -> DataFrame:
    """rows with the md5 of their canonical text."""
    return rows.withColumn("md5", F.md5(canonical(F.struct("*"), rows.schema)))


def id_parts(fid: Column) -> Column:
    """type, parts and tail of a feature id."""
    halves = F.split(fid, "--")
    words = F.filter(F.split(F.get(halves, F.lit(0)), "-"), lambda x: x != "")
    return F.struct(F.get(words, F.lit(0)).alias("type"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("parts"), F.nullif(F.trim(F.get(halves, F.lit(1))), F.lit("")).alias("tail"))

"""Address composition: schemes, part order, text filters, output levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The part orders of the three address layouts, first to last; levels of one tuple share a rank.
ORDERS = {
    "hn_street_city": (
        ("postcode",), ("hn",), ("letter",), ("street",), ("place:quarter",), ("place:neighbourhood",), ("place:suburb",), ("boundary:10",), ("place:allotments",),
        ("place:locality", "place:isolated_dwelling", "place:village", "place:hamlet", "place:town", "place:city"),
        ("boundary:8",), ("boundary:7",), ("boundary:6",), ("boundary:5",), ("boundary:4",), ("boundary:3",), ("boundary:2",),
    ),
    "street_hn_city": (
        ("postcode",), ("street",), ("hn",), ("letter",), ("place:quarter",), ("place:neighbourhood",), ("place:suburb",), ("boundary:10",), ("place:allotments",),
        ("place:locality", "place:isolated_dwelling", "place:village", "place:hamlet", "place:town", "place:city", "boundary:8"),
        ("boundary:7",), ("boundary:6",), ("boundary:5",), ("boundary:4",), ("boundary:3",), ("boundary:2",),
    ),
    "city_street_hn": (
        ("postcode",), ("boundary:2",), ("boundary:3",), ("boundary:4",), ("boundary:5",), ("boundary:6",), ("boundary:7",), ("boundary:8",),
        ("place:locality", "place:isolated_dwelling", "place:village", "place:hamlet", "place:town", "place:city", "place:allotments"),
        ("boundary:10",), ("place:suburb",), ("place:neighbourhood",), ("place:quarter",), ("street",), ("hn",), ("letter",),
    ),
}


def ranks(order: str) -> dict[str, int]:
    return {level: i for i, levels in enumerate(ORDERS[order]) for level in levels}


def part(level: str, name: Column) -> Column:
    return F.struct(F.lit(level).alias("lvl"), name.cast("string").alias("name"))


def text(parts: Column, order: str) -> Column:
    """Names of the parts in the layout's order, joined with commas; parts of one rank keep their order, blank ones and unknown levels are left out."""
    rank = F.create_map(*[F.lit(x) for kv in ranks(order).items() for x in kv])
    ranked = F.transform(parts, lambda p, i: F.struct(F.element_at(rank, p["lvl"]).alias("r"), i.alias("i"), p["name"].alias("name")))
    return F.array_join(F.transform(F.array_sort(F.filter(ranked, lambda p: p["r"].isNotNull() & (F.trim(p["name"]) != ""))), lambda p: p["name"]), ", ")


def filter_levels(parts: Column, sizes: Column, skip: Column, from_size: int = 55) -> Column:
    """Names of parts (ordered by size) without those above from_size that are to be skipped or contain the name of such a one kept before them."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("out"))
    both = F.arrays_zip(parts.alias("p"), sizes.alias("s"))

    def step(a: Column, x: Column) -> Column:
        drop = (x["s"] > from_size) & (F.array_contains(skip, x["p"]["lvl"]) | F.coalesce(F.contains(F.lower(x["p"]["name"]), F.lower(a["last"])), F.lit(False)))
        return F.when(drop, a).otherwise(F.struct(F.when(x["s"] > from_size, x["p"]["name"]).otherwise(a["last"]).alias("last"), F.concat(a["out"], F.array(x["p"]["name"])).alias("out")))

    return F.aggregate(both, start, step, lambda a: a["out"])


def schemes(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """One row for each address that the tags of an object hold: scheme, hn, street.

    Precedence: a second house number (of a second street, or of none),
    a second street with a two-part number, numbered addresses addr2, addr3 and
    so on without a gap and without end, street and conscription numbers, else
    the plain one.
    """
    t = F.col(tags)
    row = lambda scheme, hn, street: F.struct(F.lit(scheme).alias("scheme"), hn.alias("hn"), street.alias("street"))
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    hn, street, second = t["addr:housenumber"], t["addr:street"], t["addr:street2"]
    two = F.filter(F.array(row("addr:hn2.1", hn, street), row("addr:hn2.2", t["addr:housenumber2"], F.nullif(second, F.lit("")))), lambda x: (x["scheme"] != "addr:hn2.2") | given(x["hn"]))
    halves = F.filter(F.split(hn, r"[/\\;]"), lambda x: x != "")
    streets = F.when((F.size(halves) == 2) & given(street) & given(second), F.array(row("addr:street2.1", F.get(halves, F.lit(0)), street), row("addr:street2.2", F.get(halves, F.lit(1)), second))).otherwise(F.array(row("", hn, street)))
    one = lambda i, k: F.element_at(t, F.concat(F.lit("addr"), i.cast("string"), F.lit(k)))
    there = F.filter(F.sequence(F.lit(2), F.size(t) + 1), lambda i: F.map_contains_key(t, F.concat(F.lit("addr"), i.cast("string"), F.lit(":housenumber"))))
    numbers = F.filter(there, lambda x, i: x == i + 2)
    many = F.concat(F.array(row("addrN.1", hn, street)), F.transform(numbers, lambda i: F.struct(F.concat(F.lit("addrN."), i.cast("string")).alias("scheme"), one(i, ":housenumber").alias("hn"), one(i, ":street").alias("street"))))
    number = F.filter(F.array(row("addr:streetnumber", t["addr:streetnumber"], street), row("addr:conscriptionnumber", t["addr:conscriptionnumber"], street)), lambda x: F.coalesce(F.trim(x["hn"]), F.lit("")) != "")
    found = (
        F.when(t["addr:housenumber2"].isNotNull(), two)
        .when(second.isNotNull(), streets)
        .when(t["addr2:housenumber"].isNotNull(), many)
        .when(t["addr:streetnumber"].isNotNull() | t["addr:conscriptionnumber"].isNotNull(), number)
        .otherwise(F.array(row("regular", hn, street)))
    )
    return rows.withColumn("_a", F.explode(found)).select("*", "_a.*").drop("_a")


def output_levels(levels: Column) -> dict[str, Column]:
    """Output columns from a map level -> name; neighborhood differs from locality or is null."""
    at = lambda *names: F.coalesce(*[levels[n] for n in names])
    locality = at("place:city", "place:town", "place:village", "place:hamlet", "boundary:8")
    hood = at("place:neighbourhood", "boundary:10", "boundary:9", "place:town", "place:village", "place:hamlet")
    return {"admin0": at("boundary:2"), "admin1": at("boundary:3"), "admin2": at("boundary:4"), "local_admin": at("boundary:6"), "locality": locality, "neighborhood": F.when(hood != locality, hood), "street": at("street"), "housenumber": at("hn")}


def hierarchy_path(levels: dict[str, Column], uid: Column) -> Column:
    """Non-null references joined by slashes, then the row's id; null when no level is present."""
    names = ("admin0", "admin1", "admin2", "local_admin", "locality", "neighborhood", "street")
    refs = [levels[n] for n in names]
    return F.when(F.coalesce(*refs).isNotNull(), F.concat_ws("/", *refs, uid))


def tag_names(tags: Column) -> Column:
    """Entries whose key contains name."""
    return F.map_filter(tags, lambda k, v: F.contains(k, F.lit("name")))


def languages_of_all(lists: Column) -> Column:
    """Languages that every list has."""
    return F.array_sort(F.aggregate(lists, F.get(lists, F.lit(0)), lambda a, x: F.array_intersect(a, x)))

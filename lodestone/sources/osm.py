"""OpenStreetMap XML dumps (plain, .gz, .bz2) as tables of nodes, ways and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = "tag array<struct<_k:string,_v:string>>"
SCHEMAS = {
    "node": f"_id bigint, _lat double, _lon double, _timestamp timestamp, {_TAG}",
    "way": f"_id bigint, nd array<struct<_ref:bigint>>, {_TAG}",
    "relation": f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {_TAG}",
}


def _tags() -> Column:
    """Tags as a map; of a repeated key the last value counts."""
    pairs = F.coalesce(F.col("tag"), F.array().cast("array<struct<_k:string,_v:string>>"))
    last = lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["_k"] == x["_k"])
    return F.map_from_entries(F.transform(F.filter(F.filter(pairs, last), lambda x: x["_k"].isNotNull()), lambda x: F.struct(x["_k"], x["_v"])))


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", kind).schema(SCHEMAS[kind]).load(path)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "node").select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tags().alias("tags"), F.col("_timestamp").alias("ts"))


def ways(spark: SparkSession, path: str) -> DataFrame:
    refs = F.transform(F.coalesce("nd", F.array().cast("array<struct<_ref:bigint>>")), lambda x: x["_ref"])
    return _read(spark, path, "way").select(F.col("_id").alias("id"), refs.alias("nodes"), _tags().alias("tags"))


def relations(spark: SparkSession, path: str) -> DataFrame:
    none = F.array().cast("array<struct<_type:string,_ref:bigint,_role:string>>")
    members = F.transform(F.coalesce("member", none), lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.nullif(m["_role"], F.lit("")).alias("role")))
    return _read(spark, path, "relation").select(F.col("_id").alias("id"), members.alias("members"), _tags().alias("tags"))


def split(spark: SparkSession, path: str, out: str, append: bool = False) -> None:
    """Store the three kinds as Parquet, so that later passes prune columns and push filters down."""
    for name, read in (("nodes", nodes), ("ways", ways), ("relations", relations)):
        read(spark, path).write.mode("append" if append else "overwrite").parquet(f"{out}/{name}")


def drop_listed(rows: DataFrame, kind: str, listed: DataFrame) -> DataFrame:
    """Rows whose kind letter and id are not in the column `ref` of the drop list."""
    return rows.join(listed.select(F.col("ref").alias("_ref")), F.concat(F.lit(kind), F.col("id").cast("string")) == F.col("_ref"), "left_anti")


def youngest(node_rows: DataFrame) -> DataFrame:
    return node_rows.agg(F.max("ts").alias("youngest"))


def fallback(spark: SparkSession, path: str) -> DataFrame:
    """Stored boundaries: id, timestamp and WKT, parted by tabs."""
    return spark.read.schema("id string, ts timestamp, wkt string").csv(path, sep="\t")


def common(spark: SparkSession, path: str) -> DataFrame:
    """Common features: a JSON array of objects."""
    return spark.read.schema("id string, properties map<string,string>").json(path, multiLine=True)


def stripes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Features stored as a JSON document a line; damaged files are passed over."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").json(path)


# --- predicates over tags -------------------------------------------------------------------

PLACES = ("city", "town", "hamlet", "village", "isolated_dwelling")
NEIGHBOURHOODS = ("suburb", "neighbourhood", "quarter")


def is_boundary(t: Column) -> Column:
    return F.coalesce((t["boundary"] == "administrative") & t["admin_level"].isin([str(i) for i in range(1, 11)]) & (F.coalesce(t["maritime"], F.lit("")) != "yes"), F.lit(False))


def is_place(t: Column) -> Column:
    return F.coalesce(t["place"].isin(list(PLACES)), F.lit(False))


def is_neighbourhood(t: Column) -> Column:
    return F.coalesce(t["place"].isin(list(NEIGHBOURHOODS)), F.lit(False))


def is_address(t: Column) -> Column:
    return t["addr:housenumber"].isNotNull()


def is_interpolation(t: Column) -> Column:
    return t["addr:interpolation"].isNotNull()


def is_highway(t: Column) -> Column:
    return F.coalesce(~t["highway"].isin("bus_stop", "platform"), F.lit(False)) & t["name"].isNotNull()


def is_associated_street(t: Column) -> Column:
    return F.coalesce(t["type"] == "associatedStreet", F.lit(False))


def is_building(t: Column) -> Column:
    return t["building"].isNotNull() | t["building:part"].isNotNull() | F.coalesce(t["type"] == "building", F.lit(False))


def outer_refs(members: Column) -> Column:
    return F.filter(members, lambda m: (m["type"] == "way") & (F.coalesce(m["role"], F.lit("outer")) == "outer"))


def inner_refs(members: Column) -> Column:
    return F.filter(members, lambda m: (m["type"] == "way") & (m["role"] == "inner"))


def poi_classes(rows: DataFrame, catalog: DataFrame, excluded: tuple[str, ...] = (), named: tuple[str, ...] = ()) -> DataFrame:
    """Rows with `classes`, of a catalog (class, branch, tag_key, tag_val; * for any value).

    Classes of `named` branches alone need a name.  The catalog is a file of a
    few thousand rows; Catalyst broadcasts it while it is.
    """
    tags = rows.select("id", F.explode("tags").alias("tag_key", "v"), F.map_contains_key("tags", F.lit("name")).alias("has_name"))
    wanted = catalog.filter(~F.col("branch").isin(list(excluded))) if excluded else catalog
    hit = tags.join(wanted, "tag_key").filter((F.col("tag_val") == "*") | (F.col("tag_val") == F.col("v")))
    all_named = F.min(F.col("branch").isin(list(named)).cast("int")) == 1 if named else F.lit(False)
    found = hit.groupBy("id").agg(F.array_sort(F.collect_set("class")).alias("classes"), all_named.alias("needs"), F.first("has_name").alias("has_name"))
    return rows.join(found.filter("not needs or has_name").select("id", "classes"), "id")

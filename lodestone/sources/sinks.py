"""Sinks: JSON lines, CSV, plain text, diff files, OSM tiles; several may write one table."""

from __future__ import annotations

from typing import Protocol
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sink(Protocol):
    def write(self, rows: DataFrame, path: str) -> None: ...


def _least(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key: the least of its rows, in column order (by JSON form where a map can't be compared)."""
    whole = F.struct("*")
    plain = "map<" not in rows.schema.simpleString()
    least = F.min(whole) if plain else F.min_by(whole, F.to_json(whole))
    return rows.groupBy(F.col(key).alias("_key")).agg(least.alias("_row")).select("_row.*")


class JsonSink:
    """A record a line, compressed.

    sort: unique (streets once for each id, all else as it is; the default), none,
    id or hierarchy (by hhash, descending), the last two with inverse order.
    """

    def __init__(self, sort: str = "unique", inverse: bool = False, compression: str = "gzip"):
        self.sort, self.inverse, self.compression = sort, inverse, compression

    def arranged(self, rows: DataFrame) -> DataFrame:
        if self.sort == "unique":
            street = F.col("id").startswith("hghway")
            return _least(rows.filter(street), "id").unionByName(rows.filter(~F.coalesce(street, F.lit(False))))
        key = {"id": "id", "hierarchy": "hhash"}.get(self.sort)
        if not key:
            return rows
        down = self.inverse if key == "id" else not self.inverse
        return _least(rows, key).orderBy(F.desc(key) if down else F.asc(key))

    def write(self, rows: DataFrame, path: str) -> None:
        self.arranged(rows).write.json(path, compression=self.compression)


class CsvSink:
    """Tab-separated columns of rows of the given feature types; a list is a group of which the first present value counts.  Lines are distinct and sorted by uid, else whole."""

    def __init__(self, columns: list, header: bool = False, types: list[str] | None = None):
        self.columns, self.header, self.types = columns, header, types

    def arranged(self, rows: DataFrame) -> DataFrame:
        own = rows.filter(F.col("ftype").isin(self.types)) if self.types else rows
        cols = [F.coalesce(*c).alias(c[0]) if isinstance(c, (list, tuple)) else F.col(c) for c in self.columns]
        out = own.select(*cols).distinct()
        return out.orderBy(*(["uid"] if "uid" in out.columns else out.columns))

    def write(self, rows: DataFrame, path: str) -> None:
        self.arranged(rows).write.csv(path, sep="\t", header=self.header)


class TextSink:
    """A JSON document a line, uncompressed."""

    def write(self, rows: DataFrame, path: str) -> None:
        rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


class StripeSink:
    """Rows in folders of their longitude stripe."""

    def write(self, rows: DataFrame, path: str) -> None:
        rows.write.partitionBy("cell").parquet(path)


def write_all(rows: DataFrame, sinks: dict[str, Sink]) -> None:
    """Each sink writes to its path; the rows are computed once."""
    kept = rows.persist()
    try:
        for path, sink in sinks.items():
            sink.write(kept, path)
    finally:
        kept.unpersist()


def _xml(group: pd.DataFrame) -> pd.DataFrame:
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<osm version="0.6">']
    for kind in ("node", "way", "relation"):
        for r in group[group["kind"] == kind].drop_duplicates("id").itertuples():
            place = f' lat="{r.lat:.7f}" lon="{r.lon:.7f}"' if kind == "node" else ""
            body = [f"<nd ref=\"{x}\"/>" for x in (r.refs if r.refs is not None else [])] if kind == "way" else [f'<member type={quoteattr(m["type"])} ref="{m["ref"]}" role={quoteattr(m["role"] or "")}/>' for m in (r.members if r.members is not None else [])]
            tags = r.tags.items() if isinstance(r.tags, dict) else r.tags if r.tags is not None else []
            body += [f"<tag k={quoteattr(k)} v={quoteattr(v)}/>" for k, v in tags]
            lines.append(f'<{kind} id="{r.id}" version="1"{place}>' + "".join(body) + f"</{kind}>")
    lines.append("</osm>")
    return pd.DataFrame({"tile": group["tile"].iloc[:1], "xml": ["\n".join(lines)]})


def tiles(elements: DataFrame) -> DataFrame:
    """elements: tile, kind, id, lat, lon, refs, members, tags.  An OSM document for each tile; a tile is bounded by its zoom."""
    return elements.groupBy("tile").applyInPandas(_xml, "tile string, xml string")


def tag_statistics(rows: DataFrame) -> DataFrame:
    """rows: class, tags.  A JSON line for each class: values of each tag with their counts."""
    counts = rows.select("class", F.explode("tags").alias("tag", "value")).groupBy("class", "tag", "value").count()
    by_tag = counts.groupBy("class", "tag").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "count")))).alias("values"), F.sum("count").alias("total"))
    by_class = by_tag.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("total", "values")))).alias("tags"))
    return by_class.select(F.to_json(F.struct(F.col("class").alias("name"), F.col("tags").alias("tags_info"))).alias("value"))


def parse_options(words: list[str], known: set[str]) -> dict[str, list[str]]:
    """Handler options: known names open a list of values, by space or =; what comes before is under ''."""
    out: dict[str, list[str]] = {"": []}
    at = ""
    for word in (w for x in words for part in x.split() for w in part.split("=") if w):
        if word in known:
            at = word
            out.setdefault(at, [])
        else:
            out[at].append(word)
    return out



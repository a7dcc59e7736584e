"""Latest versions, snapshot differences and dump checksums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def synchronize(rows: DataFrame, id_col: str = "id", ts_col: str = "ts", removed: str = "action = 'remove'") -> DataFrame:
    """Rows of the newest timestamp of each id; tombstones are dropped first, ties all stay."""
    newest = F.rank().over(Window.partitionBy(id_col).orderBy(F.desc(ts_col)))
    return rows.filter(f"not coalesce({removed}, false)").withColumn("_r", newest).filter("_r = 1").drop("_r")


def newest(rows: DataFrame, id_col: str, ts_col: str, value_col: str) -> DataFrame:
    """The value of the newest timestamp of each id, ties to the largest value."""
    return rows.groupBy(id_col).agg(F.max(F.struct(ts_col, value_col)).alias("_m")).select(id_col, f"_m.{ts_col}", f"_m.{value_col}")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and op: + only in new, - only in old, N changed and newer, O changed and not newer.  Inputs: id, ts, hash."""
    o = old.select("id", F.col("ts").alias("ots"), F.col("hash").alias("ohash"), F.lit(True).alias("in_old"))
    n = new.select("id", F.col("ts").alias("nts"), F.col("hash").alias("nhash"), F.lit(True).alias("in_new"))
    op = F.when(F.col("in_old").isNull(), "+").when(F.col("in_new").isNull(), "-").when(F.col("ohash") == F.col("nhash"), None).when(F.col("ots") < F.col("nts"), "N").otherwise("O")
    return o.join(n, "id", "full_outer").withColumn("op", op).filter("op is not null")


def diff_lines(changes: DataFrame) -> DataFrame:
    """Lines of a diff file in their order: headers, then +, N, -, O."""
    rank = F.create_map(*[F.lit(x) for kv in zip("+N-O", range(4), strict=True) for x in kv])
    return changes.select(F.element_at(rank, F.col("op")).alias("rank"), F.concat(F.col("op"), F.lit(" "), F.col("id").cast("string")).alias("value")).orderBy("rank", "value").select("value")


def diff_file(old: DataFrame, new: DataFrame, names: tuple[str, str], at: str, full: bool = False) -> DataFrame:
    """Lines of a whole diff file, in order: headers, then + and N with the new record, - and O with the id, or with the old record if full.

    Inputs: id, ts, hash, body; names: the files; at: time of the diff.  Only the
    records of changed ids are joined.
    """
    changes = diff(old, new).select("id", "op")
    only_id = F.to_json(F.struct(F.col("id").cast("string").alias("id")))
    fresh = changes.filter("op in ('+', 'N')").join(new.select("id", "body"), "id")
    gone = changes.filter("op in ('-', 'O')")
    gone = gone.join(old.select("id", "body"), "id") if full else gone.withColumn("body", only_id)
    rank = F.create_map(*[F.lit(x) for kv in zip("+N-O", range(10, 14), strict=True) for x in kv])
    rows = fresh.unionByName(gone).select(F.element_at(rank, F.col("op")).alias("rank"), F.concat(F.col("op"), F.lit(" "), F.col("body")).alias("value"))
    line = lambda i, word, value: F.struct(F.lit(i).alias("rank"), F.concat(F.lit(f"@{word} "), value).alias("value"))

    def head(rows: DataFrame, i: int, which: str) -> DataFrame:
        md5s = dump_checksum(rows.withColumn("_m", F.md5(F.concat_ws("|", F.col("id").cast("string"), "hash"))), "_m")
        stamp = rows.agg(F.coalesce(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")).alias("ts"))
        lines = md5s.crossJoin(stamp)  # one row each
        return lines.select(F.explode(F.array(line(i, f"{which}-timestamp", F.col("ts")), line(i + 1, f"{which}-hash", F.concat_ws("-", F.col("n").cast("string"), "head", "tail")))).alias("l")).select("l.*")

    fixed = [line(0, "diff-generation-ts", F.lit(at)), line(1, "old-file", F.lit(names[0])), line(2, "new-file", F.lit(names[1]))]
    first = old.sparkSession.range(1).select(F.explode(F.array(*fixed)).alias("l")).select("l.*")
    return first.unionByName(head(old, 3, "old")).unionByName(head(new, 5, "new")).unionByName(rows).orderBy("rank", "value").select("value")


def longest_key(*dumps: DataFrame) -> DataFrame:
    """Length in bytes of the longest id of all dumps."""
    most = [d.agg(F.max(F.octet_length(F.col("id").cast("string"))).alias("n")) for d in dumps]
    return reduce(DataFrame.unionByName, most).agg(F.max("n").alias("n"))


def dump_checksum(rows: DataFrame, md5_col: str = "md5") -> DataFrame:
    """Order-insensitive checksum of a dump: record count and the sums of both halves of the records' md5."""
    half = lambda at: F.sum(F.conv(F.substring(md5_col, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count(F.lit(1)).alias("n"), half(1).alias("head"), half(16).alias("tail"))


def retention(dumps: DataFrame, today: str) -> DataFrame:
    """region, day -> keep (younger than 3 days, or than 30 and a Monday) and whether it diffs with the day before."""
    age = F.datediff(F.lit(today).cast("date"), "day")
    keep = (age <= 3) | (age <= 30) & (F.dayofweek("day") == 2)
    before = F.lag("day").over(Window.partitionBy("region").orderBy("day"))
    return dumps.select("region", "day", keep.alias("keep"), F.coalesce(F.datediff("day", before) == 1, F.lit(False)).alias("diff_with_previous"))

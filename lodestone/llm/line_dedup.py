"""Repeated lines, found as overlapping windows of three consecutive lines.

Every window is hashed to 128 bits; windows that occur more than once in the
whole corpus keep their first occurrence (smallest doc_id, then the hash of the
text, then position), and every later one covers its three lines.  Covered lines are merged into spans
and removed.  Windows that overlap or adjoin make one span.  A span judged on
the input stays judged so: a first occurrence is kept even if other windows
cover part of it.

A text of fewer than three lines has no window; null texts count as empty.
Null ids count as the earliest.  Rows equal in id and text are one document:
neither is later than the other; of texts that share an id one is later.
Columns of any name pass through.  Rows that lose nothing are not shuffled.
Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import split_by
from .textwork import dropped, stored

WIDTH = 3


def _lines(text: str | Column) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row (hash of the whole text), pos and key (16 bytes in two longs) of each window."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), _lines(text_col).alias("l")).filter(F.size("l") >= WIDTH)
    hashed = lines.select("id", "row", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))).alias("h"))
    runs = F.transform(F.sequence(F.lit(1), F.size("h") - F.lit(WIDTH - 1)), lambda i: F.struct(*[F.xxhash64(*[F.element_at("h", i + j)[part] for j in range(WIDTH)]).alias(part) for part in "ab"]))
    return hashed.select("id", "row", F.posexplode(runs).alias("pos", "k")).select("id", "row", "pos", "k.a", "k.b")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row and spans (array of first and last covered line from 0, merged, ascending) of each text that loses lines; stored."""
    every = stored(windows(docs, id_col, text_col), "windows")
    place = F.struct("id", "row", "pos")
    first = every.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = every.join(first, ["a", "b"]).filter(~place.eqNullSafe(F.col("first"))).select("id", "row", "pos").distinct()
    order = Window.partitionBy("id", "row").orderBy("pos")
    new = later.withColumn("new", F.coalesce((F.col("pos") > F.lag("pos").over(order) + WIDTH).cast("int"), F.lit(1)))
    run = new.withColumn("run", F.sum("new").over(order)).groupBy("id", "row", "run").agg(F.min("pos").alias("s"), (F.max("pos") + (WIDTH - 1)).alias("e"))
    out = stored(run.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans")), "spans")
    dropped(docs.sparkSession, every)
    return out


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `row_in` (all input columns), n_lines, spans, kept_text."""
    found = spans(docs, id_col, text_col).select(F.col("id").alias("_id"), F.col("row").alias("_row"), "spans")
    rows = docs.select(F.struct("*").alias("row_in"), F.col(id_col).alias("_i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_r"))
    clear, suspects = split_by(rows, F.xxhash64("_i", "_r"), found.select(F.xxhash64("_id", "_row")), found.count())
    joined = suspects.join(found.hint("merge"), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_row")), "left")
    joined = joined.select("row_in", "spans").unionByName(clear.select("row_in", F.lit(None).cast("array<struct<s:int,e:int>>").alias("spans")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    joined = joined.select("row_in", F.coalesce("spans", none).alias("spans"), _lines(F.col("row_in")[text_col]).alias("_l"))
    gap_from = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["e"] + 1))
    gap_to = F.concat(F.transform("spans", lambda x: x["s"]), F.array(F.size("_l")))
    kept = F.flatten(F.transform(F.arrays_zip(gap_from.alias("f"), gap_to.alias("t")), lambda g: F.slice("_l", g["f"] + 1, F.greatest(g["t"] - g["f"], F.lit(0)))))
    return joined.select("row_in", F.size("_l").cast("long").alias("n_lines"), "spans", F.array_join(kept, "\n").alias("kept_text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_lines(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"] + 1)
    return out.select(F.col("row_in.doc_id").alias("doc_id"), "n_lines", removed.alias("n_removed"), F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("spans"), F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(len(l) - 2)) AS pos, l FROM l WHERE len(l) >= 3),
k AS (SELECT doc_id, pos, md5(l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3]) AS k FROM w),
later AS (SELECT doc_id, pos FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS i FROM later),
r AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c),
s AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM r GROUP BY doc_id, g),
p AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, CAST(sum(b - a + 1) AS BIGINT) AS n FROM s GROUP BY doc_id),
ci AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(spans, '') AS spans,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN l ELSE list_filter(l, lambda x, i: NOT list_contains(gone, i - 1)) END, chr(10))) AS kept_sha256
FROM l LEFT JOIN p USING (doc_id) LEFT JOIN ci USING (doc_id)
"""

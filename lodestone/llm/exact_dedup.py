"""Exact duplicates by a Golomb-coded fingerprint exchange.

1. Each sender (a run of rows of one partition) sorts the 48-bit fingerprints of
   its texts, each once, and sends every owner of a fingerprint range its part
   as a Rice (Golomb, power of two) code of the differences: about
   log2(range/rows) + 2 bits a text instead of the text, and a bit for those it
   holds twice itself.
2. Owners decode and merge what they got and answer each sender with a bitmap
   of the fingerprints that occur elsewhere too.  Owners are as many as keep a
   range at `OWNER_PRINTS` fingerprints, so a task's share does not grow.
3. Senders' marked fingerprints are the table of suspects.  A Bloom filter sized
   by it parts the rows: what does not pass goes on where it stands, and only
   suspects are shuffled, grouped by their whole bytes.  A false suspect is a
   group of one and changes nothing.  Where the table is too large for a filter
   every row is a suspect.

Groups that hold more than a thousandth of the suspects, a thousand at most,
are broadcast as ids and digests; no task gathers one.

Null texts count as empty.  A null doc_id never becomes the one that stays
unless all ids of its group are null.  Rows equal in both doc_id and text are
one document: `mark` gives all of them the same mark, `deduplicate` keeps one.  Columns of any name pass through.  Empty input
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import bloom_of, passes, spread_join
from .textwork import dropped, stored

#: Bits of a fingerprint in the exchange, rows of a sender, fingerprints of an owner.
BITS, SENDER_ROWS, OWNER_PRINTS = 48, 1 << 19, 1 << 22


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Parameter, unary quotients and packed remainders of the differences of sorted values."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, float(gaps.mean()))))) if len(gaps) else 0
    stops = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1 if len(stops) else 0, np.uint8)
    unary[stops] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)[::-1]) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    gaps += (bits << np.arange(k, dtype=np.uint64)[::-1]).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _send(owners: int):
    """Rows of fingerprints -> one row per owner and sender: the code, and which of its fingerprints the sender has twice."""
    shift = np.uint64(64 - BITS)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        number = [TaskContext.get().partitionId() << 24]

        def flush() -> pa.RecordBatch:
            prints, count = np.unique(np.concatenate(held).view(np.uint64) >> shift, return_counts=True)
            held.clear()
            number[0] += 1
            cuts = np.searchsorted(prints, (np.arange(owners + 1, dtype=np.float64) * (2.0**BITS / owners)).astype(np.uint64))
            cuts[-1] = len(prints)
            rows = []
            for o in np.flatnonzero(np.diff(cuts)):
                own = prints[cuts[o] : cuts[o + 1]]
                k, unary, rest = rice_encode(own)
                rows.append({"sender": number[0], "owner": int(o), "n": len(own), "k": k, "quotients": unary, "remainders": rest, "twice": np.packbits(count[cuts[o] : cuts[o + 1]] > 1).tobytes()})
            return pa.RecordBatch.from_pylist(rows, schema=_SENT)

        size = 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            size += batch.num_rows
            if size >= SENDER_ROWS:
                yield flush()
                size = 0
        if size:
            yield flush()

    return parts


_SENT = pa.schema([("sender", pa.int64()), ("owner", pa.int32()), ("n", pa.int64()), ("k", pa.int32()), ("quotients", pa.binary()), ("remainders", pa.binary()), ("twice", pa.binary())])
_CODE = "sender long, owner int, n long, k int, quotients binary, remainders binary, twice binary"


def _bitmap(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8))[:n].astype(bool)


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """An owner's work: which fingerprints of each sender occur more than once overall."""
    lists = [rice_decode(*x) for x in zip(group["n"], group["k"], group["quotients"], group["remainders"], strict=True)]
    own = [x[_bitmap(t, len(x))] for x, t in zip(lists, group["twice"], strict=True)]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = np.union1d(values[counts > 1], np.concatenate(own))
    marks = [np.packbits(np.isin(x, twice)).tobytes() for x in lists]
    return pd.DataFrame({"sender": group["sender"], "owner": group["owner"], "marks": marks})


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sender's side of the answers: its marked fingerprints."""
    for batch in batches:
        for n, k, unary, rest, marks in zip(*[batch.column(c).to_pylist() for c in ("n", "k", "quotients", "remainders", "marks")], strict=True):
            own = rice_decode(n, k, unary, rest)
            yield pa.RecordBatch.from_arrays([pa.array(own[_bitmap(marks, n)].astype(np.int64))], ["p"])


def _short(print64):
    """The 48 bits of a 64-bit fingerprint that are exchanged."""
    return F.shiftrightunsigned(print64, 64 - BITS)


def suspect_prints(prints: DataFrame, owners: int | None = None) -> DataFrame:
    """p: the 48-bit fingerprints that occur twice or more, each once, stored.  prints: one column, the 64-bit fingerprint of each text."""
    spark = prints.sparkSession
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), prints.count() // OWNER_PRINTS + 1)
    sent = stored(prints.mapInArrow(_send(owners), _CODE), "fingerprints")
    answers = sent.groupBy("owner").applyInPandas(_answer, "sender long, owner int, marks binary")
    found = stored(sent.drop("twice").join(answers, ["sender", "owner"]).mapInArrow(_marked, "p long").distinct(), "suspects")
    dropped(spark, sent)
    return found


def suspect_test(docs: DataFrame, text_col: str, owners: int | None = None):
    """A test of a text column: false for texts that surely occur once."""
    found = suspect_prints(docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("p")), owners)
    bloom = bloom_of(found, found.count())
    dropped(docs.sparkSession, found)
    return lambda text: passes(bloom, _short(F.xxhash64(text)))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None, row=None) -> DataFrame:
    """One row per input row: `row` (all input columns, unless another value is given), keep_id, group_size, kept, text_sha256."""
    text, test = F.coalesce(F.col(text_col), F.lit("")), suspect_test(docs, text_col, owners)
    # Grouped by the whole text: each task sends a text once, however many copies it has.
    groups = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).filter(test(F.col("_text"))).groupBy("_text").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups.filter("group_size > 1").select(F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    rows = docs.select((F.struct("*") if row is None else row).alias("row"), F.col(id_col).alias("_id"), F.sha2(text, 256).alias("text_sha256"), test(text).alias("_s"))
    alone = rows.filter("not _s").select("row", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    joined = spread_join(rows.filter("_s").drop("_s"), groups, "text_sha256", "group_size", total, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    told = joined.select("row", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256")
    return alone.unionByName(told)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row of each text, that of the largest id (of equal ids, the largest JSON form), with the columns of the input.

    Only suspects are shuffled, and each task sends one row of a text at most.
    """
    text, test = F.coalesce(F.col(text_col), F.lit("")), suspect_test(docs, text_col, owners)
    others = F.struct(F.col(text_col).isNull().alias("_null"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    suspects = docs.filter(test(text)).select(text.alias("_text"), others.alias("_row"))
    best = suspects.groupBy("_text").agg(F.max_by("_row", F.struct(F.col(f"_row.`{id_col}`"), ~F.col("_row._null"), F.to_json("_row"))).alias("_row"))
    back = [F.when(~F.col("_row._null"), F.col("_text")).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return docs.filter(~test(text)).unionByName(best.select(*back))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = mark(docs, row=F.struct("doc_id"))
    return out.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

"""Quality selection by importance resampling.

Two generative models of hashed word unigrams and bigrams are counted: the
target's, over a bounded sample of labelled good rows, and the raw corpus's,
over all rows.  A text's importance weight is the ratio of its likelihoods
under the two; Gumbel noise drawn from its id is added to the log weight and
the k largest keys are kept, which samples k rows without replacement in
proportion to their weights.

k is `fraction` of the rows; unset, it is the share of good rows among the
labelled ones.  The k-th largest key is found by counting keys in ranges, so no
task and no driver sees more than `BINS` counts or `LAST` rows of a range.

A text without words, or null, has log weight 0.  Equal rows have equal keys;
rows of one id share their noise; ties at the k-th key go to the smaller id.
Without good labels all log weights are 0.  Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textwork import WORD_BYTES, byte_codes, chunks, mix, span_hashes, stored, word_bounds

BINS, LAST = 4096, 100_000
_CODES = byte_codes(3, fold_case=True)
_U = np.uint64


@dataclass(frozen=True)
class QualityParameters:
    buckets_log2: int = 14
    #: Labelled good rows of which the target model is made, at most.
    most_target_rows: int = 20_000
    smoothing: float = 0.5
    fraction: float | None = None
    seed: int = 11


def ngram_buckets(offsets: np.ndarray, data: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all word unigrams and bigrams of each text, and the offsets of each text among them."""
    starts, ends = word_bounds(offsets, data, WORD_BYTES)
    words = span_hashes(data, starts, ends, _CODES)
    first = np.searchsorted(starts, offsets)
    follows = np.zeros(len(words), bool)
    follows[1:] = True
    follows[first[:-1][first[:-1] < len(words)]] = False
    pair = mix(words + np.append(_U(0), words[:-1]) * _U(0x9E3779B97F4A7C15))
    both = np.stack([words, pair], axis=1).reshape(-1)
    keep = np.stack([np.ones(len(words), bool), follows], axis=1).reshape(-1)
    at = np.append(0, np.cumsum(keep))[2 * first]
    return (both[keep] >> _U(64 - log2)).astype(np.int64), at


def _count(log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << log2, np.int64)
        for batch in batches:
            for _, _, offsets, data in chunks(batch.column(0)):
                total += np.bincount(ngram_buckets(offsets, data, log2)[0], minlength=1 << log2)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["bucket", "n"])

    return run


def model(texts: DataFrame, log2: int) -> np.ndarray:
    """Counts of the buckets over all texts (one text column); a task sends a row for each bucket at most."""
    out = np.zeros(1 << log2)
    for r in texts.mapInArrow(_count(log2), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _score(ratio: np.ndarray, log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, offsets, data in chunks(batch.column(1)):
                buckets, at = ngram_buckets(offsets, data, log2)
                total = np.append(0.0, np.cumsum(ratio[buckets]))
                out[lo:hi] = total[at[1:]] - total[at[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "log_weight"])

    return run


def kth_key(keyed: DataFrame, k: int) -> tuple[float, object] | None:
    """(key, id) of the k-th row by key descending, id ascending; None if k is 0."""
    lo, hi, left = keyed.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0 or not left:
        return None
    here = keyed
    while left > LAST and hi > lo:
        bin_ = F.least(F.floor((F.col("key") - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1)).cast("int")
        rows = here.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("b")).collect()
        for r in rows:
            if k <= r["n"]:
                break
            k -= r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi, left = r["lo"], r["hi"], r["n"]
        here = keyed.filter(F.col("key").between(lo, hi))
    if hi == lo and left > LAST:  # one key: its ids decide, whichever way Spark sorts them
        return here.orderBy(F.asc_nulls_last("id")).offset(k - 1).limit(1).select("key", "id").first()
    rows = here.orderBy(F.desc("key"), F.asc_nulls_last("id")).limit(k).select("key", "id").orderBy("key", F.desc_nulls_first("id")).limit(1).collect()
    return tuple(rows[0])


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: QualityParameters = QualityParameters()) -> DataFrame:
    """id, log_weight, key and selected of each row.  labels: id, quality, toxic; good is quality 1 and not toxic."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    share = labels.agg(F.avg(F.coalesce(good, F.lit(False)).cast("double"))).first()[0]
    chosen = labels.filter(good & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64(F.lit(p.seed), "id"), "id").limit(p.most_target_rows)
    target = model(own.join(F.broadcast(chosen), "id", "left_semi").select("text"), p.buckets_log2)
    raw = model(own.select("text"), p.buckets_log2)
    ratio = np.zeros(1 << p.buckets_log2)
    if target.sum() and raw.sum():
        smooth = lambda x: np.log((x + p.smoothing) / (x.sum() + p.smoothing * len(x)))
        ratio = smooth(target) - smooth(raw * (target.sum() / raw.sum()))
    scored = own.mapInArrow(_score(ratio, p.buckets_log2), f"id {kind}, log_weight double")
    # A uniform number from the id, never 0 or 1.
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(p.seed), "id"), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = stored(scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "keys")
    rows = keyed.count()
    fraction = p.fraction if p.fraction is not None else share if share is not None else 1.0
    last = kth_key(keyed, int(round(rows * fraction)))
    if last is None:
        return keyed.withColumn("selected", F.lit(False))
    tie = F.col("id").isNull() if last[1] is None else F.col("id").isNotNull() & (F.col("id") <= last[1])
    if last[1] is None:
        tie = F.lit(True)
    return keyed.withColumn("selected", (F.col("key") > last[0]) | (F.col("key") == last[0]) & tie)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnRenamed("id", "doc_id")

"""Joins and filters that keep hot keys and long texts out of the shuffle.

`spread_join` joins rows to a table of one row a key.  Of at most `FEW_ROWS` rows
the keys are as few, and their table goes by broadcast.  Beyond that, keys that
hold more than a thousandth of all rows are at most a thousand, whatever the
input: these go by broadcast and their rows stay where they are; all others are
shuffled and small.

`split_by` tells rows whose key is surely not in a table of keys from suspects,
by a Bloom filter sized by that table.  Beyond `MOST_KEYS` keys the filter grows
no more and lets more through; beyond `FULL` times as many there is none: all
rows are suspects then, and the caller's join shuffles them.  `among` leaves
only rows whose key is in the table, but for the filter's few errors, whatever
the number of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textwork import mix

#: A key is hot when it holds more than this share of all rows, and more rows than the floor.
HOT_SHARE = 1e-3
#: Rows whose keys' table is broadcast whole.
FEW_ROWS = 200_000
#: Keys that a Bloom filter takes at 10 bits a key: 8 MiB to broadcast at most.
MOST_KEYS, _BITS_A_KEY, _BLOCK_LOG2 = 6_700_000, 10, 16
#: A filter that holds this many times MOST_KEYS still keeps back a third of the others.
FULL = 8


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to keyed, which has one row a key and, in `count`, at least the key's number of rows; total: all rows."""
    if total <= FEW_ROWS:
        return rows.join(F.broadcast(keyed), key, how)
    bound = int(total * HOT_SHARE)
    hot = keyed.filter(F.col(count) > bound)
    rest = keyed.filter(F.coalesce(F.col(count), F.lit(0)) <= bound)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(rest.hint("merge"), key, how))


def _at(keys: np.ndarray, log2: int) -> np.ndarray:
    h = mix(keys.view(np.uint64) if keys.dtype == np.int64 else keys)
    return np.concatenate([h >> np.uint64(64 - log2), h & np.uint64((1 << log2) - 1)]).astype(np.int64)


def _bits(log2: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_at(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), log2))
            yield pa.RecordBatch.from_arrays([pa.array((at >> block).astype(np.int32)), pa.array((at & ((1 << block) - 1)).astype(np.int32))], ["block", "bit"])

    return run


def _block(size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, np.uint8)
        bits[group["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": group["block"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    return run


def bloom_of(keys: DataFrame, n: int) -> tuple[int, np.ndarray] | None:
    """A Bloom filter of one column of n distinct 64-bit hashes; None far beyond MOST_KEYS."""
    if n > MOST_KEYS * FULL:
        return None
    log2 = max(10, int(min(n, MOST_KEYS) * _BITS_A_KEY).bit_length())
    block = min(_BLOCK_LOG2, log2)
    out, size = np.zeros(1 << (log2 - 3), np.uint8), 1 << (block - 3)
    if n:
        found = keys.mapInArrow(_bits(log2, block), "block int, bit int").distinct().groupBy("block").applyInPandas(_block(1 << block), "block int, bits binary")
        for row in found.collect():  # 8 KiB a row, 8 MiB at most
            out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return log2, out


def passes(bloom: tuple[int, np.ndarray] | None, hashes: Column) -> Column:
    """Whether a 64-bit hash may be in the filter; without a filter all may."""
    if bloom is None:
        return F.lit(True)
    log2, bits = bloom

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        at = _at(values.to_numpy().astype(np.int64), log2).reshape(2, -1)
        hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=0))

    return test(hashes)


def split_by(rows: DataFrame, hashes: Column, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose 64-bit hash is surely not among the keys (one column, n of them), and the suspects."""
    test = passes(bloom_of(keys, n), hashes)
    return rows.filter(~test), rows.filter(test)


def among(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """Rows whose key is in keys (column key, n distinct ones).  A filter of few keys tells them, with one error in thirty; beyond MOST_KEYS a join leaves none."""
    kept = split_by(rows, F.xxhash64(key), keys.select(F.xxhash64(key)), n)[1]
    return kept if n <= MOST_KEYS else kept.join(keys.hint("shuffle_hash"), key, "left_semi").select(*rows.columns)

"""Vectorised text work shared by the Arrow-based operators.

Everything here works on the raw UTF-8 buffers of Arrow string columns: words
are byte runs of a class, and their 64-bit hashes come from one prefix sum per
chunk, so no Python object is made per word.  Chunks are bounded in bytes (one
text longer than the bound is a chunk of its own), which bounds a worker's
memory whatever the batch size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once by the vectorised helpers.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n (kept between calls, grown by doubling)."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in ((0, _P), (1, _PINV)):
            out = np.ones(size, _U)
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * _U(pow(base, have, 1 << 64))
                have *= 2
            _powers[k] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all others."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def byte_codes(seed: int = 1, fold_case: bool = False) -> np.ndarray:
    """A random odd 64-bit code for each byte; with fold_case A-Z share those of a-z."""
    codes = mix(np.arange(1, 257, dtype=_U) * _U(_P) + _U(seed)) | _U(1)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters, all of UTF-8 above ASCII.
WORD_BYTES = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: [^\x20\x09-\x0D]+
NON_SPACE_BYTES = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of pieces of at most `most` bytes, one text at least."""
    offsets, data = buffers(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, offsets[at : end + 1] - offsets[at], data[offsets[at] : offsets[end]]
        at = end


def word_bounds(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` bytes; texts end runs."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flag = inside[data]
    before = np.empty(len(flag) + 1, bool)
    before[0] = False
    before[1:] = flag
    edge = np.zeros(len(flag) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(flag & (~before[:-1] | edge[:-1]))
    after = np.append(flag[1:], False)
    ends = np.flatnonzero(flag & (~after | edge[1:])) + 1
    return starts, ends


def word_counts(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Words of each text."""
    starts, _ = word_bounds(offsets, data, inside)
    return np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(codes[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside texts, and the offsets of each text among them.

    first: offsets of the texts among `words`.  A text of fewer words, but not
    none, has one shingle of all its words.
    """
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(counts)), made)
    start = first[:-1][text] + (np.arange(at[-1]) - at[:-1][text])
    length = np.minimum(width, counts[text])
    h = np.zeros(len(start), _U)
    padded = np.append(words, np.zeros(width, _U))
    for j in range(width):
        h = h * _U(_P) + np.where(length > j, padded[start + j], _U(j + 1))
    return mix(h), at


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name under the one that the cluster shares (spark.checkpoint.dir).

    Where that is unset, a session on one machine sets a folder of that machine; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        base = "file:///tmp/checkpoints/lodestone"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and gives Catalyst its real size."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it has fewer partitions than there are, as a table of one small file has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

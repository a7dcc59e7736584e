"""Repeated byte strings, found by external induced suffix sorting.

A string of `length` bytes that starts at two places is removed at both.

1. Sharding.  Each window of `least` bytes picks the least hash of its k-grams
   as its anchor, and the starts that share an anchor (split in two by their
   distance from it) are a piece, whose bytes go on for `length` from its last
   start.  All windows of a piece share a core of bytes, whose hash is the
   piece's key.  Equal strings pick the same anchor, so they are in pieces of one
   key; a piece whose key occurs once (a Bloom filter tells most of them) holds
   no repeated string.
2. Sorting.  Of equal pieces one goes on, with their number.  Pieces are dealt
   to shards by key and each shard's suffixes are sorted by induction: suffixes
   get their types, the leftmost S-type substrings are sorted by induction and
   named, the string of names is sorted by rank doubling (to the depth that
   matters) and all suffixes are induced from it bucket by bucket.  The queues
   between buckets go to disk beyond a bound; all else of a shard is in memory.
   A key whose differing pieces exceed `key_bytes` is no shard: its strings are
   compared by fingerprints, start by start, in an aggregation that spreads them
   over all tasks.  So no task sorts more than `shard_bytes` and `key_bytes`.
3. Neighbours in suffix order with a common prefix of `length` bytes, told by
   fingerprints of that prefix, are repeats, as are all starts of a piece that
   occurs twice.  Covered bytes are merged per text.  The same order tells
   strings of `least` bytes that start elsewhere, such as passages too short to
   be removed; their bytes are counted only.

Texts are whole; null ones are empty; equal rows count as repeats of each
other.  Bytes are those of UTF-8, so a cut can split a character: what is kept
is bytes.  Empty input gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import among, bloom_of, passes, split_by, spread_join
from .textwork import buffers, byte_codes, chunks, dropped, mix, powers, stored, widened

_U = np.uint64
_CODES = byte_codes(41)
_LOW = (1 << 24) - 1


@dataclass(frozen=True)
class SuffixParameters:
    length: int = 400
    #: Repeats of this length are counted (n_shared); never above `length`.
    least: int = 288
    gram: int = 64
    #: Bytes of a shard's text that are sorted at once, at least; pieces of one key stay together.
    shard_bytes: int = 1 << 20
    #: Differing pieces of one key that are sorted together, at most.
    key_bytes: int = 2 << 20
    #: Bytes of queued suffixes in memory.
    queue_bytes: int = 64 << 20

    @property
    def short(self) -> int:
        return min(self.least, self.length)

    @property
    def lengths(self) -> tuple[int, ...]:
        return tuple(sorted({self.length, self.short}))


def _span(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, down: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * down[starts])


def _prints(total: np.ndarray, starts: np.ndarray, ends: np.ndarray | int, down: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Fingerprints from starts to ends (or of one length), made block by block so that only the result is large."""
    out = np.empty(len(starts), _U)
    for i in range(0, len(starts), step):
        own = starts[i : i + step].astype(np.int64)
        out[i : i + step] = _span(total, own, own + ends if isinstance(ends, int) else ends[i : i + step], down)
    return out


def _place(n: int) -> type:
    """Type of positions below n."""
    return np.int32 if n < 1 << 31 else np.int64


def pieces(offsets: np.ndarray, data: np.ndarray, p: SuffixParameters) -> tuple[np.ndarray, ...]:
    """text, key, print (of the piece's bytes), first start and number of starts of all pieces of the texts."""
    w, out = p.short - p.gram + 1, []
    half = -(-w // 2)
    step = 1 << 22
    for base in range(0, max(0, len(data) - p.short + 1), step):  # one turn, but for very long texts
        part = data[base : base + step + p.length - 1]
        n = min(step, len(part) - p.short + 1)
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(_CODES[part] * up[: len(part)], out=total[1:])
        m = len(part) - p.gram + 1
        h = mix((total[p.gram :] - total[:m]) * down[:m])
        packed = np.full(-(-m // w) * w, np.iinfo(_U).max, _U)
        packed[:m] = (h & ~_U(_LOW)) | (_U(_LOW) - np.arange(m, dtype=_U))
        grid = packed.reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
        anchor = _LOW - (least & _U(_LOW)).astype(np.int64)
        start = np.arange(n)
        text = np.searchsorted(offsets, start + base, "right") - 1
        ok = start + base + p.short <= offsets[text + 1]
        start, anchor, text = start[ok], anchor[ok], text[ok]
        if not len(start):
            continue
        side = (anchor - start) // half
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (side[1:] != side[:-1]) | (text[1:] != text[:-1]))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(start)))
        a, s, q = start[first], anchor[first], side[first]
        core = s - half * q
        key = _span(total, core, core - half + 1 + p.short, down) + q.astype(_U)
        stop = np.minimum(a + count - 1 + p.length, offsets[text[first] + 1] - base)
        prints = _span(total, a, stop, down) + count.astype(_U)
        out.append((text[first], key, prints, a + base - offsets[text[first]], count))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sketch(p: SuffixParameters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in chunks(batch.column(1)):
                text, key, prints, start, count = pieces(offsets, data, p)
                node = batch.column(0).slice(lo, hi - lo).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([node, pa.array(key.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["node", "key", "print", "s", "c"])

    return run


class Queue:
    """Suffixes waiting for each bucket, in order of arrival; on disk beyond a bound."""

    def __init__(self, bound: int, kind: type):
        self.held: dict[int, list] = {}
        self.kind = np.dtype(kind)
        self.size, self.bound, self.file = 0, bound, None

    def put(self, bucket: int, values: np.ndarray) -> None:
        self.held.setdefault(bucket, []).append(values)
        self.size += values.nbytes
        if self.size > self.bound:
            self.file = self.file or tempfile.TemporaryFile()
            for own in self.held.values():
                for i, x in enumerate(own):
                    if isinstance(x, np.ndarray):
                        self.file.seek(0, 2)
                        own[i] = (self.file.tell(), len(x))
                        self.file.write(x.tobytes())
            self.size = 0

    def drain(self, bucket: int) -> np.ndarray:
        own = self.held.pop(bucket, [])
        out = []
        for x in own:
            if isinstance(x, np.ndarray):
                self.size -= x.nbytes
                out.append(x)
            else:
                self.file.seek(x[0])
                out.append(np.frombuffer(self.file.read(self.kind.itemsize * x[1]), self.kind))
        return np.concatenate(out) if out else np.zeros(0, self.kind)

    def deal(self, values: np.ndarray, chars: np.ndarray) -> None:
        """Put each value into the bucket of its char, keeping order."""
        if not len(values):
            return
        order = np.argsort(chars, kind="stable")
        chars, values = chars[order], values[order]
        cut = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(chars)), strict=True):
            self.put(int(chars[a]), values[a:b])


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, bound: int) -> np.ndarray:
    """All suffixes in order from the LMS suffixes in order.  Only the last character is the smallest; small: S-type."""
    n, top, kind = len(t), int(t.max()), _place(len(t))
    seeds = Queue(bound, kind)
    seeds.deal(lms.astype(kind), t[lms])
    queue, large = Queue(bound, kind), {}
    for c in range(top + 1):
        out = []
        while len(now := queue.drain(c)):
            out.append(now)
            before = now[now > 0] - 1
            before = before[~small[before]]
            queue.deal(before, t[before])
        now = seeds.drain(c)
        before = now[now > 0] - 1
        before = before[~small[before]]
        queue.deal(before, t[before])
        large[c] = np.concatenate(out) if out else np.zeros(0, kind)
    result, at = np.empty(n, kind), n
    queue = Queue(bound, kind)
    for c in range(top, -1, -1):
        while len(now := queue.drain(c)):
            result[at - len(now) : at] = now[::-1]
            at -= len(now)
            before = now[now > 0] - 1
            before = before[small[before]]
            queue.deal(before, t[before])
        if t[n - 1] == c:  # the last suffix is induced by none: the least of its bucket's S-type ones
            at -= 1
            result[at] = n - 1
            if n > 1 and small[n - 2]:
                queue.deal(np.array([n - 2], kind), t[[n - 2]])
        own = large.pop(c)
        result[at - len(own) : at] = own
        at -= len(own)
        now = own[::-1]
        before = now[now > 0] - 1
        before = before[small[before]]
        queue.deal(before, t[before])
    return result


def suffix_order(t: np.ndarray, depth: int, bound: int) -> np.ndarray:
    """Suffixes of t by their first `depth` characters at least; only the last character of t is its smallest."""
    n, kind = len(t), _place(len(t))
    edge = np.full(n, n - 1, kind)
    at = np.flatnonzero(t[:-1] != t[1:])
    edge[at] = at
    del at
    edge = np.minimum.accumulate(edge[::-1])[::-1]
    small = t[edge] < np.append(t, t[:1])[edge + 1]
    small[edge == n - 1] = True
    del edge
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) < 2:
        return induce(t, small, lms, bound)
    # Sorted by their substrings up to the next LMS position; equal neighbours share a name.
    order = induce(t, small, lms, bound)
    order = order[is_lms[order]]
    which = np.searchsorted(lms, order)
    ends = np.append(lms[1:] + 1, n)[which]
    prints = _prints(_totals(t), order, ends, powers(n + 1)[1]) + (ends - order).astype(_U)
    prints[which == len(lms) - 1] ^= _U(1)
    names = np.empty(len(lms), np.int64)
    names[which] = np.append(0, np.cumsum(prints[1:] != prints[:-1]))
    del order, which, ends, prints
    return induce(t, small, lms[recurse(names, depth)], bound)


def _totals(t: np.ndarray) -> np.ndarray:
    """Prefix sums of the codes of characters, for fingerprints."""
    total = np.zeros(len(t) + 1, _U)
    codes = mix(np.arange(int(t.max()) + 1, dtype=_U) + _U(1))[t]
    codes *= powers(len(t) + 1)[0][: len(t)]
    np.cumsum(codes, out=total[1:])
    return total


def recurse(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the string of names.  Each name but the last stands for two characters at least; ranks double until they differ or span the depth, and only suffixes that still tie are sorted again."""
    n, step = len(names), 1
    order = np.argsort(names, kind="stable")
    own = names[order]
    new = np.append(True, own[1:] != own[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ties = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(ties) and 2 * step < depth:
        at = order[ties]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 2) + after
        sort = np.argsort(key)
        at, key = at[sort], key[sort]
        order[ties] = at
        new = np.append(True, key[1:] != key[:-1])
        rank[at] = ties[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        ties = ties[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def _filled(first: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Flags of the n places from each first on; the runs do not meet."""
    step = np.zeros(size + 1, np.int8)
    step[first] += 1
    step[first + n] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def repeated(data: np.ndarray, size: np.ndarray, counts: np.ndarray, copied: np.ndarray, lengths: tuple[int, ...], bound: int) -> tuple[np.ndarray, ...]:
    """Of byte strings, one after the other in data, the runs of starts that begin a string of each length that starts elsewhere in them too.

    Only the first `counts` starts of a string count; all of a copied one's are repeated.  Returns the string's number, first and last start and the length.
    """
    first = np.cumsum(size + 1) - size - 1
    t = np.ones(len(data) + len(size) + 1, np.int16)  # 1 parts the strings, 0 ends them all
    t[-1] = 0
    t[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data.astype(np.int16) + 2
    order = suffix_order(t, max(lengths), bound)
    total, down = _totals(t), powers(len(t) + 1)[1]
    out = []
    for length in lengths:
        n = np.maximum(np.minimum(counts, size - length + 1), 0)
        own = order[_filled(first, n, len(t))[order]]
        prints = _prints(total, own, length, down)
        same = prints[1:] == prints[:-1]
        mark = _filled(first[copied], n[copied], len(t))
        mark[own[(np.append(False, same) | np.append(same, False))[: len(own)]]] = True
        edge = np.flatnonzero(np.diff(mark.astype(np.int8), prepend=0, append=0))
        a, b = edge[::2], edge[1::2]
        piece = np.searchsorted(first, a, "right") - 1
        out.append((piece, a - first[piece], b - 1 - first[piece], np.full(len(a), length)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sort(p: SuffixParameters):
    """Pieces (key, print, n, c, bytes) sorted by key -> runs of repeated starts of each, as first and last, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last, bound = 0, None, max(1, p.shard_bytes)

        def flush() -> pa.RecordBatch:
            key, prints, n, c, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            piece, a, b, length = repeated(data, sizes, c, n > 1, p.lengths, p.queue_bytes)
            columns = [key[piece], prints[piece], *(x.astype(np.int32) for x in (a, b, length))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "print", "a", "b", "length"])

        for batch in batches:
            key, prints, n, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            offsets, data = buffers(batch.column(4))
            at, rows = 0, len(key)
            new = np.append(key[:1] != last, key[1:] != key[:-1])
            while at < rows:
                full = np.flatnonzero(new[at:] & (size + offsets[at:-1] - offsets[at] >= bound))
                end = at + int(full[0]) if len(full) else rows
                if end > at:
                    held.append((key[at:end], prints[at:end], n[at:end], c[at:end], np.diff(offsets[at : end + 1]), data[offsets[at] : offsets[end]]))
                    size += int(offsets[end] - offsets[at])
                if len(full):
                    yield flush()
                    size = 0
                at = end
            last = key[-1] if rows else last
        if held:
            yield flush()

    return run


def _starts(p: SuffixParameters):
    """text and its wanted pieces -> each start's fingerprint of every length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = powers(2 * p.length + 1)
        names = ["key", "print", "n", "i", "length", "w"]
        for batch in batches:
            for lo, hi, offsets, data in chunks(batch.column(0), 4 << 20):
                for i, wanted in enumerate(batch.column(1).slice(lo, hi - lo).to_pylist()):
                    out = []
                    for x in wanted:
                        a = offsets[i] + x["s"]
                        raw = data[a : min(a + x["c"] - 1 + p.length, offsets[i + 1])]
                        total = np.zeros(len(raw) + 1, _U)
                        np.cumsum(_CODES[raw] * up[: len(raw)], out=total[1:])
                        for length in p.lengths:
                            at = np.arange(max(0, min(x["c"], len(raw) - length + 1)))
                            w = _span(total, at, at + length, down) + _U(length)
                            out.append((np.full(len(at), x["key"]), np.full(len(at), x["print"]), np.full(len(at), x["n"]), at.astype(np.int32), np.full(len(at), length, np.int32), w.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    return run


def _bytes(p: SuffixParameters):
    """text and its wanted pieces -> the pieces' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in chunks(batch.column(0), 4 << 20):
                out = []
                for i, wanted in enumerate(batch.column(1).slice(lo, hi - lo).to_pylist()):
                    text = data[offsets[i] : offsets[i + 1]]
                    out += [(x["key"], x["print"], x["n"], x["c"], text[x["s"] : x["s"] + x["c"] - 1 + p.length].tobytes()) for x in wanted]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 5, kinds, strict=True)], ["key", "print", "n", "c", "bytes"])

    return run


def covered(docs: DataFrame, text_col: str = "text", p: SuffixParameters = SuffixParameters()) -> DataFrame:
    """node (16 bytes that stand for a text), spans and shared (arrays of first byte and end, not merged, of repeats of `length` and of `least`) of texts with repeats."""
    spark = docs.sparkSession
    own = docs.select(F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("node"), F.col(text_col).alias("text")).filter(F.octet_length("text") >= p.short)
    every = stored(own.mapInArrow(_sketch(p), "node binary, key long, print long, s int, c int"), "pieces")
    twice = stored(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "keys")
    near = stored(among(every, "key", twice, twice.count()), "suspects")
    dropped(spark, every, twice)
    one = stored(near.groupBy("key", "print").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "s", "c")).alias("at")), "once")
    large = one.groupBy("key").agg(F.sum(F.col("at.c") + p.length).alias("bytes")).filter(F.col("bytes") > p.key_bytes)
    large = stored(large.select(F.xxhash64("key").alias("h")), "hot")
    n_hot = large.count()
    # Told by the key, so all pieces of a key go one way, also one that the filter takes for hot.
    hot = passes(bloom_of(large, n_hot), F.xxhash64("key")) if n_hot else F.lit(False)
    wanted = one.withColumn("hot", hot).groupBy(F.col("at.node").alias("node")).agg(F.collect_list(F.struct("key", "print", "n", F.col("at.s").alias("s"), F.col("at.c").alias("c"), "hot")).alias("wanted"))
    wanted = stored(wanted, "wanted")
    dropped(spark, one)

    def part(is_hot: bool) -> DataFrame:
        """Texts with their pieces of hot keys, or of all others; only texts that have some are shuffled."""
        mine = wanted.withColumn("wanted", F.filter("wanted", lambda x: x["hot"] == is_hot)).filter(F.size("wanted") > 0)
        texts = split_by(own, F.xxhash64("node"), mine.select(F.xxhash64("node")), mine.count())[1].groupBy("node").agg(F.first("text").alias("text"))
        return texts.join(mine, "node").select("text", "wanted")

    cut = part(False).mapInArrow(_bytes(p), "key long, print long, n long, c int, bytes binary")
    dealt = cut.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    runs, held = dealt.mapInArrow(_sort(p), "key long, print long, a int, b int, length int"), []
    if n_hot:
        starts = stored(part(True).mapInArrow(_starts(p), "key long, print long, n long, i int, length int, w long"), "starts")
        again = stored(starts.groupBy("w").agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("times")).filter("copies > 1").select("w", "times"), "again")
        found = spread_join(starts.drop("n"), again, "w", "times", starts.count())
        runs, held = runs.unionByName(found.select("key", "print", F.col("i").alias("a"), F.col("i").alias("b"), "length")), [starts, again]
    runs = stored(runs, "runs")
    dropped(spark, large, wanted, *held)
    spans = near.join(runs, ["key", "print"]).select("node", (F.col("s") + F.col("a")).alias("s"), (F.col("s") + F.col("b") + F.col("length")).alias("e"), "length").distinct()
    span = F.struct("s", "e")
    out = stored(spans.groupBy("node").agg(F.collect_list(F.when(F.col("length") == p.length, span)).alias("spans"), F.collect_list(F.when(F.col("length") == p.short, span)).alias("shared")), "covered")
    dropped(spark, near, runs)
    return out


def merged(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, first byte and end of the union of each row's spans; those that overlap or touch are one."""
    n = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    s, e = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.flatten().flatten())
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((s, row))
    row = row[order]
    apart = row * (int(e.max(initial=0)) + 1)  # keeps the rows from meeting
    s, reach = s[order] + apart, np.maximum.accumulate(e[order] + apart)
    first = np.flatnonzero(np.append(True, s[1:] > reach[:-1])[: len(s)])
    last = np.append(first[1:], len(s))[: len(first)] - 1
    return row[first], (s - apart)[first], (reach - apart)[last]


def _remove(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            rows = len(offsets) - 1
            row, start, end = merged(batch.column(2))
            other, low, high = merged(batch.column(3))
            cut, both = np.searchsorted(row, np.arange(rows + 1)), np.stack([start, end], axis=1)
            digest, kept = [], []
            for i in range(rows):
                at = [0, *both[cut[i] : cut[i + 1]].ravel().tolist(), int(offsets[i + 1] - offsets[i])]
                raw = data[offsets[i] : offsets[i + 1]]
                left = b"".join(raw[at[j] : at[j + 1]].tobytes() for j in range(0, len(at), 2))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_bytes else None)
            count = lambda at, sizes: np.bincount(at, sizes, rows).astype(np.int64)
            counts = [pa.array(x) for x in (np.diff(offsets), count(row, end - start), np.diff(cut))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array(count(other, high - low)), pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "kept"])

    return run


def remove_repeats(rows: DataFrame, p: SuffixParameters = SuffixParameters(), with_bytes: bool = True) -> DataFrame:
    """rows: `row` (anything) and `text`.  Per row: n_bytes, n_removed, n_spans, kept_sha256, n_shared (bytes in repeats of `least` bytes, removed or not) and kept (bytes; null unless asked for)."""
    spark, kind = rows.sparkSession, rows.schema["row"].dataType.simpleString()
    found = covered(rows.select("text"), "text", p)
    text = F.coalesce("text", F.lit(""))
    own = rows.select("row", text.alias("text"), F.unhex(F.md5(text)).alias("node"))
    rest, hit = split_by(own, F.xxhash64("node"), found.select(F.xxhash64("node")), found.count())
    cut = hit.join(found, "node", "left").select("row", "text", "spans", "shared").mapInArrow(_remove(with_bytes), f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, kept binary")
    whole, none = F.col("text").cast("binary"), F.lit(0).cast("long")
    rest = rest.select("row", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), none.alias("n_shared"), (whole if with_bytes else F.lit(None).cast("binary")).alias("kept"))
    return cut.unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs.select(F.struct("doc_id").alias("row"), "text"), with_bytes=False).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")

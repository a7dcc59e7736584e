"""Benchmark decontamination with an FM-index per training shard.

Phrases are the 10-word windows of the benchmark items (an item of fewer words
is one phrase).  A shard is a few megabytes of training text.  Its words become
a symbol string: runs of words that occur in some phrase, parted by
separators; no other word can be part of an occurrence.  Over that string stand
a suffix array, its Burrows-Wheeler transform in a wavelet matrix with popcount
ranks, and sampled suffix positions.  All phrases are searched backwards at
once, occurrences are located by walking to the next sampled position, and the
words they cover are merged into removal spans.

The benchmark is a stated query set: it is read in blocks of at most
`block_bytes` of text, one pass over the corpus for each, and only a block is
ever sent to the executors.  Texts are never cut and never leave their row.

Null texts have no words; an item without words has no phrase; items whose id is
null hit as others and have no name; equal items both count, an id once a document.  Empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textwork import WORD_BYTES, buffers, byte_codes, chunks, shingle_hashes, span_hashes, stored, word_bounds

WINDOW, SHARD_BYTES, BLOCK_BYTES, SAMPLE = 10, 4 << 20, 8 << 20, 16
_CODES = byte_codes(fold_case=True)


class WaveletMatrix:
    """Ranks of symbols in a string, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, at = [], symbols
        for b in range(bits - 1, -1, -1):
            one = ((at >> b) & 1).astype(np.uint8)
            padded = np.zeros(-(-(len(one) + 1) // 64) * 64, np.uint8)
            padded[: len(one)] = one
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((b, words, before, len(one) - int(before[-1])))
            at = np.concatenate([at[one == 0], at[one == 1]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of symbol[i] before each end[i]."""
        n = len(symbol)
        at = np.concatenate([np.zeros(n, np.int64), *ends])
        sym = np.tile(symbol, 1 + len(ends))
        for b, words, before, zeros in self.levels:
            w = at >> 6
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((sym >> b) & 1 == 1, zeros + ones, at - ones)
        return [at[n * (k + 1) : n * (k + 2)] - at[:n] for k in range(len(ends))]


def suffix_array(key: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; ends when all ranks differ."""
    n = len(key)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        up = np.empty(n, np.int64)
        up[0] = 0
        np.cumsum(np.diff(both[order]) != 0, out=up[1:])
        rank = np.empty(n, np.int64)
        rank[order] = up
        if up[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """symbols: 1 and up, 0 for separators; the last one must be a separator."""

    def __init__(self, symbols: np.ndarray, most: int):
        gaps = symbols == 0
        n_gaps = int(gaps.sum())
        order = suffix_array(np.where(gaps, np.cumsum(gaps) - 1, n_gaps + symbols.astype(np.int64)))
        self.bwt = symbols[order - 1].astype(np.int64)
        self.first = n_gaps + np.concatenate([[0], np.cumsum(np.bincount(symbols[~gaps], minlength=most + 1))])
        self.ranks = WaveletMatrix(self.bwt, max(1, int(most).bit_length()))
        kept = (order % SAMPLE == 0) | (self.bwt == 0)  # also at the start of each run, so no walk meets a separator
        self.kept, self.sample = kept, order[kept]
        self.before = np.cumsum(kept) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases (rows of symbols, padded at the end with 0)."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(self.bwt), np.int64)
        for back in range(1, phrases.shape[1] + 1):
            on = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(on):
                break
            sym = phrases[on, lengths[on] - back].astype(np.int64)
            a, b = self.ranks.rank(sym, lo[on], hi[on])
            lo[on], hi[on] = self.first[sym] + a, self.first[sym] + b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            done = self.kept[r]
            out[todo[done]] = self.sample[self.before[r[done]]] + steps[todo[done]]
            todo = todo[~done]
            sym = self.bwt[rows[todo]]
            rows[todo] = self.first[sym] + self.ranks.rank(sym, rows[todo])[0]
            steps[todo] += 1
        return out


class Phrases:
    """The distinct windows of a block of items as symbols, and the items of each."""

    def __init__(self, items: pd.DataFrame):
        items = items[items["text"].notna()]
        offsets, data = buffers(pa.array(items["text"].tolist(), pa.string()))
        offsets, data = offsets - (offsets[0] if len(offsets) else 0), data
        starts, ends = word_bounds(offsets, data, WORD_BYTES)
        words = span_hashes(data, starts, ends, _CODES)
        first = np.searchsorted(starts, offsets)
        _, at = shingle_hashes(words, first, WINDOW)
        counts = np.diff(first)
        item = np.repeat(np.arange(len(counts)), np.diff(at))
        start = first[:-1][item] + (np.arange(at[-1]) - at[:-1][item])
        length = np.minimum(WINDOW, counts[item])
        self.vocabulary = np.unique(words)
        symbols = np.append(np.searchsorted(self.vocabulary, words) + 1, np.zeros(WINDOW, np.int64))
        table = np.where(np.arange(WINDOW) < length[:, None], symbols[start[:, None] + np.arange(WINDOW)], 0).astype(np.int32)
        self.symbols, inverse = np.unique(table.reshape(-1, WINDOW), axis=0, return_inverse=True)
        self.lengths = (self.symbols > 0).sum(axis=1)
        self.names = np.array([None if pd.isna(x) else str(x) for x in items["item"]], object)
        pairs = np.unique(np.stack([inverse.reshape(-1), item]), axis=1) if len(item) else np.zeros((2, 0), np.int64)
        self.items, self.items_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.lengths) + 1))

    def symbols_of(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0).astype(np.int32)


def shard_hits(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text; per text the byte spans of hit words with their number of words, and the items found."""
    n = len(column)
    n_words = np.zeros(n, np.int64)
    held: list[tuple[np.ndarray, ...]] = []
    least = int(phrases.lengths.min()) if len(phrases.lengths) else 0
    for lo, hi, offsets, data in chunks(column):
        starts, ends = word_bounds(offsets, data, WORD_BYTES)
        first = np.searchsorted(starts, offsets)
        n_words[lo:hi] = np.diff(first)
        if not least or not len(starts):
            continue
        sym = phrases.symbols_of(span_hashes(data, starts, ends, _CODES))
        text = np.repeat(np.arange(hi - lo), np.diff(first))
        # Runs of words of the vocabulary inside one text, as long as the shortest phrase at least.
        known = sym > 0
        begin = known & ~(np.append(False, known[:-1]) & np.append(False, text[1:] == text[:-1]))
        run = np.cumsum(begin) - 1
        size = np.bincount(run[known], minlength=int(begin.sum()))
        keep = known.copy()
        keep[known] = size[run[known]] >= least
        at = np.flatnonzero(keep)
        if not len(at):
            continue
        # A separator after each run: the words move up by the number of runs before them.
        own = run[at]
        ends_run = np.append(own[1:] != own[:-1], True)
        place = np.arange(len(at)) + np.cumsum(np.append(0, ends_run[:-1]))
        symbols = np.zeros(len(at) + int(ends_run.sum()), np.int32)
        symbols[place] = sym[at]
        where = np.zeros((3, len(symbols)), np.int64)
        where[:, place] = text[at] + lo, starts[at] - offsets[text[at]], ends[at] - offsets[text[at]]
        held.append((symbols, where))
    empty = [np.zeros((0, 3), np.int64)] * n, [np.zeros(0, np.int64)] * n
    if not held:
        return n_words, *empty
    symbols, where = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held], axis=1)
    index = FMIndex(symbols, len(phrases.vocabulary))
    lo, hi = index.search(phrases.symbols, phrases.lengths)
    count = np.maximum(hi - lo, 0)
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
    found = index.locate(rows)
    if not len(found):
        return n_words, *empty
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + phrases.lengths[phrase], -1)
    hit = np.cumsum(cover[:-1]) > 0
    first_hit = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
    last_hit = np.flatnonzero(hit & ~np.append(hit[1:], False))
    spans = np.stack([where[1][first_hit], where[2][last_hit], last_hit - first_hit + 1], axis=1)
    cut = np.searchsorted(where[0][first_hit], np.arange(n + 1))
    # (text, item) pairs: each phrase brings its items.
    pair = np.unique(where[0][found] * len(count) + phrase)
    text, phrase = pair // len(count), pair % len(count)
    many = np.diff(phrases.items_at)[phrase]
    item = phrases.items[np.repeat(phrases.items_at[phrase] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    pair = np.unique(np.repeat(text, many) * len(phrases.names) + item)
    at = np.searchsorted(pair // len(phrases.names), np.arange(n + 1))
    return n_words, [spans[cut[i] : cut[i + 1]] for i in range(n)], [pair[at[i] : at[i + 1]] % len(phrases.names) for i in range(n)]


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of several passes: overlapping ones are joined; the words of a joined span are counted anew by _words."""
    out: list[list[int]] = []
    for s, e, w in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = [out[-1][0], max(e, out[-1][1]), w if e >= out[-1][1] and s == out[-1][0] else -1]
        else:
            out.append([s, e, w])
    return [tuple(x) for x in out]


def _words(text: str, s: int, e: int) -> int:
    data = np.frombuffer(text.encode()[s:e], np.uint8)
    return len(word_bounds(np.array([0, len(data)]), data, WORD_BYTES)[0])


def _distinct(names: Iterable[str | None]) -> list[str | None]:
    """Each name once, ascending; null, of items without an id, is last."""
    return sorted(set(names), key=lambda x: (x is None, x or ""))


def _pass(phrases: Phrases, more: bool, cut: bool):
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, _, _ in chunks(texts, SHARD_BYTES):
                part = batch.slice(lo, hi - lo)
                n_words, spans, items = shard_hits(part.column(1), phrases)
                spans = [[tuple(map(int, s)) for s in x] for x in spans]
                names = [_distinct(phrases.names[x]) for x in items]
                if more:
                    for i, (old, ids) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)):
                        if old:
                            text = part.column(1)[i].as_py()
                            spans[i] = [(s, e, _words(text, s, e) if w < 0 else w) for s, e, w in _merged(spans[i] + [(x["s"], x["e"], x["words"]) for x in old])]
                            names[i] = _distinct([*names[i], *ids])
                as_rows = [[{"s": s, "e": e, "words": w} for s, e, w in x] for x in spans]
                own = pa.array([_cut(t.as_py(), x) if x else t.as_py() for t, x in zip(part.column(1), spans, strict=True)], pa.string()) if cut and any(spans) else part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), own, pa.array(n_words), pa.array(as_rows, span), pa.array(names, pa.list_(pa.string()))], ["row", "text", "n_words", "spans", "items"])

    return run


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Phrases]:
    """The items in blocks of bounded text; one block at a time is on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).toLocalIterator():
        if block and size + len(row["text"] or "") * 4 > block_bytes:
            yield Phrases(pd.DataFrame(block, columns=["item", "text"]))
            block, size = [], 0
        block.append(tuple(row))
        size += len(row["text"] or "") * 4
    yield Phrases(pd.DataFrame(block, columns=["item", "text"]))


def _cut(text: str, spans: list[tuple[int, int, int]]) -> str:
    raw = text.encode()
    at = [0, *(x for s, e, _ in spans for x in (s, e)), len(raw)]
    return b"".join(raw[at[j] : at[j + 1]] for j in range(0, len(at), 2)).decode()


def find(rows: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """rows: `row` (anything) and `text`.  Adds n_words, spans (byte ranges s to e with their hit words, ascending) and items (found, each once, sorted as strings, a null last for items without an id).

    With cut the text comes back without its spans, from the last pass.
    """
    kind = rows.schema["row"].dataType.simpleString()
    out, more = rows.select("row", "text"), False
    blocks = benchmark_blocks(benchmark, item_col, text_col, block_bytes)
    phrases = next(blocks)
    while phrases is not None:
        ahead = next(blocks, None)
        out = stored(out, "pass") if more else out
        out = out.mapInArrow(_pass(phrases, more, cut and ahead is None), f"row {kind}, text string, n_words long, spans array<struct<s:long,e:long,words:long>>, items array<string>")
        phrases, more = ahead, True
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents without the removal spans, with the input's columns; one of which no word is left goes."""
    names = docs.columns
    others = [F.col(f"`{c}`") for c in names if c != text_col]
    rows = docs.select(F.struct(*others, F.lit(0).alias(text_col)).alias("row"), F.col(text_col).alias("text"))
    found = find(rows, benchmark, cut=True)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    kept = found.filter((hits == 0) | (hits < F.col("n_words")))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find(docs.select(F.struct("doc_id").alias("row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select(
        "row.doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, x.n, item_id FROM x JOIN p ON x.k = p.k AND x.n = p.n),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

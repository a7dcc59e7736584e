"""Near-duplicate classes by consistent weighted sampling of TF-IDF shingles.

A text's vector holds its word 5-grams, each weighing its count times an inverse
document frequency.  That depends only on the share of texts which hold the
shingle: 1 + idf for a share of `rare` or less, falling with the logarithm of
the share to 1 for a shingle of all texts, so a corpus of ten times the texts
weighs alike.  Shingles above `rare` are at most the mean length of a text
divided by `rare` in number, whatever the input: counters tell which shingles
can be among them, these are counted exactly, and that table goes to the workers
(`rare` rises where texts are so long that the table would pass `most_heavy`).
idf is damped to 1..1.25: with the full logarithm, edits of a passage that a
large group shares outweigh the passage, and near copies of the group fall
below the threshold.

Signatures are improved consistent weighted samples of the whole weighted
vector, by one scheme for texts of every length; samples are banded.

Candidates are verified by the weighted Jaccard similarity of their vectors.  A
bucket is worked off in rounds.
1. In the first, all members are compared with the one in the largest buckets,
   likely the original of its copies.
2. Afterwards, in every bucket of more than `small` members that are not yet of
   one component, members that can be similar to none leave: what of a text's
   weight is in shingles that no other such member holds can't be shared, and
   with the rest, the weights of the bucket's members bound its similarity to
   each of them below the threshold.  This loses no link.
3. Some members lead (those of small buckets only, and of others from round to
   round sixteen times as many, drawn by hash), are compared with the members of
   their buckets that are not of their component and leave.  Pairs that the bound excludes are
   not compared.  A bucket whose members are all of one component is done.
So copies of one original cost one comparison each, and every pair of a bucket
that is neither connected otherwise nor excluded by the bound is compared.
Links join components in one task where there are `FEW_ROWS` at most, beyond
that by label propagation over tables; hot buckets, leads and components are
joined as spread.py says, so no task holds a group.

Texts equal in all bytes (in 128 bits of their SHA-256) are one node from the
start.  Null texts count as empty; texts without words are only near their
equals.  The class of a row is the smallest id among its members (null if they
have none).  Rows are never dropped by `classes`.  Columns of any name pass
through `deduplicate`.  Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import FEW_ROWS, split_by, spread_join
from .textwork import WORD_BYTES, buffers, byte_codes, chunks, dropped, mix, shingle_hashes, span_hashes, stored, widened, word_bounds

_U = np.uint64
_CODES = byte_codes(17, fold_case=True)


@dataclass(frozen=True)
class NearParameters:
    width: int = 5
    similarity: float = 0.8
    samples: int = 64
    bands: int = 16
    #: A shingle of this share of the texts, or less, weighs 1 + idf; one of all texts 1.
    rare: float = 1 / 256
    idf: float = 0.25
    most_heavy: int = 1 << 18
    #: Buckets of more members are pruned by the bound; members of no larger one lead in the second round.
    small: int = 16
    counters_log2: int = 20


@dataclass(frozen=True)
class Weights:
    """idf weight of a shingle: that of `heavy`, else the most."""

    heavy: np.ndarray
    weight: np.ndarray
    most: float

    def of(self, sid: np.ndarray) -> np.ndarray:
        out = np.full(len(sid), self.most, np.float32)
        if len(self.heavy) and len(sid):
            at = np.minimum(np.searchsorted(self.heavy, sid), len(self.heavy) - 1)
            on = self.heavy[at] == sid
            out[on] = self.weight[at[on]]
        return out


def shingles(offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit shingles of each text, sorted, with repeats, as text << 32 | shingle; offsets of the texts among them."""
    starts, ends = word_bounds(offsets, data, WORD_BYTES)
    words = span_hashes(data, starts, ends, _CODES)
    h, at = shingle_hashes(words, np.searchsorted(starts, offsets), width)
    text = np.repeat(np.arange(len(at) - 1, dtype=_U), np.diff(at))
    return np.sort(text << _U(32) | h >> _U(32)), at


def _vectors(width: int):
    """id, node, text -> id, node, vector: the sorted 32-bit shingles with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in chunks(batch.column(2)):
                keys, at = shingles(offsets, data, width)
                raw = pa.py_buffer((keys & _U(0xFFFFFFFF)).astype(np.uint32).tobytes())
                vectors = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()), raw])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), vectors], ["id", "node", "vector"])

    return run


def _counted(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors' bytes -> text, shingle and count of each distinct shingle of each text."""
    sid = np.frombuffer(np.ascontiguousarray(data[offsets[0] : offsets[-1]]).tobytes(), np.uint32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) // 4)
    if not len(sid):
        return text, sid, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (sid[1:] != sid[:-1]) | (text[1:] != text[:-1])]))
    return text[first], sid[first], np.diff(np.append(first, len(sid)))


# --- document frequencies ---


def _load(log2: int):
    """Texts in each counter, in slots of 2**14 counters; slot -1 holds texts and distinct shingles."""
    slots = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << log2, np.int32), np.zeros(2, np.int64)
        for batch in batches:
            seen[0] += batch.num_rows
            for _, _, offsets, data in chunks(batch.column(0)):
                _, sid, _ = _counted(offsets, data)
                seen[1] += len(sid)
                total += np.bincount(sid & np.uint32((1 << log2) - 1), minlength=1 << log2).astype(np.int32)
        parts = total.reshape(-1, slots)
        full = np.flatnonzero(parts.any(axis=1))
        slot = pa.array([-1, *full.tolist()], pa.int32())
        part = pa.array(np.full(len(slot), TaskContext.get().partitionId() // 128, np.int32))
        yield pa.RecordBatch.from_arrays([slot, part, pa.array([seen.tobytes(), *(parts[i].astype(np.int64).tobytes() for i in full)], pa.binary())], ["slot", "part", "counts"])

    return run


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = 0
    for x in group["counts"]:
        total = total + np.frombuffer(x, np.int64)
    return pd.DataFrame({"slot": group["slot"].iloc[:1], "part": group["part"].iloc[:1], "counts": [total.tobytes()]})


def _suspected(flags: np.ndarray):
    """Shingles whose counter is flagged, and the texts of this task that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sids, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, offsets, data in chunks(batch.column(0)):
                _, sid, _ = _counted(offsets, data)
                own, n = np.unique(sid[flags[sid & np.uint32(len(flags) - 1)]], return_counts=True)
                sids, back = np.unique(np.append(sids, own), return_inverse=True)
                counts = np.bincount(back, np.append(counts, n), minlength=len(sids)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sids.astype(np.int64)), pa.array(counts)], ["sid", "n"])

    return run


def weights_of(vectors: DataFrame, p: NearParameters) -> Weights:
    """idf weights from document frequencies over all rows of `vector`."""
    sums = vectors.select("vector").mapInArrow(_load(p.counters_log2), "slot int, part int, counts binary")
    for fan in (1, 0):  # 128 tasks' counters meet at a time, then these sums
        sums = sums.withColumn("part", F.col("part") * fan).groupBy("slot", "part").applyInPandas(_add, "slot int, part int, counts binary")
    loads, texts, every = np.zeros(1 << p.counters_log2, np.int64), 0, 0
    for r in sums.collect():  # 65 rows at most
        counts = np.frombuffer(r["counts"], np.int64)
        if r["slot"] < 0:
            texts, every = map(int, counts)
        else:
            loads[r["slot"] * len(counts) : (r["slot"] + 1) * len(counts)] = counts
    share = max(p.rare, every / max(1, texts) / p.most_heavy)
    flags = loads > share * texts
    heavy, n = np.zeros(0, np.uint32), np.zeros(0)
    if flags.any():
        # At most 1 / share times the mean number of shingles a text: the bound on what is collected.
        found = vectors.select("vector").mapInArrow(_suspected(flags), "sid long, n long").groupBy("sid").agg(F.sum("n").alias("n")).filter(F.col("n") > share * texts).orderBy("sid").collect()
        heavy, n = np.array([r["sid"] for r in found], np.uint32), np.array([r["n"] for r in found], float)
    return Weights(heavy, (1 + p.idf * np.log(texts / np.maximum(n, 1)) / np.log(1 / share)).astype(np.float32) if share < 1 else np.ones(len(heavy), np.float32), 1 + p.idf)


# --- consistent weighted samples ---


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of 2**16 steps."""
    x = np.exp(np.linspace(np.log(1e-4), np.log(40), 400_000))
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), -np.expm1(-x) - x * np.exp(-x), x)


_GAMMA = _gamma_quantiles()
_LOG_C, _R, _PER_R = np.log(_GAMMA).astype(np.float32), _GAMMA.astype(np.float32), (1 / _GAMMA).astype(np.float32)


def draws(sid: np.ndarray, log_weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Improved consistent weighted sampling, sample k: each element's log of a, and its t."""
    h = sid.astype(_U) * mix(np.array([2 * k + 1], _U))[0].__or__(_U(1))
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    lanes = h.view(np.uint16).reshape(-1, 4)
    c = _LOG_C[lanes[:, 0]]
    if len(low := np.flatnonzero(lanes[:, 0] == 0)):  # the least step, in which long texts have many elements, is parted further
        c[low] = 0.5 * np.log((lanes[low, 3] + np.float32(0.5)) * np.float32(2.0**-31))
    beta = (lanes[:, 2] + np.float32(0.5)) * np.float32(2.0**-16)
    t = np.floor(log_weight * _PER_R[lanes[:, 1]] + beta)
    return c - _R[lanes[:, 1]] * (t - beta + np.float32(1)), t


def signatures(text: np.ndarray, sid: np.ndarray, weight: np.ndarray, p: NearParameters) -> tuple[np.ndarray, np.ndarray]:
    """texts that have shingles, and their bands (a row of hashes each); elements are sorted by text."""
    if not len(sid):
        return np.zeros(0, np.int64), np.zeros((0, p.bands), _U)
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    n = np.diff(np.append(first, len(text)))
    log_weight, out = np.log(weight).astype(np.float32), np.zeros((len(first), p.bands), _U)
    out += np.arange(p.bands, dtype=_U)
    for k in range(p.samples):
        a, t = draws(sid, log_weight, k)
        hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), n))
        one = hit[np.searchsorted(hit, first)]  # of equal values the smallest shingle
        band = k // (p.samples // p.bands)
        out[:, band] = mix(out[:, band] + mix(sid[one].astype(_U) + (t[one].astype(np.int64).astype(_U) << _U(33)) + _U(k)))
    return text[first], out


def _deal(weights: Weights, p: NearParameters):
    """node, vector -> a row (bucket, node) for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in chunks(batch.column(1)):
                text, sid, count = _counted(offsets, data)
                which, bands = signatures(text, sid, count * weights.of(sid), p)
                node = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(which, p.bands)))
                yield pa.RecordBatch.from_arrays([pa.array(bands.reshape(-1).view(np.int64)), node], ["bucket", "node"])

    return run


# --- verification ---


def similarities(a: pa.Array, b: pa.Array, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of vectors."""
    n = len(a)

    def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text, sid, count = _counted(*buffers(column))
        return text.astype(_U) << _U(32) | sid, count

    (ka, ca), (kb, cb) = counted(a), counted(b)
    weigh = lambda keys, counts: np.bincount((keys >> _U(32)).astype(np.int64), counts * weights.of((keys & _U(0xFFFFFFFF)).astype(np.uint32)).astype(np.float64), minlength=n)
    at = np.minimum(np.searchsorted(kb, ka), max(0, len(kb) - 1))
    both = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
    shared = weigh(ka[both], np.minimum(ca[both], cb[at[both]]))
    every = weigh(ka, ca) + weigh(kb, cb) - shared
    return np.divide(shared, every, out=np.zeros(n), where=every > 0)


def _verify(weights: Weights, least: float):
    """cm, cl, vm, vl -> components of the pairs whose vectors are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(buffers(batch.column(2))[0]) + np.diff(buffers(batch.column(3))[0])
            part = np.cumsum(size) >> 21  # about 2 MiB of vectors at once
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    own = batch.slice(lo, hi - lo)
                    near = pa.array(similarities(own.column(2), own.column(3), weights) >= least)
                    yield pa.RecordBatch.from_arrays([own.column(0).filter(near), own.column(1).filter(near)], ["a", "b"])

    return run


def _totals(weights: Weights):
    """node, vector -> node, vector, w: the vector's weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, hi, offsets, data in chunks(batch.column(1)):
                text, sid, count = _counted(offsets, data)
                out.append(np.bincount(text, count * weights.of(sid).astype(np.float64), minlength=hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out) if out else np.zeros(0))], ["node", "vector", "w"])

    return run


def _elements(weights: Weights):
    """node, vector -> a row (sid, node, x) for each distinct shingle: its weight in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in chunks(batch.column(1)):
                text, sid, count = _counted(offsets, data)
                node = batch.column(0).slice(lo, hi - lo).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([pa.array(sid.view(np.int32)), node, pa.array(count * weights.of(sid).astype(np.float64))], ["sid", "node", "x"])

    return run


# --- components ---

#: Edges that one task of the label propagation takes.
EDGES_A_TASK = 50_000


def united(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of n nodes; a, b: links.  Roots go under the smallest root they are linked to."""
    label = np.arange(n)
    while True:
        one, other = label[a], label[b]
        if not (apart := one != other).any():
            return label
        np.minimum.at(label, np.maximum(one, other)[apart], np.minimum(one, other)[apart])
        while ((up := label[label]) != label).any():
            label = up


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) -> node, label."""
    links = list(batches)
    if not sum(batch.num_rows for batch in links):
        return
    a, b = (pa.chunked_array([batch.column(k) for batch in links]) for k in (0, 1))
    nodes = pc.unique(pa.chunked_array([*a.chunks, *b.chunks]))
    nodes = nodes.take(pc.array_sort_indices(nodes))
    label = united(pc.index_in(a, nodes).to_numpy(), pc.index_in(b, nodes).to_numpy(), len(nodes))
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["node", "label"])


def components(links: DataFrame, n: int | None = None) -> DataFrame:
    """node, label: the smallest node of its component, of the nodes with links (a, b); stored.  n: the number of links, if it is known.

    Of at most FEW_ROWS links one task makes them; the propagation takes some thirty jobs, whose plans and stages the driver keeps.
    """
    spark = links.sparkSession
    if (links.count() if n is None else n) <= FEW_ROWS:
        kind = links.schema["a"].dataType.simpleString()
        return stored(links.select("a", "b").coalesce(1).mapInArrow(_united, f"node {kind}, label {kind}"), "labels")
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total = edges.count()
    few = total // EDGES_A_TASK + 1  # small graphs need few tasks
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), "n").coalesce(few), "labels")
    while True:
        # The least label among the neighbours and of these, then the label of that label.
        met = spread_join(edges.select("a", F.col("b").alias("node")), labels, "node", "n", total)
        near = met.groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", "n", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        if total > FEW_ROWS:
            held = lower.groupBy("label").agg(F.count(F.lit(1)).alias("held"))
            jump = held.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        else:
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"), F.lit(0).alias("held"))
        new = stored(spread_join(lower, jump, "label", "held", total, "left").select("node", "n", "old", F.least("label", F.coalesce("next", "label")).alias("label")).coalesce(few), "labels")
        moved = new.filter(F.col("label") != F.col("old")).limit(1).count()
        dropped(spark, labels)
        labels = new.select("node", "label", "n")
        if not moved:
            dropped(spark, edges)
            return labels


def _renamed(rows: DataFrame, names: DataFrame, total: int) -> DataFrame:
    """rows (total, at most) with comp replaced by its label in names, if it has one."""
    keyed = names.select(F.col("node").alias("comp"), "label", F.lit(0).alias("held"))
    if total > FEW_ROWS:
        keyed = keyed.drop("held").join(rows.groupBy("comp").agg(F.count(F.lit(1)).alias("held")), "comp")
    return spread_join(rows, keyed, "comp", "held", total, "left").withColumn("comp", F.coalesce("label", "comp")).drop("label", "held")


# --- rounds ---

#: Members of a bucket that meet its leads in one task.
MEMBERS_A_TASK = 500
#: Rows of a file of the rounds' tables.
MEMBERS_A_FILE = 20_000
#: Vectors of hot leads that are broadcast are of this many bytes at most each (and a thousand at most).
HOT_VECTOR = 1 << 16
#: Steps of the logarithm of a weight that make a class; slack for rounding.
_STEPS, _SLACK = 50.0, 1e-4


def _bound(r: Column, least_weight: Column, w: Column, other: Column) -> Column:
    """The most that two vectors' similarity can be: weights w and at least least_weight, of which at most r and other are shared."""
    shared = F.least(r, other)
    return shared / (w + F.greatest(least_weight, shared) - shared)


def _pruned(members: DataFrame, vectors: DataFrame, weights: Weights, few: int, p: NearParameters) -> DataFrame:
    """members of large buckets that may be similar to another, with r: what of their weight another may share."""
    own = vectors.join(members.select("node").distinct(), "node", "left_semi").select("node", "vector")
    alone = own.mapInArrow(_elements(weights), "sid int, node binary, x double").groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("x").alias("x")).filter("n = 1")
    unshared = alone.groupBy("node").agg(F.sum("x").alias("x"))
    known = stored(members.drop("r").join(unshared, "node", "left").withColumn("r", F.col("w") - F.coalesce("x", F.lit(0.0))).drop("x").withColumn("cls", F.floor(F.log("w") * _STEPS)).coalesce(few), "members")
    # Classes of weight are steps of 2 %: a few hundred a bucket at most.
    classes = known.groupBy("bucket", "cls").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.collect_list(F.struct("cls", "r", "n")).alias("classes"), F.sum("n").alias("size"))
    total = known.count()
    met = spread_join(known, classes, "bucket", "size", total)
    others = F.filter("classes", lambda c: (c["cls"] != F.col("cls")) | (c["n"] > 1))
    near = F.exists(others, lambda c: _bound(F.col("r"), F.exp(c["cls"] / _STEPS), F.col("w"), c["r"]) >= p.similarity - _SLACK)
    out = stored(met.filter(near).select(*members.columns).coalesce(few), "members")
    dropped(members.sparkSession, known)
    return out


def labelled(vectors: DataFrame, weights: Weights, p: NearParameters) -> DataFrame | None:
    """node, comp: the component of each node that is linked to another, stored; None without links.  vectors: node, vector."""
    spark = vectors.sparkSession
    dealt = stored(vectors.mapInArrow(_deal(weights, p), "bucket long, node binary").distinct(), "dealt")
    shared = stored(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    n_shared, total = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    _, suspects = split_by(dealt, F.xxhash64("bucket"), shared.select(F.xxhash64("bucket")), n_shared)
    placed = stored(spread_join(suspects, shared, "bucket", "n", total), "placed")
    dropped(spark, dealt, shared)
    scores = stored(placed.groupBy("node").agg(F.sum("n").alias("score")), "scores")
    _, wanted = split_by(vectors, F.xxhash64("node"), scores.select(F.xxhash64("node")), scores.count())
    vectors = stored(wanted.groupBy("node").agg(F.first("vector").alias("vector")).mapInArrow(_totals(weights), "node binary, vector binary, w double"), "vectors")
    known = scores.join(vectors.select("node", "w"), "node")
    members = stored(placed.select("bucket", "node").join(known, "node").select("bucket", "node", F.col("node").alias("comp"), "score", "w", F.col("w").alias("r")).coalesce(max(1, total // MEMBERS_A_FILE)), "members")
    dropped(spark, placed, scores)
    few = max(1, total // MEMBERS_A_FILE)  # the rounds' tables are small: few files
    columns, turn, pruned, seen, n_seen = ["bucket", "node", "comp", "score", "w", "r"], 0, False, [], 0
    top = F.max(F.struct("score", "node", "comp", "w", "r"))
    while True:
        alive = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), top.alias("top")).filter("c1 != c2").drop("c1", "c2")
        alive = stored(alive.coalesce(few), "alive")
        total = alive.agg(F.sum("n")).first()[0]
        if not total:
            dropped(spark, alive, members, vectors)
            # Links of all rounds are between representatives: their components are those of the nodes.
            labels = components(reduce(DataFrame.union, seen), n_seen).select("node", F.col("label").alias("comp")) if seen else None
            dropped(spark, *seen)
            return labels
        few = max(1, total // MEMBERS_A_FILE)
        flagged = stored(spread_join(members.select(columns), alive, "bucket", "n", total).coalesce(few), "flagged")
        dropped(spark, members, alive)
        if 0 < turn < 3 and not pruned:
            large = flagged.filter(F.col("n") > p.small).select(columns)
            if large.limit(1).count():
                fewer = _pruned(large, vectors, weights, few, p)
                members = stored(fewer.unionByName(flagged.filter(F.col("n") <= p.small).select(columns)).coalesce(few), "members")
                dropped(spark, fewer, flagged)
                pruned = True
                continue
        if turn:
            # A node leads in all of its buckets or in none, so the first bucket in which two members meet makes their pair.
            own = Window.partitionBy("node")
            flagged = flagged.withColumn("most", F.max("n").over(own)).withColumn("mine", F.collect_list("bucket").over(own))
            flagged = flagged.withColumn("lead", (F.col("most") <= p.small) | (F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("most")) < 1 << 4 * turn))
        else:
            flagged = flagged.withColumn("lead", F.col("node") == F.col("top.node"))
        if turn:
            # The members of a bucket are dealt over parts, and its leads go to each.
            parts = F.ceil(F.col("n") / MEMBERS_A_TASK).cast("int")
            lead = flagged.filter("lead").select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.struct("node", "comp", "w", "r", "mine").alias("l"))
            met = flagged.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).join(lead, ["bucket", "part"])
            met = met.filter(~F.col("lead") | (F.col("node") < F.col("l.node")))
        else:
            met = flagged.filter("not lead").withColumn("l", F.col("top"))
        likely = _bound(F.col("r"), F.col("l.w"), F.col("w"), F.col("l.r")) >= p.similarity - _SLACK
        once = F.col("bucket") == F.array_min(F.array_intersect("mine", "l.mine")) if turn else F.lit(True)
        pairs = met.filter((F.col("comp") != F.col("l.comp")) & likely & once).select("node", F.col("l.node").alias("l"), F.col("comp").alias("cm"), F.col("l.comp").alias("cl")).distinct()
        pairs = stored(pairs.coalesce(few), "pairs")
        asked = pairs.groupBy("l").agg(F.count(F.lit(1)).alias("asked"))
        leading = asked.join(vectors.select(F.col("node").alias("l"), F.col("vector").alias("vl")), "l").withColumn("asked", F.when(F.octet_length("vl") <= HOT_VECTOR, F.col("asked")).otherwise(0))
        both = spread_join(pairs.join(vectors.select("node", F.col("vector").alias("vm")).hint("merge"), "node"), leading, "l", "asked", pairs.count())
        linked = stored(both.select("cm", "cl", "vm", "vl").mapInArrow(_verify(weights, p.similarity), "a binary, b binary").distinct().coalesce(few), "links")
        left = flagged.filter("not lead").select(columns)
        if n_linked := linked.count():
            names = components(linked, n_linked)
            members = stored(_renamed(left, names, total).coalesce(few), "members")
            seen.append(linked)
            n_seen += n_linked
            dropped(spark, names)
        else:
            members = stored(left, "members")
            dropped(spark, linked)
        dropped(spark, flagged, pairs)
        turn, pruned = turn + 1, False


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearParameters = NearParameters()) -> DataFrame:
    """id, node (16 bytes that stand for the text), class_id, class_size of each row; stored."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), _node(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vectors = stored(widened(own).mapInArrow(_vectors(p.width), f"id {kind}, node binary, vector binary"), "vectors")
    weights = weights_of(vectors, p)
    labels = labelled(vectors.select("node", "vector"), weights, p)
    rows = stored(vectors.select("id", "node"), "rows")
    dropped(spark, vectors)
    # One row a text, then a class: only texts that have copies or a component differ from their own.
    nodes = rows.groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    nodes = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if labels else nodes.withColumn("comp", F.col("node"))
    nodes = stored(nodes, "nodes")
    sizes = nodes.groupBy("comp").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("held"))
    told = stored(spread_join(nodes.select("node", "comp", "n"), sizes, "comp", "held", nodes.count()).select("node", "n", "class_id", "class_size"), "told")
    out = stored(spread_join(rows, told, "node", "n", rows.count()).select("id", "node", "class_id", "class_size"), "classes")
    dropped(spark, rows, nodes, told, *([labels] if labels else []))
    return out


def _node(text_col: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearParameters = NearParameters()) -> DataFrame:
    """One text of each class, that of the smallest id, with the input's columns; rows equal in id and text are one document and stay together.

    A class all of whose ids are null keeps its rows of one text.  Rows that stay are not shuffled.
    """
    spark = docs.sparkSession
    found = classes(docs, id_col, text_col, p)
    # The smallest id may have several texts in a class: one of them stays.
    many = found.filter("class_size > 1")
    stays = many.filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("node").alias("stays"), F.max("class_size").alias("held"))
    total = many.count()
    named = lambda df: df.withColumn("_c", F.coalesce(F.to_json(F.struct("class_id")), F.lit("")))
    met = spread_join(named(many.drop("class_size")), named(stays).drop("class_id"), "_c", "held", total)
    gone = stored(met.filter(~(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("stays")))).select("id", "node").distinct(), "gone")
    dropped(spark, found)
    key = lambda a, b: F.xxhash64(a, b)
    names = [f"c{i}" for i in range(len(docs.columns))]  # names of the input may clash with ours
    rows = docs.toDF(*names)
    here = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    clear, suspects = split_by(rows.withColumn("_node", _node(here[1])), key(F.col(here[0]), F.col("_node")), gone.select(key(F.col("id"), F.col("node"))), gone.count())
    out = suspects.join(gone.withColumnsRenamed({"id": "_id", "node": "_gone"}).hint("merge"), F.col("_id").eqNullSafe(F.col(here[0])) & (F.col("_gone") == F.col("_node")), "left_anti")
    return clear.unionByName(out).select(*names).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))

"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of rows by a hash of the row's id.  A source's
target, in words, becomes an exact quota of blocks: whole passes over all its
blocks, then blocks of a seeded permutation, and of the last block the rows in
hash order that bring the source closest to its target.  The quotas of all
sources are then split over the output shards by a binary tree: each node
draws, from the multivariate hypergeometric distribution, how many of its
blocks of each source go left.  Leaves draw disjoint ranges of the permuted
blocks and each shard is shuffled on its own.

Sources and blocks are tables; a source's blocks are permuted and cut in one
task.  The driver holds one number per stratum: a stratum is a source, or beyond
`most_strata` sources the sources of one hash, whose takes stand one after the
other.  Blocks are of `block_rows` rows, or larger, so that there are
`most_blocks` plus one a source: with that many the table that tells each row
its shards is broadcast; with more sources rows are shuffled by block instead.
There are no more shards than takes.

Null texts have size 0, null sources are one source, placed last.  Rows equal
in id and source are taken together.  A source of size 0 has target 0 and is
not taken.  Empty input gives an empty mix.  Draws depend only on `seed`, ids
and sizes, so reruns agree.  Input columns of any name pass through `mix`; its
own two get underscores where their names are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textwork import NON_SPACE_BYTES, chunks, dropped, stored, word_counts

WEIGHTS, SHARE, MOST_REPEATS = (3, 1, 2), 1.5, 2.0


@dataclass(frozen=True)
class MixParameters:
    """weights cycle over the sources by code point; the targets share `share` of all words, each at most `most_repeats` times its source."""

    weights: tuple[float, ...] = WEIGHTS
    share: float = SHARE
    most_repeats: float = MOST_REPEATS
    block_rows: int = 256
    most_blocks: int = 1 << 17
    most_strata: int = 100_000
    shard_words: int = 4_000_000
    seed: int = 20


def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, source, text -> id, source, words of the text and a number of the row."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        n = [word_counts(offsets, data, NON_SPACE_BYTES) for _, _, offsets, data in chunks(batch.column(2))]
        size = np.concatenate(n) if n else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int64)), pa.array(np.arange(row, row + batch.num_rows))], ["_id", "_source", "_size", "_row"])
        row += batch.num_rows


def level(sources: DataFrame, p: MixParameters) -> float:
    """Words a unit of weight: targets are the lesser of weight times this and the cap, and share what there is.

    sources: size and weight.  Each turn caps the sources that are above their cap at the last level.
    """
    cap, lam = F.col("size") * p.most_repeats, 0.0
    while True:
        over = F.col("weight") * lam > cap
        r = sources.agg(F.sum("size").alias("size"), F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if not r["free"]:
            return lam
        new = max(0.0, p.share * (r["size"] or 0) - (r["capped"] or 0.0)) / r["free"]
        if new <= lam * (1 + 1e-12):
            return lam
        lam = new


def ranked(sources: DataFrame) -> DataFrame:
    """sources with their number by code point, null last; no task sorts them all."""
    spark = sources.sparkSession
    dealt = stored(sources.repartitionByRange(F.col("_source").isNull(), "_source").withColumn("part", F.spark_partition_id()), "sources")
    counts = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    before = dict(zip([k for k, _ in counts], np.cumsum([0, *(n for _, n in counts)]).tolist(), strict=False))
    if not counts:
        return dealt.withColumn("sid", F.lit(0).cast("long")).drop("part")
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part"))
    order = Window.partitionBy("part").orderBy(F.col("_source").isNull(), "_source")
    out = stored(dealt.withColumn("sid", (start + F.row_number().over(order) - 1).cast("long")).drop("part"), "sources")
    dropped(spark, dealt)
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> pd.DataFrame:
    """quotas: blocks of each stratum.  Rows (stratum, shard, n): a shard's numbers sum to an even share, a stratum's to its quota."""
    out, todo = [], [(0, shards, np.flatnonzero(quotas), quotas[quotas > 0].astype(np.int64))]
    while todo:
        first, n, own, have = todo.pop()
        if n == 1:
            out.append(pd.DataFrame({"stratum": own, "shard": np.full(len(own), first), "n": have}))
            continue
        half = n // 2
        left = rng.multivariate_hypergeometric(have, int(have.sum()) * half // n, method="marginals") if len(have) else have
        right = have - left
        todo += [(first, half, own[left > 0], left[left > 0]), (first + half, n - half, own[right > 0], right[right > 0])]
    return pd.concat(out).sort_values(["stratum", "shard"], ignore_index=True)


_ORDER = "sid long, stratum int, block int, place int, blocks int, quota long, room double"


def _permuted(seed: int):
    """A source's blocks in seeded order, its quota of takes, and of the last one, if it is cut, the words there is room for."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("block")
        sid, target, size = int(own["sid"].iloc[0]), float(own["target"].iloc[0]), int(own["words"].sum())
        own = own.iloc[np.random.default_rng([seed, sid]).permutation(len(own))]
        passes = int(target // size) if size else 0
        words = own["words"].to_numpy().cumsum()
        whole = int(np.searchsorted(words, target - passes * size, "right")) if size and target > 0 else 0
        room = target - passes * size - (words[whole - 1] if whole else 0) if size and target > 0 and whole < len(own) else 0.0
        out = own[["sid", "stratum", "block"]].assign(place=np.arange(len(own), dtype=np.int32), blocks=len(own), quota=passes * len(own) + whole + (room > 0), room=np.nan)
        if room > 0:
            out.loc[out["place"] == whole, "room"] = room
        return out

    return run


def _shards_of(split: pd.DataFrame):
    """A stratum's takes, source after source, get the shards that the tree gave the stratum."""
    strata, first = np.unique(split["stratum"].to_numpy(), return_index=True)
    shard, upto = split["shard"].to_numpy(), split["n"].to_numpy().cumsum()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["sid", "place"], ignore_index=True)
        at = np.searchsorted(strata, group["stratum"].iloc[0])
        lo = first[at] if at < len(strata) and strata[at] == group["stratum"].iloc[0] else len(upto)
        start = (upto[lo - 1] if lo else 0) + np.where(group["place"] == 0, group["quota"], 0).cumsum() - group["quota"]
        takes, cut = [], []
        for s, j, n, quota, room in zip(start, group["place"], group["blocks"], group["quota"], group["room"], strict=True):
            i = np.arange(j, quota, n)
            where = shard[np.searchsorted(upto, s + i, "right")] if len(i) else i
            last = len(i) > 0 and room == room  # the last take of a cut block is of some of its rows
            cut.append(int(where[-1]) if last else None)
            takes.append([{"shard": int(a), "pass": int(b)} for a, b in zip(where[: len(i) - last], (i // n)[: len(i) - last], strict=True)])
        return pd.DataFrame({"sid": group["sid"], "block": group["block"], "takes": takes, "cut_shard": pd.array(cut, "Int32")})

    return run


def _known(rows: DataFrame, table: DataFrame, on, n: int, how: str, p: MixParameters) -> DataFrame:
    """rows joined to a table of n rows: by broadcast up to `most_blocks` and as many sources, else by a shuffle."""
    return rows.join(F.broadcast(table) if n <= 2 * p.most_blocks else table.hint("merge"), on, how)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", p: MixParameters = MixParameters(), only_sizes: bool = False) -> DataFrame:
    """One row per input row: `row` (all input columns, or id, source and a row number with only_sizes), size, source_size, target and `takes`: where in the mix the row stands, once for each time it is taken."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("_text"))
    sized = stored(own.mapInArrow(sizes, f"_id {kind}, _source string, _size long, _row long"), "sizes")
    sources = ranked(sized.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("rows")))
    n_sources, every = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(1))).first()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), (F.col("sid") % len(p.weights) + 1).cast("int"))
    weighted = sources.withColumn("weight", weight)
    lam = level(weighted, p)
    blocks = F.greatest(F.lit(1), F.least(F.floor(F.col("rows") / p.block_rows), F.floor(F.col("rows") * (p.most_blocks / every)))).cast("int")
    stratum = (F.col("sid") if n_sources <= p.most_strata else F.pmod(F.xxhash64("sid"), F.lit(p.most_strata))).cast("int")
    target = F.least(F.col("weight") * lam, F.col("size") * p.most_repeats)
    known = stored(weighted.select("sid", F.col("_source").alias("s"), F.col("size").alias("source_size"), target.alias("target"), blocks.alias("blocks"), stratum.alias("stratum")), "targets")
    total = known.agg(F.sum("target")).first()[0] or 0.0

    def placed(df: DataFrame) -> DataFrame:
        h = F.xxhash64(F.lit(p.seed), F.col("_id"))
        return _known(df, known, F.col("_source").eqNullSafe(F.col("s")), n_sources, "inner", p).withColumn("_h", h).withColumn("block", F.pmod("_h", F.col("blocks")).cast("int"))

    here = placed(sized)
    cells = here.groupBy("sid", "block").agg(F.sum("_size").alias("words"), F.first("stratum").alias("stratum"), F.first("target").alias("target"))
    order = stored(cells.groupBy("sid").applyInPandas(_permuted(p.seed), _ORDER), "order")
    n_blocks = order.count()
    # The rows of each source's last block: of their prefixes in hash order the one nearest to the room that is left.
    last = order.filter(~F.isnan("room")).select("sid", "block", "room")
    rows = _known(here.select("sid", "block", "_h", "_id", "_size"), last, ["sid", "block"], n_sources, "inner", p)
    key = Window.partitionBy("sid").orderBy("_h", "_id").rangeBetween(Window.unboundedPreceding, 0)
    keyed = rows.groupBy("sid", "block", "room", "_h", "_id").agg(F.sum("_size").alias("w")).select("*", F.sum("w").over(key).alias("upto"))
    best = keyed.filter(F.col("upto") - F.col("w") < F.col("room")).withColumn("off", F.abs(F.col("upto") - F.col("room"))).filter(F.col("off") <= F.abs(F.col("upto") - F.col("w") - F.col("room")))
    cuts = best.groupBy("sid", "block").agg(F.max(F.struct("_h", "_id")).alias("cut"))
    quotas = np.zeros(min(n_sources, p.most_strata), np.int64)
    for r in order.filter("place = 0").groupBy("stratum").agg(F.sum("quota").alias("quota")).collect():  # most_strata rows at most
        quotas[r["stratum"]] = r["quota"]
    shards = int(max(1, min(quotas.sum(), round(total / p.shard_words))))
    split = split_tree(quotas, shards, np.random.default_rng([p.seed, 1 << 32]))
    dealt = order.groupBy("stratum").applyInPandas(_shards_of(split), "sid long, block int, takes array<struct<shard:int,pass:int>>, cut_shard int")
    assigned = dealt.join(cuts, ["sid", "block"], "left").select("sid", "block", "takes", "cut_shard", F.col("cut._h").alias("cut_h"), F.col("cut._id").alias("cut_id"))
    assigned = stored(assigned, "assigned")
    dropped(spark, sources, order)
    if only_sizes:
        base = here.select(F.struct(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "_row").alias("row"), "_id", "_size", "sid", "source_size", "target", "_h", "block")
    else:
        dropped(spark, sized)
        base = placed(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"))).withColumn("_size", F.lit(None).cast("long"))
    joined = _known(base, assigned, ["sid", "block"], n_blocks, "left", p)
    within = (F.col("_h") < F.col("cut_h")) | (F.col("_h") == F.col("cut_h")) & (F.col("_id").eqNullSafe(F.col("cut_id")) | F.col("_id").isNull() | (F.col("_id") < F.col("cut_id")))
    none = F.array().cast("array<struct<shard:int,pass:int>>")
    extra = F.when(F.col("cut_h").isNotNull() & within, F.array(F.struct(F.col("cut_shard").alias("shard"), F.lit(LAST_PASS).alias("pass")))).otherwise(none)
    return joined.select("row", F.col("_size").alias("size"), "source_size", "target", F.concat(F.coalesce("takes", none), extra).alias("takes"))


#: The pass number of rows taken from a source's last, partly taken block.
LAST_PASS = 1 << 20


def shuffled(taken: DataFrame, key: str, p: MixParameters) -> DataFrame:
    """taken: `t` (shard and pass) and a key column.  Adds position: each shard's rows in an order of its own, one task a shard."""
    order = Window.partitionBy("t.shard").orderBy(F.xxhash64(F.lit(p.seed + 1), F.col(key), F.col("t.pass")), F.col(key), F.col("t.pass"))
    return taken.withColumn("position", F.row_number().over(order))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", p: MixParameters = MixParameters()) -> DataFrame:
    """The mix itself: a row of the input for each time it is taken, with `mix_shard` and `mix_position`, shuffled inside its shard."""
    taken = shuffled(plan(docs, id_col, text_col, source_col, p).select("row", F.explode("takes").alias("t")), f"row.`{id_col}`", p)

    def free(name: str) -> str:
        return free(name + "_") if name in docs.columns else name

    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("t.shard").alias(free("mix_shard")), F.col("position").alias(free("mix_position")))


def query(spark, sf_dir: str) -> DataFrame:
    p = MixParameters()
    rows = plan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), p=p, only_sizes=True)
    rows = stored(rows.select("row.doc_id", "row._row", "size", "source_size", "target", "takes"), "plan")
    places = shuffled(rows.select("doc_id", "_row", F.explode("takes").alias("t")), "doc_id", p)
    of = places.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.col("t.shard").alias("shard"), "position"))).alias("places"))
    none = F.array().cast("array<struct<shard:int,position:int>>")
    out = rows.join(of, "_row", "left").withColumn("places", F.coalesce("places", none))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).cast("long").alias("taken"), "places")


def targets(source_sizes: list[int], p: MixParameters) -> list[float]:
    """Targets of sources in their order, as `level` gives them, for a short list."""
    weight = np.array([float(p.weights[i % len(p.weights)]) for i in range(len(source_sizes))])
    cap, lam = p.most_repeats * np.array(source_sizes, float), 0.0
    while (free := weight * lam <= cap).any() and (new := max(0.0, p.share * sum(source_sizes) - cap[~free].sum()) / weight[free].sum()) > lam * (1 + 1e-12):
        lam = new
    return np.minimum(weight * lam, cap).tolist()

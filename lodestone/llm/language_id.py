"""Language identification by Bayesian fusion of evidence.

A document's posterior over the languages combines
- the likelihood of its text: byte trigrams in hashed buckets, trained on a
  bounded sample of rows that declare a language, tempered as trigrams overlap,
- the language its markup declares, by how reliable each declared value proves
  over the whole corpus,
- a prior of its host, smoothed towards the prior of the address suffix, which
  is smoothed towards that of all rows.
Reliabilities and priors are sums of text posteriors over all rows, made by
grouped aggregation; only counts per (declared value in the language set) reach
the driver, priors stay tables and are joined by host, by broadcast while they are small or the
host is hot.

The `most_languages` most frequent declared languages of `least_rows` rows or
more have a model of their own.  All others share one: where that is the best,
the language is what the row declares, if it declares one of those, so a rare
language or a small table loses no row.  Training texts are distinct: of each
language the `most_rows` of the smallest hashes.

A row is kept when its text holds letters, the best posterior reaches `least`
and a language is told.  Text without letters (or null) is `und`, with the
fused posterior's confidence, and not kept; so is text for which the shared
model is best and that declares no rare language.  A null or unknown
declaration or host is no evidence of its own; null hosts take the global
prior.  If no row declares a language, all rows are `und`.  Equal rows get
equal results.  Columns of any name pass through.  Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import spread_join
from .textwork import chunks, dropped, stored, widened


@dataclass(frozen=True)
class LanguageParameters:
    #: Distinct texts of each declared language that train its model, at most; languages declared by fewer than least_rows rows share one.
    most_rows: int = 2_000
    least_rows: int = 5
    most_languages: int = 200
    buckets_log2: int = 15
    smoothing: float = 0.5
    #: Trigrams overlap: the log likelihood is divided by temper.
    temper: float = 3.0
    host_strength: float = 20.0
    suffix_strength: float = 50.0
    least: float = 0.5
    seed: int = 5


_U = np.uint32
_LOWER = np.arange(256, dtype=_U)
_LOWER[65:91] += 32
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER[~_LETTER] = 32


def trigram_buckets(offsets: np.ndarray, data: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams with a letter in them, and the offsets of each text among them; other bytes count as blanks."""
    low = _LOWER[data]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (low[:-2] << _U(16)) | (low[1:-1] << _U(8)) | low[2:]
    keep = code != _U(0x202020)
    inner = offsets[1:-1]
    for back in (1, 2):  # no trigram of two texts
        at = inner[inner >= back] - back
        keep[at[at < len(keep)]] = False
    upto = np.append(0, np.cumsum(keep))
    return ((code[keep] * _U(2654435761)) >> _U(32 - log2)).astype(np.int64), upto[np.minimum(offsets, len(keep))]


def _train(log2: int, languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(languages)}
        total = np.zeros((len(languages), 1 << log2), np.int64)
        for batch in batches:
            which = np.array([index.get(x, 0) for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, offsets, data in chunks(batch.column(1)):
                buckets, at = trigram_buckets(offsets, data, log2)
                lang = np.repeat(which[lo:hi], np.diff(at))
                total += np.bincount((lang << log2) + buckets, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    return run


def _score(table: np.ndarray, log2: int, p: LanguageParameters):
    """Adds ll: tempered log likelihood of each language (empty without letters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(table)))
            for lo, hi, offsets, data in chunks(batch.column(1)):
                buckets, at = trigram_buckets(offsets, data, log2)
                n[lo:hi] = np.diff(at)
                for i in np.flatnonzero(n[lo:hi] == 0):  # letters, but fewer than three bytes: priors decide
                    n[lo + i] = _LETTER[data[offsets[i] : offsets[i + 1]]].any()
                for k, logs in enumerate(table):
                    total = np.append(0.0, np.cumsum(logs[buckets]))
                    out[lo:hi, k] = total[at[1:]] - total[at[:-1]]
            out /= p.temper
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(table)), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(n)], ["row", "ll", "n"])

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag, lower case; null if blank."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(tag, r"^\s*([A-Za-z]*)", 1))), F.lit(""))


def suffix(host: Column) -> Column:
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


#: Numbers in a table of priors that is broadcast (32 MiB); larger ones are joined by a shuffle.
MOST_PRIORS = 1 << 22
#: The class of all languages without a model of their own.
REST = "?"


def models(own: DataFrame, p: LanguageParameters) -> tuple[list[str], np.ndarray]:
    """Languages with a model (REST last, if any other is declared) and their log probabilities of trigram buckets.  own: text, declared."""
    counts = own.filter("declared is not null").groupBy("declared").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
    counts = counts.withColumn("own", F.col("n") >= p.least_rows)
    largest = counts.filter("own").orderBy(F.desc("n"), "declared").limit(p.most_languages).collect()
    languages = sorted(r["declared"] for r in largest)
    rest = counts.filter(~F.col("declared").isin(languages)).agg(F.sum("texts")).first()[0]
    texts = {r["declared"]: r["texts"] for r in largest} | ({REST: rest} if rest else {})
    if not texts:
        return [], np.zeros((0, 1 << p.buckets_log2))
    languages += [REST] * bool(rest)
    # A coin thins the rows to a little more than the bound, distinct texts of the smallest hashes make it strict.
    chance = F.element_at(F.create_map(*[F.lit(x) for k, n in texts.items() for x in (k, min(1.0, 1.2 * p.most_rows / max(1, n)))]), F.col("class"))
    h = F.xxhash64(F.lit(p.seed), "text")
    thin = own.filter("declared is not null").withColumn("class", _class(languages)).filter(F.pmod(h, F.lit(1 << 20)) / float(1 << 20) < chance)
    few = thin.dropDuplicates(["class", "text"]).withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(h, "text"))).filter(F.col("rank") <= p.most_rows)
    table = np.zeros((len(languages), 1 << p.buckets_log2))
    found = few.select("class", "text").mapInArrow(_train(p.buckets_log2, languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table[found["lang"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return languages, np.log((table + p.smoothing) / (table.sum(axis=1, keepdims=True) + p.smoothing * table.shape[1]))


def _class(languages: list[str]) -> Column:
    return F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared").isNotNull(), F.lit(REST))


def identify(rows: DataFrame, p: LanguageParameters = LanguageParameters(), again: bool = False) -> DataFrame:
    """rows: `row` (anything), `text`, `declared` (language tag) and `host`.  Adds lang, confidence and keep.

    With again, texts are scored a second time where `row` is large, in place of storing it with the likelihoods.
    """
    spark, kind = rows.sparkSession, rows.schema["row"].dataType.simpleString()
    own = widened(rows).select("row", "text", primary(F.col("declared")).alias("declared"), F.lower("host").alias("host"))
    languages, table = models(own, p)
    k = len(languages)
    if not k:
        return rows.select("row", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("keep"))
    inner = own.select(F.struct("row", _class(languages).alias("class"), "declared", "host").alias("row"), "text")

    def score(df: DataFrame) -> DataFrame:
        return df.mapInArrow(_score(table, p.buckets_log2, p), f"row {df.schema['row'].dataType.simpleString()}, ll array<double>, n long").select("row.*", "ll", "n")

    scored = stored(score(inner.withColumn("row", F.col("row").dropFields("row")) if again else inner), "likelihoods")

    # Sums of text posteriors, by declared value, host, suffix and overall; a vector of k doubles each.
    evident = scored.filter("n > 0").withColumn("p", _softmax(F.col("ll")))
    sums = [F.sum(F.element_at("p", i + 1)).alias(f"p{i}") for i in range(k)]
    vector = F.array(*[f"p{i}" for i in range(k)])
    by_declared = {r["class"]: np.array(r["v"]) for r in evident.filter("class is not null").groupBy("class").agg(*sums).select("class", vector.alias("v")).collect()}
    overall = evident.agg(*sums).select(vector.alias("v")).first()["v"]
    overall = np.array([x or 0.0 for x in overall]) + 1.0
    overall /= overall.sum()
    # P(declared | language): column-normalised, smoothed.
    values = sorted(by_declared)
    joint = np.array([by_declared[v] for v in values]) + 0.5 if values else np.zeros((0, k))
    reliable = np.log(joint / joint.sum(axis=0)) if values else joint
    reliability = F.create_map(*[x for v, row in zip(values, reliable, strict=True) for x in (F.lit(v), F.array(*[F.lit(float(y)) for y in row]))]) if values else None

    blend = lambda own, up, strength: F.transform(F.arrays_zip(own.alias("a"), up.alias("b")), lambda z: z["a"] + strength * z["b"])
    norm = lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y))
    top = F.array(*[F.lit(float(x)) for x in overall])
    hosts = evident.filter("host is not null").groupBy("host").agg(*sums, F.count(F.lit(1)).alias("evident")).select("host", suffix(F.col("host")).alias("suffix"), vector.alias("v"), *[f"p{i}" for i in range(k)])
    hosts = stored(hosts, "hosts")
    suffixes = hosts.filter("suffix is not null").groupBy("suffix").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(k)], F.count(F.lit(1)).alias("held")).select("suffix", norm(blend(vector, top, p.suffix_strength)).alias("up"), "held")
    known = spread_join(hosts.select("host", "suffix", "v"), suffixes, "suffix", "held", hosts.count(), "left").select("host", norm(blend(F.col("v"), F.coalesce("up", top), p.host_strength)).alias("prior"))
    held = scored.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("held"))
    priors = stored(held.join(known, "host"), "priors")
    total = scored.count()
    dropped(spark, hosts)
    if again:
        dropped(spark, scored)
        scored = score(inner)
    if priors.count() * k <= MOST_PRIORS:
        joined = scored.join(F.broadcast(priors), "host", "left")
    else:
        free = scored.filter("host is null").withColumn("prior", F.lit(None).cast("array<double>")).withColumn("held", F.lit(0).cast("long"))
        joined = spread_join(scored.filter("host is not null"), priors, "host", "held", total, "left").unionByName(free)
    joined = joined.withColumn("prior", F.coalesce("prior", top))
    none = F.array(*[F.lit(0.0)] * k)
    declared = F.coalesce(F.element_at(reliability, F.col("class")), none) if reliability is not None else none
    fused = F.transform(F.arrays_zip(F.col("ll").alias("a"), declared.alias("b"), F.transform("prior", lambda x: F.log(x)).alias("c")), lambda z: z["a"] + z["b"] + z["c"])
    post = joined.withColumn("post", _softmax(fused)).withColumn("best", F.array_max("post"))
    lang = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("post", F.col("best")).cast("int"))
    lang = F.when(lang != REST, lang).when(F.col("class") == REST, F.col("declared"))
    lang = F.when(F.col("n") > 0, F.coalesce(lang, F.lit("und"))).otherwise(F.lit("und"))
    return post.select("row", lang.alias("lang"), F.round("best", 6).alias("confidence"), ((lang != "und") & (F.col("best") >= p.least)).alias("keep"))


def document_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", row: Column | None = None) -> DataFrame:
    """Documents as evidence: their lang column is what they declare, their source is their host."""
    return docs.select((row if row is not None else F.struct("*")).alias("row"), F.col(text_col).alias("text"), F.col(lang_col).alias("declared"), F.col(source_col).alias("host"))


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as evidence: visible text, the html element's lang attribute, the URL's host."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*+>", " ")
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return pages.select(F.struct(F.col(id_col)).alias("row"), text.alias("text"), declared.alias("declared"), F.try_parse_url(F.col(url_col), F.lit("HOST")).alias("host"))


def keep_identified(docs: DataFrame, p: LanguageParameters = LanguageParameters()) -> DataFrame:
    """Documents whose language was identified, with the input's columns."""
    found = identify(document_rows(docs), p, again=True)
    return found.filter("keep").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(document_rows(docs, row=F.struct("doc_id"))).select("row.doc_id", F.col("lang").alias("language"), "confidence", "keep")


def pages_query(spark, sf_dir: str) -> DataFrame:
    return identify(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))).select("row.page_id", F.col("lang").alias("language"), "confidence", "keep")

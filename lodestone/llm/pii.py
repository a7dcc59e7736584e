"""Personal data: base patterns, and spans added by weakly supervised labelers.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of
their patterns that pass their checks.  Looser candidates (bracketed e-mail
addresses, national phone numbers, card-shaped numbers, social security
numbers, secrets) and the base spans are voted on by labelers: the pattern's
validator, lists of known values, the words before, the shape of the value and what
stands around it.  Expectation maximisation over the counts of vote patterns of
the whole corpus estimates each labeler's reliability, and the posteriors train
the final span classifier, a logistic model of kind, votes and length.  Its
candidates that overlap no base span are added; base spans always stay.

All of it is DataFrame expressions: positions come from splitting at the
pattern and adding up lengths.  Vote patterns are a table of a fixed number of
rows at most (kinds x votes x lengths), the only thing the driver sees.

The patterns use possessive quantifiers where nothing could be given back, so
matching neither recurses nor turns quadratic on long runs; matches are the
same.  Null texts count as empty.  Positions are code points from 0, ends
exclusive.  Equal rows get equal results.  Empty input gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textwork import stored

KINDS = ("email", "ip", "card", "phone", "ssn", "secret")
LABELERS = ("validator", "known", "context", "shape", "edges")

#: A mail address can only start where its first part does, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BRACKETED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?[\[(](?:at|AT|@)[\])]\s?[A-Za-z0-9-]++(?:\s?(?:\.|[\[(](?:dot|DOT|\.)[\])])\s?[A-Za-z0-9-]{2,}+)++"
NATIONAL = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
SECRET = r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b ?[=:] ?\"?[A-Za-z0-9+/_-]{12,}+"
#: Keys that are told by their own form: access keys and tokens with a provider's prefix, signed web tokens.
KEYED = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])"

#: Words that speak for a kind when they stand shortly before it.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta|account|iban)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|telefon|appelez|llame)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
    "secret": r"(?i)\b(?:login|config|export|bearer|auth)\b",
}
#: Values a kind is known by: top-level domains, network and issuer prefixes, area codes.
KNOWN = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9][0-9]|2[0-2][0-9])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)",
    "phone": r"^\+?(?:1|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "secret": r"[0-9a-f]{16,}|AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|eyJ",
}


@dataclass(frozen=True)
class PiiParameters:
    before: int = 24
    least: float = 0.9
    rounds: int = 50


def matches(text: Column, pattern: str, where: Column) -> Column:
    """s, e and m (value) of all matches, of rows for which `where` holds."""
    kind = "array<struct<s:int,e:int,m:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    return F.when(where, F.aggregate(parts, start, step, lambda a: a["out"])).otherwise(F.array().cast(kind))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: kind, pattern, rows worth searching, check of a match (of value and digits), base kind or not.
PATTERNS = (
    ("email", EMAIL, "@", lambda m, d: F.lit(True), True),
    ("ip", IP, r"[0-9]\.[0-9]", lambda m, d: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), True),
    ("card", CARD, r"[0-9][0-9 -]{11,}[0-9]", lambda m, d: F.length(d).between(14, 19) & F.call_function("luhn_check", d), True),
    ("phone", PHONE, r"\+[0-9]", lambda m, d: F.length(d).between(10, 15), True),
    ("email", BRACKETED, r"[\[(](?:at|AT|@)[\])]", lambda m, d: F.lit(True), False),
    ("phone", NATIONAL, r"[0-9]{3}[ .-][0-9]{4}", lambda m, d: F.lit(True), False),
    ("ssn", SSN, r"[0-9]-[0-9]{2}-[0-9]", lambda m, d: F.lit(True), False),
    ("secret", SECRET, r"(?i)(?:token|secret|password|passwd|api[_-]?key)\b ?[=:]", lambda m, d: m.rlike("[0-9]"), False),
    ("secret", KEYED, "AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|eyJ", lambda m, d: F.lit(True), False),
)


def _by_kind(x: Column, values: dict) -> Column:
    return F.element_at(F.array(*[values[k] if isinstance(values[k], Column) else F.lit(values[k]) for k in KINDS]), x["kind"] + 1)


def _votes(text: Column, x: Column, p: PiiParameters) -> Column:
    """Votes 0 (against), 1 (silent), 2 (for) of the labelers as a base-3 number, times 4 the value's length class."""
    m, d = x["m"], x["d"]
    n, size = F.length(d), F.length(m)
    known = F.rlike(F.when(x["kind"] == KINDS.index("card"), d).otherwise(m), _by_kind(x, KNOWN))
    before = F.substring(text, F.greatest(x["s"] - p.before + 1, F.lit(1)), F.least(x["s"], F.lit(p.before)))
    cue = F.rlike(before, _by_kind(x, CUES))
    dull = (n > 0) & (F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) <= n * 0.3) | d.rlike("0123456789|123456789|987654321")
    least, most = _by_kind(x, {"email": 6, "ip": 6, "card": 15, "phone": 10, "ssn": 9, "secret": 12}), _by_kind(x, {"email": 80, "ip": 15, "card": 16, "phone": 13, "ssn": 9, "secret": 4096})
    shaped = F.when(x["kind"].isin([KINDS.index("email"), KINDS.index("ip"), KINDS.index("secret")]), size).otherwise(n).between(least, most) & ~dull
    around = F.concat(F.when(x["s"] > 0, F.substring(text, x["s"], 1)).otherwise(""), F.substring(text, x["e"] + 1, 1))
    vote = lambda yes: F.when(yes, 2).otherwise(0)
    code = F.lit(0)
    for v in (vote(x["ok"]), vote(known), F.when(cue, 2).otherwise(1), vote(shaped), vote(~around.rlike("[A-Za-z0-9]"))):
        code = code * 3 + v
    return (code * 4 + F.when(size < 10, 0).when(size < 16, 1).when(size < 24, 2).otherwise(3)).cast("int")


def find(rows: DataFrame, p: PiiParameters = PiiParameters()) -> DataFrame:
    """rows: `row` (anything) and `text`.  row, base and more: spans with s, kind (index in KINDS), e, code of votes; more holds candidates clear of base spans."""
    t = F.col("text")
    own = rows.select("row", F.coalesce("text", F.lit("")).alias("text"))
    raw = own.select("*", *[matches(t, pattern, t.rlike(where)).alias(f"f{i}") for i, (_, pattern, where, _, _) in enumerate(PATTERNS)])

    def checked(i: int) -> Column:
        kind, _, _, check, base = PATTERNS[i]
        with_digits = F.transform(f"f{i}", lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("kind"), x["e"].alias("e"), x["m"].alias("m"), _digits(x["m"]).alias("d")))
        return F.transform(with_digits, lambda x: F.struct(*[x[c].alias(c) for c in ("s", "kind", "e", "m", "d")], check(x["m"], x["d"]).alias("ok"), F.lit(base).alias("base")))

    every = raw.select("row", "text", F.concat(*[checked(i) for i in range(len(PATTERNS))]).alias("found"))
    # Card-shaped numbers that fail their check are candidates; other failed base matches are dropped.
    every = every.withColumn("found", F.filter("found", lambda x: x["ok"] | ~x["base"] | (x["kind"] == KINDS.index("card")) & F.length(x["d"]).between(13, 19)))
    coded = every.select("row", F.array_sort(F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), (x["ok"] & x["base"]).alias("base"), _votes(t, x, p).alias("code")))).alias("found"))
    parted = coded.select("row", F.filter("found", lambda x: x["base"]).alias("base"), F.filter("found", lambda x: ~x["base"]).alias("more"))
    return parted.select("row", "base", F.filter("more", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))).alias("more"))


def em(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
    """Posterior of each vote pattern: two classes, a prior for each kind, a reliability for each labeler and class."""
    prior, yes, no = np.full(len(KINDS), 0.7), np.tile([0.1, 0.2, 0.7], (votes.shape[1], 1)), np.tile([0.6, 0.3, 0.1], (votes.shape[1], 1))
    each = np.arange(votes.shape[1])
    for _ in range(rounds):
        a = np.log(prior[kind]) + np.log(yes[each, votes]).sum(axis=1)
        b = np.log1p(-prior[kind]) + np.log(no[each, votes]).sum(axis=1)
        q = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        for k in range(len(KINDS)):
            on = kind == k
            prior[k] = np.clip((n[on] @ q[on] + 2) / (n[on].sum() + 3), 0.01, 0.99)
        for v in range(3):
            hit = (votes == v) * n[:, None]
            yes[:, v], no[:, v] = q @ hit + 1, (1 - q) @ hit + 1
        yes /= yes.sum(axis=1, keepdims=True)
        no /= no.sum(axis=1, keepdims=True)
    return q


def _features(kind: np.ndarray, votes: np.ndarray, size: np.ndarray) -> np.ndarray:
    eye = np.eye(len(KINDS))[kind], np.eye(4)[size], np.eye(3)[votes].reshape(len(kind), -1)
    return np.concatenate(eye, axis=1)


def train(counts: list[tuple[int, int, int]], p: PiiParameters) -> np.ndarray:
    """counts: kind, code, rows of each vote pattern.  Weights of the span classifier's features."""
    n_votes = len(LABELERS)
    weights = np.zeros(len(KINDS) + 4 + 3 * n_votes)
    if not counts:
        return weights
    kind, code, n = (np.array(x, np.int64) for x in zip(*counts, strict=True))
    size, code = code % 4, code // 4
    votes = np.stack([code // 3 ** (n_votes - 1 - j) % 3 for j in range(n_votes)], axis=1)
    q = em(kind, votes, n.astype(float), p.rounds)
    x, w = _features(kind, votes, size), np.log1p(n) / np.log1p(n).sum()
    for _ in range(2000):
        guess = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        weights += 4.0 * (x.T @ (w * (q - guess)) - 1e-4 * weights)
    return weights


def score(x: Column, weights: np.ndarray) -> Column:
    """The classifier's log odds of a span."""
    lits = lambda a: F.array(*[F.lit(float(v)) for v in a])
    k = len(KINDS)
    out = F.element_at(lits(weights[:k]), x["kind"] + 1) + F.element_at(lits(weights[k : k + 4]), x["code"] % 4 + 1)
    for j in range(len(LABELERS)):
        at = k + 4 + 3 * j
        out = out + F.element_at(lits(weights[at : at + 3]), F.floor(x["code"] / (4 * 3 ** (len(LABELERS) - 1 - j))).cast("int") % 3 + 1)
    return out


def detect(rows: DataFrame, p: PiiParameters = PiiParameters()) -> DataFrame:
    """rows: `row` (anything) and `text`.  row, base and spans: arrays of s, kind, e, code by start, then kind."""
    found = stored(find(rows, p), "spans")
    pairs = found.select(F.explode(F.concat("base", "more")).alias("x")).groupBy(F.col("x.kind").alias("kind"), F.col("x.code").alias("code")).count().collect()
    weights = train(sorted((r["kind"], r["code"], r["count"]) for r in pairs), p)
    least = float(np.log(p.least / (1 - p.least)))
    added = F.filter("more", lambda x: score(x, weights) >= least)
    return found.select("row", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", p: PiiParameters = PiiParameters()) -> DataFrame:
    """The input with each span replaced by its kind in angle brackets; spans that overlap an earlier one go with it."""
    names = docs.columns
    found = detect(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), p)
    t = F.col(f"row.`{text_col}`")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    label = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def step(a: Column, x: Column) -> Column:
        cut = F.concat(a["out"], F.substring(t, a["at"] + 1, x["s"] - a["at"]), F.element_at(label, x["kind"] + 1))
        return F.when(x["s"] < a["at"], F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), cut.alias("out")))

    text = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return found.select(*[(F.when(t.isNotNull(), text) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names])


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = detect(docs.select(F.struct("doc_id").alias("row"), "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("row.doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))

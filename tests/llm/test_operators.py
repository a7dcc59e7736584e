"""Every operator against brute force, and on nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, entry, exact_dedup, language_id, line_dedup, mixing, near_dedup, pii, quality, spread, suffix_dedup, warc

FOLDER = "/root/testdata/sf0.001"
#: Ids, texts, languages and sources with every awkward case, and columns whose names operators use themselves.
EDGE = [
    (1, "Same text here\nb\nc\nd", "en", "a", 1, "x"), (2, "Same text here\nb\nc\nd", "en", "a", 1, "x"), (2, "Same text here\nb\nc\nd", "en", "a", 1, "x"),
    (3, None, None, None, None, None), (None, "", "en", "a", 1, "x"), (None, None, "?", None, 1, "x"), (4, "  ", "en", "b", 1, "x"), (5, "été 🙂 " * 3000, "fr", "b", 1, "x"), (6, "a" * 3000, "en", "b", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, kept int, row string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracles(spark, oracle, name):
    oracle(entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name], FOLDER)


# --- 1 ---


def test_mix(spark, edge, empty):
    docs = docs_of(spark)
    got = {r["doc_id"]: r for r in mixing.query(spark, FOLDER).collect()}
    again = {r["doc_id"]: r["taken"] for r in mixing.query(spark, FOLDER).collect()}
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in docs.items()}
    assert {k: r["size"] for k, r in got.items()} == words and {k: r["taken"] for k, r in got.items()} == again
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    taken, size, largest = Counter(), Counter(), Counter()
    for k, r in got.items():
        assert r["taken"] <= 2 * r["size"]
        taken[source[k]] += r["taken"]
        size[source[k]] += r["size"]
        largest[source[k]] = max(largest[source[k]], r["size"])
    for k, r in got.items():
        assert abs(taken[source[k]] - r["target"]) <= largest[source[k]] and r["source_size"] == size[source[k]]
    assert sum({source[k]: r["target"] for k, r in got.items()}.values()) == pytest.approx(1.5 * sum(words.values()))
    mixed = mixing.mix(edge)
    assert mixed.columns[:6] == edge.columns and mixing.mix(empty).count() == 0 and mixed.count() > 0
    positions = mixed.groupBy("mix_shard").agg(F.count("*").alias("n"), F.max("mix_position").alias("m"), F.countDistinct("mix_position").alias("d")).collect()
    assert all(r["n"] == r["m"] == r["d"] for r in positions)


def test_targets_and_tree(spark):
    p = mixing.MixParameters()
    assert mixing.targets([10, 1000, 10], p) == [20.0, 1490.0, 20.0]
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        sizes = (rng.integers(0, 50, n) ** 3).tolist()
        table = spark.createDataFrame([(s, float(p.weights[i % 3])) for i, s in enumerate(sizes)], "size long, weight double")
        lam = mixing.level(table, p)
        want = mixing.targets(sizes, p)
        assert [min(lam * p.weights[i % 3], 2.0 * s) for i, s in enumerate(sizes)] == pytest.approx(want)
        assert sum(want) == pytest.approx(1.5 * sum(sizes))
    quotas = np.array([5, 0, 100, 17])
    split = mixing.split_tree(quotas, 7, np.random.default_rng(1))
    assert split.groupby("stratum")["n"].sum().to_dict() == {0: 5, 2: 100, 3: 17} and np.ptp(split.groupby("shard")["n"].sum()) <= 3


def test_mix_of_many_sources(spark):
    """More sources than strata and blocks: quotas stay exact, and rows are joined by a shuffle."""
    rows = [(i, "w " * (1 + i % 5), f"s{i % 60}", "x", 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_shard string, sid int")
    p = mixing.MixParameters(most_blocks=8, most_strata=4, shard_words=300)
    mixed = mixing.mix(docs, p=p)
    assert mixed.columns == [*docs.columns, "mix_shard_", "mix_position"]
    got = mixed.collect()
    size = Counter()
    for _, t, s, _, _ in rows:
        size[s] += len(t.split())
    names = sorted(size)
    target = dict(zip(names, mixing.targets([size[n] for n in names], p), strict=True))
    taken = Counter()
    for r in got:
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[n] - target[n]) <= 5 for n in names)
    by_shard = Counter(r["mix_shard_"] for r in got)
    assert len(by_shard) > 3 and all(sorted(r["mix_position"] for r in got if r["mix_shard_"] == k) == list(range(1, n + 1)) for k, n in by_shard.items())


# --- 2 ---


def test_fm_index():
    rng = random.Random(4)
    for _ in range(20):
        runs = [[rng.randint(1, 4) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 5))]
        symbols = np.array([x for r in runs for x in (*r, 0)], np.int32)
        index = decontaminate.FMIndex(symbols, 4)
        for _ in range(10):
            k = rng.randint(1, 4)
            phrase = [rng.randint(1, 4) for _ in range(k)]
            lo, hi = index.search(np.array([phrase + [0] * (4 - k)]), np.array([k]))
            want = [i for i in range(len(symbols) - k + 1) if symbols[i : i + k].tolist() == phrase]
            assert sorted(index.locate(np.arange(lo[0], max(lo[0], hi[0]))).tolist()) == want


def test_decontaminate_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "SAME text"), (None, "x"), (2, None), (3, "...")], "item_id long, text string")
    rows = lambda d: decontaminate.find(d.select(F.struct("doc_id").alias("row"), "text"), bench)
    got = sorted((r["row"][0] or -1, r["n_words"], r["items"]) for r in rows(edge).collect())
    assert [x for x in got if x[2]] == [(1, 6, ["1"]), (2, 6, ["1"]), (2, 6, ["1"])] and rows(empty).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(edge, none).count() == len(EDGE)
    cleaned = decontaminate.clean(edge, bench)
    assert cleaned.columns == edge.columns and {r["text"] for r in cleaned.filter("doc_id = 1").collect()} == {" here\nb\nc\nd"}
    small = decontaminate.find(edge.select(F.struct("doc_id").alias("row"), "text"), bench, block_bytes=8)
    assert sorted((r["row"][0] or -1, r["n_words"], r["items"]) for r in small.collect()) == got


def test_decontaminate_null_and_repeated_items(spark, oracle, tmp_path):
    """Items of no id hit and are cut as others, and an id counts once a document, in one block as in many."""
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six; seven"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "two three"), (7, "one two"), (7, "four"), (None, "six"), (8, "four")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    oracle(decontaminate.query(spark, str(tmp_path)), decontaminate.SQL, str(tmp_path))
    for block_bytes in (8, 1 << 20):
        found = decontaminate.find(docs.select(F.struct("doc_id").alias("row"), "text"), bench, block_bytes=block_bytes)
        assert {r["row"][0]: r["items"] for r in found.collect()} == {1: ["7", "8", None], 2: [None], 3: []}
    assert {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, bench).collect()} == {1: " five", 2: "; seven", 3: "none"}


# --- 3, 4 ---


def test_language_accuracy(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.withColumn("declared", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    rows = hidden.select(F.struct("doc_id", "lang").alias("row"), "text", "declared", F.lit(None).cast("string").alias("host"))
    held = [r for r in language_id.identify(rows).collect() if r["row"]["doc_id"] % 2]
    assert np.mean([r["lang"] == r["row"]["lang"] for r in held]) > 0.97
    assert language_id.keep_identified(empty).count() == 0
    out = language_id.identify(language_id.document_rows(edge), language_id.LanguageParameters(least_rows=1))
    kept = {r["row"]["text"]: r["keep"] for r in out.collect()}
    assert kept[None] is False and kept["  "] is False and kept["Same text here\nb\nc\nd"] and out.count() == len(EDGE)


def test_quality(spark, edge, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.select(docs, labels, p=quality.QualityParameters(fraction=0.5))
    assert got.filter("selected").count() == 500
    top = sorted(((r["key"], -r["id"]) for r in got.collect()), reverse=True)[:500]
    assert {-i for _, i in top} == {r["id"] for r in got.filter("selected").collect()}
    score = {r["id"]: r["log_weight"] for r in got.collect()}
    good = [score[r["doc_id"]] for r in labels.filter("quality = 1 and toxic = 0").collect()]
    bad = [score[r["doc_id"]] for r in labels.filter("quality = 0 or toxic = 1").collect()]
    assert np.median(good) > np.median(bad)
    assert quality.select(empty, labels).count() == 0 and quality.select(edge, labels.limit(0)).count() == len(EDGE)


# --- 5 ---


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ü\r\n", "<p>é"), (2, None, "<p>é"), (3, "http://b", None), (4, "http://b", ""), (None, "x", "<p>é"), (5, "http://c", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, index = warc.write_archives(pages)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"]) if r["payload"] is not None else None) for r in warc.read_records(folder, index).collect()}
    assert got == {1: ("response", None, 5, "<p>é".encode()), 2: ("revisit", 1, 5, None), None: ("revisit", 1, 5, None), 3: ("response", None, 0, b""), 4: ("revisit", 3, 0, None), 5: ("response", None, 200_000, b"z" * 200_000)}
    one = warc.read_records(folder, index.filter("page_id = 5"))
    assert [r["page_id"] for r in one.collect()] == [5]
    assert list(warc.ranges([(0, 5), (5, 5), (100, 5)], gap=10)) == [(0, 10, [(0, 5), (5, 5)]), (100, 105, [(100, 5)])]
    folder, index = warc.write_archives(pages.limit(0))
    assert warc.read_records(folder, index).count() == 0


# --- 6 ---


def _variant(words, rng, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"w{rng.randint(0, 10**9)}"
    return " ".join(out)


def test_near_dedup(spark, edge, empty):
    rng = random.Random(9)
    rows, want = [], {}
    for group in range(12):
        size = (12, 40, 90, 300)[group % 4]
        base = [f"v{rng.randint(0, 10**6)}" for _ in range(size)]
        for k in range(6):
            i = group * 10 + k
            rows.append((i, " ".join(base) if k < 2 else _variant(base, rng, size // 90)))
            want[i] = group * 10 if k < 2 or size >= 90 or size // 90 == 0 else i
    for i in range(500, 540):
        rows.append((i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(80))))
        want[i] = i
    got = {r["id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert near_dedup.classes(empty).count() == 0
    out = near_dedup.classes(edge)
    assert out.count() == len(EDGE) and {r["class_id"] for r in out.filter("id in (1, 2)").collect()} == {1}
    kept = near_dedup.deduplicate(edge)
    assert kept.columns == edge.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6"]


def test_weighted_sampling_agrees_with_similarity():
    p, rng = near_dedup.NearParameters(), np.random.default_rng(3)
    for shared, own, spread in ((800, 100, 0), (8, 1, 0), (800, 100, 30)):
        same, want = [], []
        for _ in range(40):
            sid, weight = np.unique(rng.integers(0, 1 << 32, shared + 2 * own, np.uint64)).astype(np.uint32), None
            weight = (1 + spread * rng.random(len(sid))).astype(np.float32)
            part = rng.permutation(len(sid))
            sides = [np.sort(part[: shared + own]), np.sort(np.append(part[:shared], part[shared + own :]))]
            bands = [near_dedup.signatures(np.zeros(len(x), np.int64), sid[x], weight[x], p)[1] for x in sides]
            same.append((bands[0] == bands[1]).mean())
            want.append((weight[part[:shared]].sum() / weight.sum()) ** (p.samples // p.bands))
        assert abs(np.mean(same) - np.mean(want)) < 0.06


# --- 7 ---


def _brute_repeats(docs, length):
    seen = Counter(b[i : i + length] for b in docs.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in docs.items():
        spans = []
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        at = [0, *(x for s in spans for x in s), len(b)]
        left = b"".join(b[at[j] : at[j + 1]] for j in range(0, len(at), 2))
        out[k] = (len(b), len(b) - len(left), len(spans), hashlib.sha256(left).hexdigest())
    return out


def test_suffix_dedup(spark, edge, empty):
    docs = {k: t.encode() for k, t in docs_of(spark).items()}
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.query(spark, FOLDER).collect()}
    shared = _brute_repeats(docs, 288)
    assert got == {k: (*v, shared[k][1]) for k, v in _brute_repeats(docs, 400).items()}
    out = suffix_dedup.remove_repeats(edge.select(F.struct("doc_id").alias("row"), "text"))
    assert {r["n_removed"] for r in out.filter("row.doc_id = 6").collect()} == {3000} and out.count() == len(EDGE)
    assert suffix_dedup.remove_repeats(empty.select(F.struct("doc_id").alias("row"), "text")).count() == 0


@pytest.mark.parametrize("key_bytes", [0, 3000, 1 << 20])
def test_keys_of_many_pieces(spark, key_bytes):
    """A passage in many differing texts, of which some agree beyond it: the same result by sorting and by aggregation."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, tails = word(70), [word(60) for _ in range(6)]
    texts = [word(rng.randint(0, 80)) + passage + rng.choice(tails) + word(rng.randint(0, 40)) for _ in range(60)] + ["ab" * 200, "", word(30)]
    p = suffix_dedup.SuffixParameters(length=100, least=64, gram=16, key_bytes=key_bytes)
    docs = {i: t.encode() for i, t in enumerate(texts)}
    out = suffix_dedup.remove_repeats(spark.createDataFrame([((i,), t) for i, t in enumerate(texts)], "row struct<doc_id:long>, text string"), p)
    got = {r["row"]["doc_id"]: tuple(r)[1:6] for r in out.collect()}
    shared = _brute_repeats(docs, 64)
    assert got == {k: (*v, shared[k][1]) for k, v in _brute_repeats(docs, 100).items()}


@pytest.mark.parametrize("most", [0, 3, 6_700_000])
def test_only_repeated_keys_are_sorted(spark, monkeypatch, most):
    """Beyond the keys that a filter takes, pieces of keys that occur once are left out all the same."""
    rng, rows = random.Random(7), {}
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [word(150) for _ in range(20)]
    texts = [word(1500) for _ in range(60)] + [word(100) + p + word(100) for p in passages for _ in range(2)]
    store = suffix_dedup.stored

    def counted(df, what):
        out = store(df, what)
        rows[what] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "stored", counted)
    monkeypatch.setattr(spread, "MOST_KEYS", most)
    p = suffix_dedup.SuffixParameters(length=100, least=64, gram=16)
    out = suffix_dedup.remove_repeats(spark.createDataFrame([((i,), t) for i, t in enumerate(texts)], "row struct<doc_id:long>, text string"), p)
    got = {r["row"]["doc_id"]: tuple(r)[1:6] for r in out.collect()}
    docs = {i: t.encode() for i, t in enumerate(texts)}
    shared = _brute_repeats(docs, 64)
    assert got == {k: (*v, shared[k][1]) for k, v in _brute_repeats(docs, 100).items()}
    assert rows["keys"] > 3 and rows["suspects"] < 0.2 * rows["pieces"]


def test_induced_sorting():
    rng = random.Random(3)
    for _ in range(150):
        t = np.array([rng.randint(1, rng.choice([2, 3, 8])) for _ in range(rng.randint(1, 60))] + [0], np.int16)
        assert suffix_dedup.suffix_order(t, 1000, 1 << rng.choice([4, 20])).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


# --- 8 ---


def test_exact_dedup_edges(spark, edge, empty):
    got = sorted((str(r["row"]["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.mark(edge).collect())
    assert got == sorted([("1", "2", 3, False), ("2", "2", 3, True), ("2", "2", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "3", 3, False), ("4", "4", 1, True), ("5", "5", 1, True), ("6", "6", 1, True)])
    assert exact_dedup.deduplicate(edge).columns == edge.columns and exact_dedup.mark(empty).count() == 0


def test_rice_code():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        values = np.sort(rng.integers(0, 1 << 48, n, np.uint64))
        k, unary, rest = exact_dedup.rice_encode(values)
        assert exact_dedup.rice_decode(n, k, unary, rest).tolist() == values.tolist()
    assert len(unary) + len(rest) < 1000 * 48 / 8


# --- 9 ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def _brute_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii_base(spark, empty):
    rng = random.Random(1)
    texts = ["5" * 2000, "1 2-" * 600, "a@" + "b." * 500 + "c +1 " + "(" * 1000, "a" * 3000, "x@y.z+d@e.f 1.2.3.4.5 001.02.0003.255 1.2.3.256 +1 (234) 567-8901-", "", "4539 1488 0343 6467"]
    texts += ["".join(rng.choice("0123 -.+()@ab🙂é%_") for _ in range(200)) for _ in range(500)]
    df = spark.createDataFrame([*enumerate(texts), (10**6, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["b"] for r in pii.detect(df.select(F.struct("doc_id").alias("row"), "text")).select("row.doc_id", pii._joined("base").alias("b")).collect()}
    assert got == {i: _brute_pii(t) for i, t in enumerate(texts)} | {10**6: ""}
    assert pii.detect(empty.select(F.struct("doc_id").alias("row"), "text")).count() == 0


def test_pii_adds_and_redacts(spark):
    rows = [(i, f"mail me{i}@site{i}.org or call +1 555 010 {1000 + i} now", "c") for i in range(40)] + [(i, f'token = "0123abcd4567ef890123abcd4567ef{i}"', "c") for i in range(60, 100)] + [ (100, "plain words only", "c"), (101, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[0] == "mail <email> or call <phone> now" and out[100] == "plain words only" and out[101] is None and out[99] in ('<secret>"', rows[79][1])


# --- 10 ---


def test_line_dedup_edges(spark, edge, empty):
    got = {(str(r["row_in"]["doc_id"]), r["kept_text"]) for r in line_dedup.remove_lines(edge).filter("row_in.doc_id in (1, 2)").collect()}
    assert got == {("1", "Same text here\nb\nc\nd"), ("2", "")}
    assert line_dedup.remove_lines(edge).count() == len(EDGE) and line_dedup.remove_lines(empty).count() == 0


def test_line_dedup_of_equal_ids(spark):
    """Two texts of one id: a window that both hold stays in one of them."""
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (1, "a\nb\nc\ne")], "doc_id long, text string")
    kept = sorted(r["kept_text"] for r in line_dedup.remove_lines(docs).collect())
    assert kept in (["a\nb\nc\nd", "e"], ["a\nb\nc\ne", "d"])

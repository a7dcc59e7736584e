"""Near duplicates against all pairs, on large groups, repeated lines and texts beyond every chunk."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import near_dedup, textwork


def _vector(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _links(texts, p=near_dedup.NearParameters()):
    """All pairs of distinct texts that are similar, by brute force, and those within a rounding error of it."""
    vectors = [_vector(t) for t in texts]
    df = Counter(k for v in vectors for k in v)
    n = len(texts)
    share = max(p.rare, sum(map(len, vectors)) / n / p.most_heavy)
    weight = {k: 1 + p.idf * (1 if c <= share * n else np.log(n / c) / np.log(1 / share)) for k, c in df.items()}
    holders, total, out = {}, [], []
    for i, v in enumerate(vectors):
        total.append(sum(c * weight[k] for k, c in v.items()))
        shared = Counter()
        for k, c in v.items():
            for j, d in holders.get(k, ()):
                shared[j] += min(c, d) * weight[k]
            holders.setdefault(k, []).append((i, c))
        out += [(j, i, s / (total[i] + total[j] - s)) for j, s in shared.items() if s / (total[i] + total[j] - s) >= p.similarity - 1e-4]
    return out


def _classes(ids, texts, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    first = {}
    for i, t in zip(ids, texts, strict=True):
        a, b = root(i), root(first.setdefault(t, i))
        up[max(a, b)] = min(a, b)
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_all_pairs(spark, folder):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    links = [(rows[a][0], rows[b][0], s) for a, b, s in _links([t for _, t in rows])]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.query(spark, folder).collect()}
    clear = [(a, b) for a, b, s in links if s >= 0.8 + 1e-4]
    assert np.mean([got[a] == got[b] for a, b in clear]) >= 0.999
    exact = _classes(*zip(*rows, strict=True), [(a, b) for a, b, _ in links])
    assert np.mean([got[i] == exact[i] for i in got]) >= 0.999


def _variant(words, rng, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"w{rng.randint(0, 10**9)}"
    return out


def test_large_group(spark):
    """Variants of one text of which many are not similar to the original, but some of those to each other."""
    rng = random.Random(2)
    base = [f"v{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = [base] + [_variant(base, rng, rng.randint(1, 9)) for _ in range(300)]
    for _ in range(30):  # a variant of a variant: similar to its own parent only
        texts.append(_variant(_variant(base, rng, 6), rng, 1))
        texts.append(_variant(texts[-1], rng, 1))
    texts = [" ".join(t) for t in texts]
    got = {r["id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    links = _links(texts)
    exact = _classes(range(len(texts)), texts, [(a, b) for a, b, _ in links])
    assert sum(got[i] != exact[i] for i in got) <= 2 and len(set(exact.values())) > 20


def test_lengths_and_repeats(spark, tmp_path):
    """One scheme for all lengths: 55 against 95 shingles with weight in repeats, and texts longer than a chunk."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"u{rng.randint(0, 10**7)}" for _ in range(n))
    rows, n = [], 0
    for _ in range(20):
        line = words(5) + " "
        rows += [(n, line * 400 + words(50)), (n + 1, line * 400 + words(90))]
        n += 2
    long = words(120_000)
    assert len(long) > textwork.CHUNK_BYTES
    rows += [(n, long), (n + 1, long + " tail of its own"), (n + 2, words(120_000))]
    got = {r["id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 if i < n else min(i, n) if i < n + 2 else i for i in range(n + 3)}


def test_weights_do_not_depend_on_size(spark):
    """The same table twice weighs its shingles alike."""
    rows = [(i, f"one common start of every text {i} {i} b c d e f g") for i in range(300)]
    p = near_dedup.NearParameters()
    out = []
    for times in (1, 3):
        docs = spark.createDataFrame(rows * times, "doc_id long, text string")
        vectors = docs.select("doc_id", near_dedup._node("text").alias("node"), "text").mapInArrow(near_dedup._vectors(5), "id long, node binary, vector binary")
        out.append(near_dedup.weights_of(vectors, p))
    assert len(out[0].heavy) and out[0].heavy.tolist() == out[1].heavy.tolist() and np.allclose(out[0].weight, out[1].weight)
    assert out[0].weight.min() == 1 and out[0].of(np.array([1, 2], np.uint32)).tolist() == [1.25, 1.25]


def test_clashing_and_null(spark):
    rows = [(1, "a b c d e f g", "x", 1), (1, "a b c d e f g h", "x", 1), (None, "a b c d e f g", "x", 1), (None, None, None, None), (None, "", "y", 2), (2, "q", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _node int")
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    # 7 words have 3 shingles, 8 have 4: similarity 0.75, so two classes.
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "1", "2", "None", "None"]
    upper = docs.withColumnsRenamed({"_gone": "node", "_node": "class_id"})
    assert near_dedup.deduplicate(upper).count() == 5


@pytest.mark.parametrize("few", [None, 0])
def test_components(spark, monkeypatch, few):
    if few is not None:
        monkeypatch.setattr(near_dedup, "FEW_ROWS", few)
    rng = random.Random(3)
    path = list(range(300, 360))
    rng.shuffle(path)  # a long chain in no order
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + list(zip(path, path[1:], strict=False)) + [(400, 401), (401, 400), (400, 401)]
    name = lambda i: bytes([(i * 37) % 256, i % 256, i // 256])
    want = {x: min(c) for x, c in _components([(name(a), name(b)) for a, b in pairs]).items()}
    links = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in pairs], "a binary, b binary")
    got = [(bytes(r["node"]), bytes(r["label"])) for r in near_dedup.components(links).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert not near_dedup.components(links.limit(0)).count()


def test_components_of_few_links_take_few_jobs(spark, tmp_path):
    """The driver keeps every job's plan and stages, and the propagation takes many jobs."""
    spark.range(60).selectExpr("cast(cast(id as string) as binary) a", "cast(cast(id + 1 as string) as binary) b").write.parquet(f"{tmp_path}/links")
    links = spark.read.parquet(f"{tmp_path}/links")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        near_dedup.components(links)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _components(links):
    """The set of nodes of each node's component."""
    of = {}
    for a, b in links:
        both = of.get(a, {a}) | of.get(b, {b})
        of |= dict.fromkeys(both, both)
    return of

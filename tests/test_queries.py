import pytest

from lodestone.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, oracle, name):
    oracle(registry.queries()[name](spark, FOLDER), registry.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("regions", [0, 1500])
def test_common_append_takes_the_whole_list(spark, oracle, tmp_path, regions):
    spark.createDataFrame([(i, f"R{i}" if i % 7 else None) for i in range(regions)], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.read.parquet(f"{FOLDER}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    oracle(registry.queries()["q_common_append"](spark, str(tmp_path)), registry.oracle_sql()["q_common_append"], str(tmp_path))


def test_networks_against_union_find(spark):
    from lodestone.plans.views import frame

    rows = frame(spark, FOLDER, "segs").collect()
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in rows:
        for node in (r["a"], r["b"] + 1_000_000):
            up[find((r["name"], node))] = find(r["way"])
    least: dict = {}
    for r in rows:
        least[find(r["way"])] = min(r["way"], least.get(find(r["way"]), r["way"]))
    want = {r["way"]: least[find(r["way"])] for r in rows}
    assert {r["way"]: r["network"] for r in registry.queries()["q_network_components"](spark, FOLDER).collect()} == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="session")
def dense(spark, tmp_path_factory):
    """Addresses and POIs at a few places: the views' coordinates repeat every 6,120,000 keys."""
    folder = str(tmp_path_factory.mktemp("dense"))
    key = "cast(id div 4 * 6120000 + id % 4 as bigint)"
    spark.range(400).selectExpr(f"{key} as c_custkey", "cast(id % 25 as int) as c_nationkey").write.parquet(f"{folder}/customer.parquet")
    spark.range(24).selectExpr(f"{key} as p_partkey", "'T' as p_type", "cast(id % 50 as int) as p_size", "'N' as p_name").write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize(("name", "module", "taken", "most"), [("q_poi_best_address", "features", "best_address", 10), ("q_nearby_refs", "attach", "with_nearby", 3)])
def test_only_the_nearest_are_paired(spark, oracle, dense, monkeypatch, name, module, taken, most):
    import importlib

    operators = importlib.import_module(f"lodestone.operators.{module}")
    inner, seen = getattr(operators, taken), []

    def watched(*args, **more):
        seen.append(args[0] if module == "features" else args[1])
        return inner(*args, **more)

    monkeypatch.setattr(operators, taken, watched)
    oracle(registry.queries()[name](spark, dense), registry.oracle_sql()[name], dense)
    assert seen[0].groupBy(seen[0].columns[0]).count().agg({"count": "max"}).first()[0] == most
    assert "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pairs", [1, 50, 1 << 17])
@pytest.mark.parametrize("kind", [int, float])
def test_nearest_against_all_pairs(monkeypatch, pairs, kind):
    import random

    import numpy as np

    from lodestone.operators import spatial

    monkeypatch.setattr(spatial, "_PAIRS", pairs)
    rng = random.Random(pairs)
    for spread in (3, 40, 400):
        p = sorted({(kind(rng.randint(0, spread)), kind(rng.randint(0, spread))) for _ in range(40)})
        a = [(kind(rng.randint(-9, spread)), kind(rng.randint(0, spread) // 3)) for _ in range(90)]
        px, py, ax, ay = (np.array(v) for v in (*zip(*p), *zip(*a)))
        for margin, most in ((25, 4), (1000, 10), (0, 1), (25, 200)):
            got = [(int(i), int(j)) for x, y in spatial._nearest_of(px, py, ax, ay, margin, most) for i, j in zip(x, y)]
            want = [(i, j) for i, (x, y) in enumerate(p) for _, j in sorted(((u - x) ** 2 + (v - y) ** 2, j) for j, (u, v) in enumerate(a) if abs(u - x) <= margin and abs(v - y) <= margin)[:most]]
            assert sorted(got) == sorted(want)


def test_nearest_in_squares_of_odd_rows(spark):
    """Rows without a place pair with none, equal places pair all the same, ties go by the column given."""
    from lodestone.operators import spatial

    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, None, 0.0), (4, float("nan"), 0.0), (5, -12.0, 0.5), (6, 99.0, 99.0)], "id long, x double, y double")
    right = spark.createDataFrame([("b", 3.0, 4.0), ("a", -3.0, 4.0), ("c", 3.0, 4.0), (None, 1.0, None), ("d", -9.0, 0.0), ("e", float("nan"), 0.0)], "ref string, x double, y double")
    got = spatial.nearest_in_squares(left, right, 10, 2, 7.0, "ref").select("l.id", "r.ref")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (5, "a"), (5, "d")]
    assert spatial.nearest_in_squares(left.limit(0), right, 10, 2, 7.0, "ref").count() == spatial.nearest_in_squares(left, right.limit(0), 10, 2, 7.0, "ref").count() == 0


def test_street_within_makes_no_pairs_of_cells(spark):
    """No join of whole cells: pairs beyond the distance are not made as rows."""
    assert "Join" not in registry.queries()["q_street_within"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("pairs", [2, 1 << 17])
def test_points_near_segments_against_all_pairs(spark, monkeypatch, pairs):
    """Long, short and pointlike segments, places that repeat or are missing."""
    import random

    import numpy as np
    import pyarrow as pa

    from lodestone.operators import spatial

    rng = random.Random(3)
    at = lambda: rng.randint(-60, 60)
    lines = [(i, at(), at()) for i in range(40)]
    lines = [(i, x, y, x + (i % 3) * rng.randint(-90, 90), y + (i % 3) * rng.randint(-4, 4)) for i, x, y in lines]
    points = [(i, at(), at()) for i in range(60)] + [(99, 0, 0), (98, 0, 0)]

    def d2(x, y, x1, y1, x2, y2):
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n)) if n else 0.0
        return (x - (x1 + t * (x2 - x1))) ** 2 + (y - (y1 + t * (y2 - y1))) ** 2

    want = {(w, i): d for w, *line in lines for i, x, y in points if (d := d2(x, y, *line)) <= 100}
    df = spark.createDataFrame([*lines, (None, None, 0, 0, 0)], "way long, x1 long, y1 long, x2 long, y2 long"), spark.createDataFrame([*points, (97, None, 0)], "id long, x long, y long")
    got = spatial.points_near_segments(*df, 10, 25.0, "way", "id").collect()
    assert len(got) == len(want) and {(r["way"], r["id"]): r["d2"] for r in got} == want
    monkeypatch.setattr(spatial, "_PAIRS", pairs)
    table = lambda rows, *names: pa.table({n: pa.array(np.array(v)) for n, v in zip(names, zip(*rows), strict=True)})
    own, other = table(lines, "l", "x", "y", "x2", "y2"), table(points, "r", "x", "y")
    cell = lambda t, left: t.append_column("_cx", pa.array([0] * len(t))).append_column("_cy", pa.array([0] * len(t))).append_column("_left", pa.array([left] * len(t)))
    every = pa.concat_tables([cell(other, False), cell(own, True)], promote_options="default").combine_chunks().to_batches()
    assert {(a, b): d for r in spatial._near_segments(10)(iter(every)) for a, b, d in zip(*(c.to_pylist() for c in r.columns), strict=True)} == want


def test_rounded(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import geo

    values = [0.0, 0.0005, 0.49999999999999994e-3, 1.0004, 12.3456, 202500.0, 3.0625, 1.9999]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(geo.rounded(F.col("v"), 3).alias("x")).collect()]
    assert got == [0.0, 0.001, 0.0, 1.0, 12.346, 202500.0, 3.063, 2.0]

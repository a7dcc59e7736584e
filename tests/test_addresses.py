"""Part orders, schemes without end and rows of boundaries against folds of their own."""

import random

from pyspark.sql import functions as F

from lodestone.operators import address, streets


def test_part_orders(spark):
    parts = [("street", "S"), ("boundary:10", "B10"), ("place:town", "T"), ("postcode", "12345"), ("letter", "L"), ("hn", "7"), ("place:city", "C"), ("boundary:9", "B9"), ("boundary:8", "B8")]
    df = spark.createDataFrame([(parts,)], "p array<struct<lvl:string,name:string>>")
    got = df.select(*[address.text(F.col("p"), o).alias(o) for o in address.ORDERS]).first().asDict()
    assert got == {"hn_street_city": "12345, 7, L, S, B10, T, C, B8", "street_hn_city": "12345, S, 7, L, B10, T, C, B8", "city_street_hn": "12345, B8, T, C, B10, S, 7, L"}


def test_many_addresses(spark):
    tags = {"addr:housenumber": "1", "addr:street": "S"} | {f"addr{i}:housenumber": str(i) for i in (*range(2, 15), 16)} | {"addr11:street": "E"}
    two = {"addr:housenumber": "1", "addr:housenumber2": "", "addr:street": "S"}
    df = spark.createDataFrame([(1, tags), (2, two), (3, {"addr:housenumber": "1\\2", "addr:street": "S", "addr:street2": "X"})], "id long, tags map<string,string>")
    got = [(r["id"], r["scheme"], r["hn"], r["street"]) for r in address.schemes(df).collect()]
    assert [x for x in got if x[0] == 1] == [(1, f"addrN.{i}", str(i), "S" if i == 1 else "E" if i == 11 else None) for i in range(1, 15)]
    assert [x for x in got if x[0] == 2] == [(2, "addr:hn2.1", "1", "S")]
    assert [x[1:] for x in got if x[0] == 3] == [("addr:street2.1", "1", "S"), ("addr:street2.2", "2", "X")]


def _fold(boundaries):
    rows = []
    for b in boundaries:
        if len(rows) <= 1:
            if rows and rows[0][-1][0] == b[0] > 0:
                rows.append(rows[0][:-1] + [b])
            elif rows:
                rows[0].append(b)
            else:
                rows.append([b])
            continue
        for row in list(rows):
            if row[-1][0] == b[0] > 0:
                rows.append(row[:-1] + [b])
                break
            if b[1] in row[-1][2]:
                row.append(b)
    return [[b[1] for b in r] for r in rows]


def test_boundary_rows(spark):
    rng = random.Random(8)
    lists = [[(4, 1, [4]), (4, 2, [3]), (5, 3, []), (5, 4, [])], [(4, 1, [4]), (4, 2, [3, 4]), (5, 3, []), (5, 4, [])]]
    lists += [[(rng.randint(0, 3), i, [j for j in range(9) if rng.random() < 0.6]) for i in range(rng.randint(0, 8))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, b array<struct<lvl:int,id:bigint,inside:array<bigint>>>")
    got = {r["k"]: r["r"] for r in df.select("k", F.transform(streets.boundary_rows(F.col("b")), lambda r: F.transform(r, lambda x: x["id"])).alias("r")).collect()}
    assert got == {k: _fold(b) for k, b in enumerate(lists)}
    assert got[0] == [[1, 4], [2, 3], [2, 4]]

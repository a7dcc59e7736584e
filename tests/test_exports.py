"""Sizes, types and stripe edges by hand; order of boundaries; keywords."""

from pyspark.sql import functions as F

from lodestone.functions import geo, text
from lodestone.operators import attach, columns


def test_sizes_and_types(spark):
    sizes = [0, 1, 1023, 1024, 1536, 1 << 20, 5 * (1 << 40), 1 << 55]
    got = [r["s"] for r in spark.createDataFrame([(x,) for x in sizes], "n long").select(text.readable_size(F.col("n")).alias("s")).collect()]
    assert got == ["0", "1 B", "1,023 B", "1 kB", "1.5 kB", "1 MB", "5 TB", "32,768 TB"]
    row = spark.range(1).select(text.geometry_type(F.lit("Point"), True).alias("a"), text.geometry_type(F.lit("Point"), False).alias("b")).first()
    assert tuple(row) == ("Point", "point")


def test_blades(spark):
    df = spark.createDataFrame([(0.06, 0.32), (0.04, 0.12), (0.1, 0.2), (0.2, 0.1)], "a double, b double")
    assert [r["x"] for r in df.select(geo.blades(F.col("a"), F.col("b")).alias("x")).collect()] == [[0.1, 0.2, 0.3], [], [], []]


def test_levels_in_order(spark):
    tags = lambda v: {"admin_level": v} if v else {}
    df = spark.createDataFrame([("a", tags("4")), ("b", tags("2")), ("c", tags("4")), ("d", tags("x")), ("e", tags(None)), ("f", tags("0"))], "id string, tags map<string,string>")
    assert [r["id"] for r in attach.by_level(df).collect()] == ["b", "c", "a"]


def test_keywords_and_unknown_columns(spark):
    df = spark.createDataFrame([({"name": "A", "name:de": "B", "x": "C"}, {"en": "Shop", "de": " "}, ["A", "w"])], "tags map<string,string>, titles map<string,string>, words array<string>")
    row = df.select(columns.keywords(F.col("tags"), F.col("titles"), F.col("words")).alias("k"), *columns.chosen(["operator", "nothing"], columns.poi)).first()
    assert tuple(row) == (["A", "B", "Shop", "w"], None, None)

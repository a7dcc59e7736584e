import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """Compare a query with its oracle in DuckDB over a folder of tables."""
    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def compare(df, sql, folder):
        c = duckdb.connect()
        for t in tables:
            path = f"{folder}/{t}.parquet"
            if os.path.exists(path):
                c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(map(repr, r.fetchall()))
        got = sorted(repr(tuple(x)) for x in df.select(*names).collect())
        assert got == want

    return compare

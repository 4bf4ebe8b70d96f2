"""One session for all tests, and DuckDB over the same tables."""

from __future__ import annotations

import math
import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in sorted(os.listdir(DATA)):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="session")
def same_rows():
    """Compare a DataFrame with a DuckDB relation: columns by name, rows in any order."""

    def compare(df, relation):
        names = sorted(df.columns)
        theirs = [d[0] for d in relation.description]
        assert sorted(theirs) == names
        order = [theirs.index(n) for n in names]
        key = lambda row: tuple((x is None, str(x)) for x in row)
        a = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
        b = sorted((tuple(plain(r[i]) for i in order) for r in relation.fetchall()), key=key)
        assert a == b

    return compare

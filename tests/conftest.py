import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _told(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v


def same_rows(df, rel):
    """Whether a DataFrame and a DuckDB result hold the same rows under the same names."""
    names = sorted(df.columns)
    theirs = [d[0] for d in rel.description]
    assert names == sorted(theirs)
    mine = sorted((tuple(map(_told, (r[n] for n in names))) for r in df.collect()), key=repr)
    at = [theirs.index(n) for n in names]
    other = sorted((tuple(_told(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert mine == other


@pytest.fixture(scope="session")
def same():
    return same_rows

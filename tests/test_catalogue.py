"""Every query of the catalogue against its SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from inkstat.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def plain(frame):
    frame = frame[sorted(frame.columns)]
    one = lambda v: None if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    return list(frame.columns), sorted((tuple(one(x) for x in row) for row in frame.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in ORACLE_SQL:
        assert plain(got) == plain(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(got) and not got.isna().all(axis=None)


def test_without_training_operators():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_queries_are_listed_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True, check=True)
    n, known = said.stdout.split()[-2:]
    assert int(n) >= len(QUERIES) and known == "True"

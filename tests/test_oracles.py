"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import os

import duckdb
import pytest

from mojiweave.plans.sql import ORACLES
from mojiweave.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def compare(db, spark, name, query, sql):
    got = query(spark, SF).toPandas()
    db.sql(f"CREATE OR REPLACE TABLE expected AS {sql}")
    names = [r[0] for r in db.sql("DESCRIBE expected").fetchall()]
    assert sorted(names) == sorted(got.columns)
    db.register("got", got)
    cols = ", ".join(f'"{c}"' for c in names)
    for a, b in (("expected", "got"), ("got", "expected")):
        assert db.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(db, spark, name):
    compare(db, spark, name, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

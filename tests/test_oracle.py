"""Every query with SQL gives the rows that a second engine gives for it."""

import math

import duckdb
import pytest

from quire import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
catalog.load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def rows(frame):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "<NA>":
            return "null"
        if hasattr(x, "item"):
            x = x.item()
        return repr(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(name, spark, duck, sf_dir):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    wanted = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_policy_meets_every_gate(spark, sf_dir):
    found = {r.decision for r in catalog.QUERIES["policy_exit_code"](spark, sf_dir.replace("0.001", "0.01")).collect()}
    assert found == {"PROCEED", "PASSTHROUGH-SIGNED", "PASSTHROUGH-SMALL", "E-INPUT-ENCRYPTED", "E-INPUT-CERTIFIED", "E-INPUT-SIGNED", "E-INPUT-OVERSIZE", "E-INPUT-DECOMPRESSION-BOMB"}

"""Queries do the whole job: every row, id and character counts."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import TABLES, rows

from quire import catalog
from quire.functions import text as T
from quire.options import worker_memory_cap

catalog.load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    r = random.Random(3)
    for _ in range(1500):
        a = "".join(r.choice("abä") for _ in range(r.randint(0, 90)))
        b = "".join(x for x in a if r.random() < 0.9) if r.random() < 0.5 else "".join(r.choice("abc") for _ in range(r.randint(0, 90)))
        assert T.edit_distance(a, b) == plain_distance(a, b)


def test_change_after_character_300(spark):
    a = "".join(random.Random(4).choice("abcd 6") for _ in range(900)) + "6"
    b = a[:-1] + "8"
    got = spark.createDataFrame([(a, b)], "a string, b string").select(T.levenshtein_ratio(F.col("a"), F.col("b")), T.levenshtein_within(F.col("a"), F.col("b"), 0.0), T.same_numbers(F.col("a"), F.col("b"))).first()
    assert tuple(got) == (1 / 901, False, False)


def test_few_edits():
    r = random.Random(5)
    for _ in range(1500):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 70)))
        b = list(a)
        for _ in range(r.randint(0, 8)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = [r.choice("abcd")] * r.randint(0, 1)
        b = "".join(b)
        exact = plain_distance(a, b)
        for most in (0, 3, 10):
            assert T.few_edits(a, b, most) == (exact if exact <= most else None)
    long = "".join(r.choice("abcdef ") for _ in range(400_000))
    other = long[:1000] + "X" + long[1000:200_000] + "Y" + long[200_001:]
    assert T.edit_distance(long, other) == 2


def test_every_user(spark, sf_dir):
    """sf0.01 has users beyond 20."""
    larger = sf_dir.replace("0.001", "0.01")
    sql = catalog.ORACLE_SQL["tree_keys"].replace("FROM events", f"FROM '{larger}/events.parquet'")
    got = catalog.QUERIES["tree_keys"](spark, larger).toPandas()
    assert rows(got) == rows(duckdb.sql(sql).df()) and got.nodes.sum() == spark.read.parquet(f"{larger}/events.parquet").count()


def test_every_part(spark, duck, sf_dir):
    sql = catalog.ORACLE_SQL["mem_cap"]
    got = catalog.QUERIES["mem_cap"](spark, sf_dir).toPandas()
    assert rows(got) == rows(duck.sql(sql).df()) and len(got) > 100
    for r in got.itertuples():
        assert r.cap == worker_memory_cap(r.bytes, r.workers, 32 << 30, (None, 0, 512)[r.bytes // 10_000_000 % 3])


def test_every_order_has_its_record(spark, sf_dir):
    got = [r.sidecar for r in catalog.QUERIES["correlation_sidecar"](spark, sf_dir).collect()]
    assert sum(len(json.loads(x)["entries"]) for x in got) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()

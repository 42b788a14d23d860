"""Every query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracewell.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted((tuple(normal(row[c]) for c in names) for row in frame.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    out = duck.execute(ORACLES[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == names
    want = sorted((tuple(normal(row[columns.index(c)]) for c in names) for row in out.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_greedy_pairs(spark):
    import random

    from tracewell.operators.graphs import greedy_pairs

    rng = random.Random(3)
    rows = [(a, b, float(rng.randrange(6))) for a in range(12) for b in range(9) if rng.random() < 0.7]
    used_a, used_b, want = set(), set(), set()
    for a, b, score in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b, score))
    schema = "a int, b int, score double"
    assert {tuple(r) for r in greedy_pairs(spark.createDataFrame(rows, schema)).collect()} == want
    assert greedy_pairs(spark.createDataFrame([], schema)).count() == 0
    assert greedy_pairs(spark.createDataFrame([(None, 1, 1.0), (1, 1, None)], schema)).count() == 0

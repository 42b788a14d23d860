"""Cascades, budgets, running totals and streams into tables against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import rows
from tracewell.streaming import sinks


def test_cascade(spark):
    """A tree that refers to itself, a cycle between two tables, a column that is emptied, null and dangling references."""
    r = random.Random(5)
    a = [(i, r.choice([None, *range(30)]), r.choice([None, *range(40)])) for i in range(30)]
    b = [(i, r.choice([None, *range(30), 99])) for i in range(40)]
    c = [(i, r.choice([None, *range(40)]), "kept") for i in range(50)]
    tables = {"a": spark.createDataFrame(a, "id int, up int, b int"), "b": spark.createDataFrame(b, "id int, a int"), "c": spark.createDataFrame(c, "id int, b int, _gone string")}
    refers = [("a", "up", "a", "cascade"), ("a", "b", "b", "cascade"), ("b", "a", "a", "cascade"), ("c", "b", "b", "null")]
    for start in ([3], [7, 8, 777], []):
        gone_a, gone_b = set(start) & set(range(30)), set()
        while True:
            more_a = {i for i, up, y in a if i not in gone_a and (up in gone_a or y in gone_b)}
            more_b = {i for i, x in b if i not in gone_b and x in gone_a}
            if not more_a and not more_b:
                break
            gone_a, gone_b = gone_a | more_a, gone_b | more_b
        got = rows.cascade({k: v.drop("_gone") for k, v in tables.items()}, dict.fromkeys("abc", "id"), refers, {"a": spark.createDataFrame([(i,) for i in start], "id int")})
        assert {x.id for x in got["a"].collect()} == set(range(30)) - gone_a and {x.id for x in got["b"].collect()} == set(range(40)) - gone_b
        assert {(x.id, x.b) for x in got["c"].collect()} == {(i, None if y in gone_b else y) for i, y, _ in c}


@pytest.mark.parametrize("ranges", [1, 3, 11])
def test_running(spark, ranges):
    r = random.Random(6)
    data = [(r.choice(["hot", "hot", "hot", "x", None]), r.randrange(9), i, r.randrange(-3, 9), 1) for i in range(400)]
    frame = spark.createDataFrame(data, "g string, o int, id int, v long, _part int").repartition(5)
    got = {x.id: x.total for x in rows.running(frame, ["g"], ["o", "id"], "v", "total", ranges).collect()}
    want, sums = {}, {}
    for g, o, i, v, _ in sorted(data, key=lambda x: (x[1], x[2])):
        sums[g] = sums.get(g, 0) + v
        want[i] = sums[g]
    assert got == want
    assert rows.running(frame.where("false"), ["g"], ["o"], "v", "total").count() == 0


def test_budget(spark):
    data = [("p", 1, 0, 50), ("p", 2, 0, 60), ("p", 3, 1, 10), ("q", 4, 1, 10), ("q", 5, 1, 95), ("q", 6, 1, 1), ("r", 7, 0, 500), ("s", 8, 0, 100)]
    frame = spark.createDataFrame(data, "key string, id int, rank int, size long")
    got = {(x.id, x.bytes_before, x.forced) for x in rows.within_budget(frame, "key", ["rank", "id"], "size", F.col("rank") == 0, 100, 150).collect()}
    assert got == {(1, 0, False), (2, 50, True), (4, 0, False), (8, 0, False)}  # 3 and 5 are beyond, 6 is behind 5, 7 beyond all


def test_insert_missing(spark):
    known = spark.createDataFrame([(1, "old"), (None, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (None, "x"), (None, "y")], "k int, v string")
    assert sorted((x.k or 0, x.v) for x in rows.insert_missing(known, new, ["k"], [F.col("v")]).collect()) == [(0, "x"), (0, "y"), (2, "a")]


def test_a_batch_that_runs_twice(spark, tmp_path):
    into = sinks.BatchTable(spark, f"file:{tmp_path}/t", spark.createDataFrame([], "k int, v string").schema)
    assert into.committed() == [] and into.read().count() == 0
    one, two = spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert into.add(one, 0) and not into.add(one, 0) and into.read().count() == 2
    two.write.parquet(f"{tmp_path}/t/batch-1")  # left behind by a run that was lost before its record
    assert into.read().count() == 2
    into.insert_missing(["k"], [F.col("v")])(two, 1)
    assert sorted(map(tuple, into.read().collect())) == [(1, "a"), (1, "a"), (2, "b")] and into.committed() == [0, 1]


def test_a_stream_that_starts_again(spark, tmp_path):
    """Three files, one a batch; the second run has no checkpoint, the third finds one more file."""
    schema = "k int, v string"
    put = lambda n, data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # noqa: E731, ARG005
    for n in range(3):
        put(n, [(n, f"v{n}"), (0, f"w{n}")])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file:{tmp_path}/in")
    into = sinks.BatchTable(spark, f"file:{tmp_path}/t", spark.createDataFrame([], schema).schema)
    for run in ("one", "two"):
        sinks.drain(stream, into.append(), f"file:{tmp_path}/{run}")
    assert into.read().count() == 6
    put(3, [(9, "z")])
    sinks.drain(stream, into.append(), f"file:{tmp_path}/one")
    assert into.read().count() == 7

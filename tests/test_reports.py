"""Exports, likeness and leases by timers against brute force on small fixtures."""

import datetime
import difflib
import hashlib
import random

from pyspark.sql import functions as F

from tracewell.functions import scalars
from tracewell.plans.reports import FAN, LEDGER, record, shrink
from tracewell.sources.tables import SEVERITIES
from tracewell.streaming import leases


def test_shrink(spark):
    rng = random.Random(5)
    rows = [(i, i % 40 if i % 3 else 7, rng.choice([*SEVERITIES, None]), rng.choice(["confirmed", "candidate"])) for i in range(400)]
    got = {r.project_id: (r.kept, r.bytes, r.verdict) for r in shrink(spark.createDataFrame(rows, "id long, project_id long, severity string, status string"), 300, 420, 2).collect()}
    verdicts = set()
    for project in {r[1] for r in rows}:
        sizes = [sum(len('{"id":,"severity":"","status":""}') + len(f"{i}{s}{t}") + 1 for i, p, s, t in rows if p == project and s == worst) for worst in SEVERITIES]
        k = 5
        while k > 2 and sum(sizes[:k]) > 300:
            k -= 1
        total = sum(sizes[:k])
        want = (k, total, "whole" if k == 5 else "shrunk") if total <= 300 else (2, total, "hard") if total <= 420 else (0, 0, "refused")
        assert got[project] == want
        verdicts.add(want[2])
    assert verdicts == {"whole", "shrunk", "refused"} | ({"hard"} & verdicts)
    assert shrink(spark.createDataFrame([], "id long, project_id long, severity string, status string"), 300, 420, 2).count() == 0


def test_block_ratio(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(9)))
    rows = [(word(), word()) for _ in range(80)] + [(None, "a"), ("a", None), ("", "")]
    for r in spark.createDataFrame(rows, "a string, b string").withColumn("r", scalars.block_ratio("a", "b")).collect():
        assert r.r == (0.0 if r.a is None or r.b is None else difflib.SequenceMatcher(None, r.a, r.b).ratio())


def test_leases_end_by_timers(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [(1, day(0)), (1, day(4)), (1, day(10)), (2, day(1)), (3, day(30)), (3, day(30)), (4, day(26)), (None, day(2)), (5, None)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in")
    got = leases.expired_leases(stream, f"{tmp_path}/out", 5 * 24 * 3600 * 1_000_000).select("user_id", F.timestamp_micros("last_at").alias("t")).collect()
    assert sorted((r.user_id, r.t) for r in got) == [(1, day(4)), (1, day(10)), (2, day(1))]


def test_ledger(spark, tmp_path):
    place, sha = f"{tmp_path}/ledger", lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(i, "a", i % 7) for i in range(3 * FAN)] + [(FAN * FAN + 5, "a", 1), (2, "a", 2), (None, None, 3), (4, None, None)]
    random.Random(8).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_chars long")
    record(docs, "one", place)
    record(docs.where("doc_id is null"), "two", place)
    record(docs.where("false"), "none", place)
    lines = [f"{i}\t{i % 7}\t{2 if i == 2 else 1}\n" for i in range(3 * FAN)]
    blocks = [sha("".join(lines[k : k + FAN])) for k in range(0, 3 * FAN, FAN)]
    far = sha(f"{FAN * FAN + 5}\t1\t1\n")
    blank = sha("\t3\t1\n")
    none = sha(sha(blank) + sha(sha("4\t\t1\n")))
    got = {(r.export, r.source): (r.n_rows, r.digest) for r in spark.read.schema(LEDGER).parquet(place).collect()}
    assert got == {("one", "a"): (3 * FAN + 2, sha(sha("".join(blocks)) + sha(far))), ("one", None): (2, none), ("two", None): (1, sha(sha(blank)))}

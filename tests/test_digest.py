"""Digests of sources are computed without gathering a source."""

import hashlib
import random

from tracewell.plans.catalog import digests


def test_digests(spark):
    rows = [(i, "hot", i % 97) for i in range(25_000)] + [(1, None, 5), (2, None, None), (3, "none", None), (8, "b", 1), (8, "b", 0), (10, "b", 2)]
    random.Random(51).shuffle(rows)
    frame = digests(spark.createDataFrame(rows, "doc_id long, source string, n_chars long").repartition(6))
    sha = lambda *lines: hashlib.sha256("".join(f"{i}\t{n}\n" for i, n in lines).encode()).hexdigest()
    want = {"hot": sha(*((i, i % 97) for i in range(25_000))), None: sha((1, 5)), "none": None, "b": sha((8, 0), (8, 1), (10, 2))}
    got = frame.collect()
    assert len(got) == 4 and {row.source: row.digest for row in got} == want
    assert "collect_list" not in frame._jdf.queryExecution().toString()

"""Benchmarks of several passes, and the recall of the radius."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import decontaminate
from tracewell.llm.textarrays import PLAIN_BYTES, shingles, span_hashes, texts, words

BENCH = "/root/testdata/sf0.1/benchmark.parquet"


@pytest.mark.parametrize("items", [5, 1])
def test_passes_one_after_the_other(spark, monkeypatch, items):
    """The same leaks however many passes there are, and no plan stacks them."""
    r = random.Random(17)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    bench = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(3, "again " * 8), (None, "x y z"), (20, None), (21, "")]
    rows = [(i, " ".join(word() for _ in range(20)) + " " + " ".join(t for _, t in r.sample(bench[:12], r.randint(0, 3))) + " end", "own", 1) for i in range(30)]
    rows += [(40, None, None, None), (41, "", "", 0), (5, rows[5][1], "own", 1), (None, rows[6][1], "own", 1), (42, "again " * 9, "o", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, leaks string, leaks_key_0 int").repartition(3)
    asked = spark.createDataFrame(bench, "item_id long, text string")
    shape = lambda df: sorted((repr((x.doc_id, x.text, x.leaks_key_0)), sorted(map(tuple, x.leaks))) for x in df.collect())
    one = decontaminate.find_leaks(frame, asked)
    want = shape(one)
    assert sum(len(x) for _, x in want) > 20 and one._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", items)
    many = decontaminate.find_leaks(frame, asked)
    assert shape(many) == want and many.columns[-1] == "leaks" and set(many.columns) == set(frame.columns)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1
    assert decontaminate.find_leaks(frame.where("false"), asked).count() == 0
    assert all(not x.leaks for x in decontaminate.find_leaks(frame, asked.where("false")).collect())


def test_recall_of_the_radius(spark):
    """Of windows that are similar enough, the radius that the blocks guarantee finds all of a sample of thousands."""
    r = random.Random(18)
    held = [row.text for row in spark.read.parquet(BENCH).collect() if row.text]
    pool = " ".join(held).split()

    def hashes(t):
        data, bounds = texts(pa.array([t.lower()]))
        starts, ends, _ = words(data, bounds, PLAIN_BYTES)
        return shingles(span_hashes(data, starts, ends), decontaminate.WORDS)

    found, far = 0, []
    for t in held:
        own = hashes(t)
        mine = decontaminate.simhash(decontaminate.signs(own), len(own))[0]
        for _ in range(80):
            changed = t.split()
            for _ in range(r.randint(1, 4)):
                k = r.randrange(len(changed))
                if r.random() < 0.7:
                    changed[k] = r.choice(pool)
                elif len(changed) > 6:
                    changed.pop(k)
            other = hashes(" ".join(changed))
            if len(other) and decontaminate.similarity(own, other) >= 0.8:
                found += 1
                far.append(int(np.bitwise_count(mine ^ decontaminate.simhash(decontaminate.signs(other), len(other))[0])))
    assert found > 1000 and sum(d <= decontaminate.RADIUS for d in far) / found >= 0.999, (found, max(far))

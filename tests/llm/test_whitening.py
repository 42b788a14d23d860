"""Whitening against numpy on the whole matrix and against exact whole numbers."""

import math
import random

import numpy as np
import pytest

from tracewell.llm import whitening
from tracewell.llm.queries import op11_embedding_whitening

SCHEMA = "vec_id long, embedding array<double>, deviation string, label int"


def whole(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def brute(vectors, k):
    """n, sums, eigenvalues, trace of the distinct vectors, by numpy in one piece."""
    fit = sorted({tuple(whole(v)) for v in vectors})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(x - s // n) - (s % n) / n for x, s in zip(v, sums, strict=True)] for v in fit])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1][:k], basis[:, ::-1][:, :k], values.sum()


def test_against_numpy(spark):
    r = random.Random(5)
    mixer = np.random.default_rng(5).normal(size=(20, 20))
    good = [(np.array([r.gauss(0, 1) for _ in range(20)]) @ mixer).tolist() for _ in range(300)]
    good += [good[0]] * 200 + [[0.0] * 20, [30.0] * 20, [-0.0] * 20]
    bad = [None, [None] + [0.0] * 19, [math.nan] + [0.0] * 19, [math.inf] + [1.0] * 19, [-math.inf] * 20, [1e300] * 20, [], [1.0, 2.0]]
    rows = [(i if i % 50 else None, v, "own", i) for i, v in enumerate(good + bad)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    model = whitening.fit(frame, "embedding")
    n, sums, values, basis, trace = brute(good, 16)
    assert (model.n, model.sums) == (n, sums)
    assert np.allclose(model.values, values, rtol=1e-9) and math.isclose(model.trace, trace, rel_tol=1e-12)
    assert model.identity_error < 1e-6
    got = whitening.transform(frame, "embedding", model)
    assert got.columns == ["vec_id", "embedding", "label", "deviation", "whitened"]
    got = got.collect()
    assert sorted(row.label for row in got) == list(range(len(good)))
    for row in got:
        x = whole(good[row.label])
        assert int(row.deviation) == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        want = np.array([float(a - s // n) - (s % n) / n for a, s in zip(x, sums, strict=True)]) @ basis / np.sqrt(values)
        assert np.allclose(np.abs(row.whitened), np.abs(want), atol=1e-6)
    distinct = {tuple(whole(good[row.label])): row.whitened for row in got}
    w = np.array(list(distinct.values()))
    assert np.abs(np.cov(w.T, bias=True) - np.eye(16)).max() < 1e-6


def test_poor_tables(spark):
    """No rows, one vector, a constant dimension, deviations beyond 64 bits and beyond 38 digits."""
    empty = spark.createDataFrame([], SCHEMA)
    model = whitening.fit(empty, "embedding")
    assert model.n == 0 and whitening.transform(empty, "embedding", model).count() == 0
    one = spark.createDataFrame([(1, [0.5, 0.25], None, 1)] * 3, SCHEMA)
    model = whitening.fit(one, "embedding")
    assert (model.n, model.explained) == (1, [None, None])
    assert [(int(row.deviation), row.whitened) for row in whitening.transform(one, "embedding", model).collect()] == [(0, [None, None])] * 3
    flat = spark.createDataFrame([(i, [float(i), 7.0], None, i) for i in range(40)], SCHEMA)
    model = whitening.fit(flat, "embedding")
    assert model.explained == [1.0, 0.0] and model.identity_error < 1e-9
    assert all(row.whitened[1] is None for row in whitening.transform(flat, "embedding", model).collect())
    far = [[0.0, 0.0], [2.0**40, 0.0], [0.0, 2.0**55]]
    frame = spark.createDataFrame([(i, v, None, i) for i, v in enumerate(far)], SCHEMA)
    model = whitening.fit(frame, "embedding")
    n, sums = brute(far, 2)[:2]
    assert (model.n, model.sums) == (n, sums)
    want = [sum((n * a - s) ** 2 for a, s in zip(whole(v), sums, strict=True)) for v in far]
    assert [int(row.deviation) for row in sorted(whitening.transform(frame, "embedding", model).collect())] == want
    assert max(want) >= 1 << 64


def test_lengths(spark):
    """Most distinct vectors decide the length; of two as frequent the longer one."""
    frame = spark.createDataFrame([(1, [1.0], None, 1), (2, [2.0], None, 2), (3, [1.0, 2.0], None, 3), (4, [2.0, 1.0], None, 4), (5, [], None, 5)], SCHEMA)
    model = whitening.fit(frame, "embedding")
    assert (model.n, len(model.sums)) == (2, 2)
    assert sorted(row.vec_id for row in whitening.transform(frame, "embedding", model).collect()) == [3, 4]
    nothing = spark.createDataFrame([(1, [], None, 1), (2, None, None, 2)], SCHEMA)
    assert whitening.transform(nothing, "embedding", whitening.fit(nothing, "embedding")).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    out = op11_embedding_whitening(spark, sf)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = out.collect()
    table = {row.vec_id: row.embedding for row in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if row.embedding is not None and all(c is not None and math.isfinite(c) for c in row.embedding)}
    n, sums, values, basis, trace = brute(table.values(), 16)
    assert len(rows) == 16 * len(table)
    for row in rows:
        x = whole(table[row.vec_id])
        k = row.component - 1
        assert (row.n, row.deviation) == (n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
        want = sum((a - s / n) * b for a, s, b in zip(x, sums, basis[:, k], strict=True)) / math.sqrt(values[k])
        assert math.isclose(abs(row.whitened), abs(want), abs_tol=1e-5)
        assert math.isclose(row.explained, values[k] / trace, rel_tol=1e-6) and row.identity_error < 1e-6

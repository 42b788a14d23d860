"""Means to a tenth do not depend on the order of their sums."""

from tracewell.plans.catalog import worker_means


def test_halves(spark):
    """A mean of 38.95 goes up however its doubles are added; before, it went by the order of rows."""
    rows = [("up", "success", v) for v in (0.1, 0.2, 0.15)] + [("half", "success", v) for v in (38.9, 39.0)] + [("odd", "success", v) for v in (0.05,) * 3] + [("minus", "success", -0.25), ("none", "failed", 3.0), ("nulls", "success", None)]
    want = {"up": (3, 0.2), "half": (2, 39.0), "odd": (3, 0.1), "minus": (1, -0.3), "none": (0, None), "nulls": (1, None)}
    for n in (1, 3):
        got = worker_means(spark.createDataFrame(rows, "worker string, outcome string, duration double").repartition(n)).collect()
        assert {x.worker: (x.done, x.mean_duration) for x in got} == want

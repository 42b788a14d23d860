"""Path confidence against brute force: cycles, repeated edges, missing confidences, long chains."""

import random

from tracewell.operators import graphs


def brute(starts, edges):
    hop = {}
    for a, b, c in edges:
        if a is not None and b is not None:
            hop[a, b] = max(hop.get((a, b), 0), round(0.5 if c is None else c, 3))
    out = {}
    for root in {n for n, _ in starts if n is not None}:
        own = max(round(0.65 if c is None else c, 3) for n, c in starts if n == root)
        best, todo = {root: own}, [root]
        while todo:
            at = todo.pop()
            for (a, b), c in hop.items():
                if a == at and min(best[at], c) > best.get(b, -1):
                    best[b] = min(best[at], c)
                    todo.append(b)
        out |= {(root, n): c for n, c in best.items()}
    return out


def test_widest(spark):
    r = random.Random(61)
    edges = [(r.randrange(30), r.randrange(30), r.choice([None, r.random(), 0.9])) for _ in range(70)] + [(0, 1, 0.3), (1, 0, 0.99), (2, 2, 0.9), (None, 3, 0.9), (3, None, 0.9)]
    edges += [edges[0]] * 3
    starts = [(n, r.choice([None, r.random()])) for n in range(12)] + [(3, 0.2), (None, 0.4), (77, 0.8)]
    frame = spark.createDataFrame(edges, "a int, b int, confidence double")
    got = {(x.root, x.node): x.confidence for x in graphs.widest(spark.createDataFrame(starts, "node int, confidence double"), frame).collect()}
    assert got == brute(starts, edges)
    assert graphs.widest(spark.createDataFrame([], "node int, confidence double"), frame).count() == 0
    alone = graphs.widest(spark.createDataFrame([(5, 0.12349)], "node int, confidence double"), frame.where("false"))
    assert [tuple(x) for x in alone.collect()] == [(5, 5, 0.123)]


def test_a_weak_short_cut_is_overtaken(spark):
    """The direct edge is found first and is worse than the chain that arrives later; what lies behind rises again."""
    edges = [(0, 9, 0.2), (9, 10, 0.95)] + [(i, i + 1, 0.9) for i in range(5)] + [(5, 9, 0.9)]
    got = graphs.widest(spark.createDataFrame([(0, 1.0)], "node int, confidence double"), spark.createDataFrame(edges, "a int, b int, confidence double"))
    assert {x.node: x.confidence for x in got.collect()} == {0: 1.0, 9: 0.9, 10: 0.9, **{i: 0.9 for i in range(1, 6)}}


def test_path_confidence(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 2, 0.4), (2, 3, None), (3, 4, 0.87654)], "a int, b int, confidence double")
    starts = spark.createDataFrame([(1, 0.95), (3, None)], "node int, confidence double")
    paths = spark.createDataFrame([(1, [1, 2]), (1, [1, 2, 3, 4]), (1, [1]), (1, [1, 8]), (3, [3, 4]), (7, [7])], "root int, path array<int>")
    got = {(x.root, tuple(x.path)): x.confidence for x in graphs.path_confidence(paths, starts, edges).collect()}
    assert got == {(1, (1, 2)): 0.9, (1, (1, 2, 3, 4)): 0.5, (1, (1,)): 0.95, (1, (1, 8)): 0.5, (3, (3, 4)): 0.65, (7, (7,)): 0.65}

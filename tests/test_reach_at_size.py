"""What graph queries from every node store on the way, and hard edges for them."""

import os
import random

from tracewell.operators import graphs
from tracewell.sources.tables import shared_dir


def stored(spark):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared_dir(spark)) for f in files)


def levels(root, step, depth):
    seen, front = {root: 0}, [root]
    for level in range(1, depth + 1):
        front = {b for a in front for b in step.get(a, ())} - set(seen)
        seen |= dict.fromkeys(front, level)
    return seen


def test_all_roots(spark):
    r = random.Random(3)
    rows = [(r.randrange(40), r.randrange(44)) for _ in range(90)] * 2 + [(None, 1), (7, 7)]
    step = {}
    for a, b in rows:
        step.setdefault(a, set()).add(b)
    want = sorted((a, n, d) for a in step if a is not None for n, d in levels(a, step, 3).items())
    edges = spark.createDataFrame(rows, "a long, b long")
    assert sorted(tuple(x) for x in graphs.reach_all(edges, 3).select("root", "node", "depth").collect()) == want


def test_last_level_is_not_stored(spark):
    """A star of 600 has 360,000 pairs two steps apart: they were written to the shared folder before, and are not now."""
    edges = spark.range(600).selectExpr("id + 1 as a", "0L as b")
    before = stored(spark)
    assert graphs.reach_all(edges, 2, both_ways=True).count() == 600 * 601  # the centre begins no edge
    assert stored(spark) - before < 200_000


def test_capped_in_order(spark):
    edges = spark.createDataFrame([(0, 2, 1), (0, 1, 2), (1, 5, 1), (2, 1, 1), (2, 4, 2), (2, 3, 3), (5, 0, 1), (9, 9, 1)], "a long, b long, rank int")
    got = {}
    for x in graphs.reach_capped(spark.createDataFrame([(0,), (9,), (8,)], "node long"), edges, 3, 2, 5).collect():
        got.setdefault(x.root, []).append((x.pos, x.node, x.depth))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(1, 0, 0), (2, 2, 1), (3, 1, 1), (4, 4, 2), (5, 5, 2)], 9: [(1, 9, 0)], 8: [(1, 8, 0)]}


def test_reached_nodes_are_not_stored(spark):
    """A graph of 1,500 nodes with 12 edges each: nearly all pairs are four steps apart, and what is stored on the way are edges alone (several MB of pairs before)."""
    r = random.Random(9)
    rows = [(a, r.randrange(1500)) for a in range(1500) for _ in range(12)]
    before = stored(spark)
    frame = graphs.reach_all(spark.createDataFrame(rows, "a long, b long"), 4)
    assert stored(spark) - before < 400_000
    got = {(x.root, x.node): x.depth for x in frame.where("root % 100 = 7").collect()}
    step = {}
    for a, b in rows:
        step.setdefault(a, set()).add(b)
    assert got == {(a, n): d for a in range(7, 1500, 100) for n, d in levels(a, step, 4).items()}
    assert stored(spark) - before < 400_000 < frame.count()


def test_named_nodes_are_not_stored(spark):
    """The same for symbols of paths, some null: names come back with the nodes, without a join of what was reached."""
    r = random.Random(10)
    rows = [(f"p{r.randrange(150)}", f"p{r.randrange(160)}", r.choice(["x", "y", None])) for _ in range(900)]
    starts = [(k, f"p{k}", "main") for k in range(150)]
    step = {}
    for a, b, symbol in rows:
        step.setdefault(a, set()).add((b, symbol))
    before = stored(spark)
    frame = graphs.reach_named(spark.createDataFrame(starts, "root long, path string, symbol string"), spark.createDataFrame(rows, "from_path string, to_path string, to_symbol string"), 3)
    got = sorted(((x.root, x.path, x.symbol, x.depth) for x in frame.collect()), key=repr)
    want = []
    for root, path, symbol in starts:
        want += [(root, *node, d) for node, d in levels((path, symbol), {n: step.get(n[0], ()) for n in {(path, symbol), *(x for to in step.values() for x in to)}}, 3).items()]
    assert got == sorted(want, key=repr)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")] and stored(spark) - before < 400_000


def test_blocks_that_are_too_large(spark, monkeypatch):
    """A block with more edges than a task may hold goes level by level, with the same rows."""
    r = random.Random(11)
    rows = [(r.randrange(90), r.randrange(95)) for _ in range(300)]
    edges = spark.createDataFrame(rows, "a int, b int")
    both = []
    for limit in (8_000_000, 160, 0):
        monkeypatch.setattr(graphs, "EDGES_A_BLOCK", limit)
        frame = graphs.reach_all(edges, 3)
        both.append((sorted(tuple(x) for x in frame.select("root", "node", "depth").collect()), frame.select("root", "node", "depth").dtypes))
    assert both[0] == both[1] == both[2]


def test_bits_in_pieces(monkeypatch):
    """A block's roots a few at a time, edges a few at a time and rows in small batches: the same rows as in one piece."""
    import numpy as np

    r = random.Random(12)
    rows = sorted({(r.randrange(150), r.randrange(160)) for _ in range(500)} | {(a, 3) for a in range(100)})
    a, b = (np.array(x) for x in zip(*rows, strict=True))
    roots = np.array(range(0, 150))
    none = np.array([], np.int64)
    step = {}
    for x, y in rows:
        step.setdefault(x, set()).add(y)
    want = {(root, n, d) for root in range(150) for n, d in levels(root, step, 3).items()}
    for bits, gathered, batch in ((1 << 28, 1 << 25, 100_000), (8 * 160, 64, 7), (70 * 160, 8 * 30, 50)):
        for name, value in (("BITS", bits), ("GATHERED", gathered), ("ROWS_A_BATCH", batch)):
            monkeypatch.setattr(graphs, name, value)
        got = [tuple(x.values()) for out in graphs._reached([(roots, roots, none, none, a, b, None)], 3, []) for x in out.to_pylist()]
        assert set(got) == want and len(got) == len(want)

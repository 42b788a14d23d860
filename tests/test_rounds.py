"""Rounds that grow with the logarithm of the longest chain: ancestors and greedy pairs."""

import random
import time

import pytest

from tracewell.operators import graphs


def greedy(rows):
    used_a, used_b, out = set(), set(), set()
    for a, b, score in sorted((r for r in rows if None not in r), key=lambda r: (-r[2], r[0], r[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.add((a, b, score))
    return out


def test_a_chain_of_pairs(spark):
    """Each pair waits for the one before it: every second one is taken, in a few rounds."""
    n = 2000
    rows = [((i + 1) // 2, i // 2, float(n - i)) for i in range(n)]
    began = time.time()
    got = {tuple(x) for x in graphs.greedy_pairs(spark.createDataFrame(rows, "a int, b int, score double")).collect()}
    assert got == greedy(rows) and len(got) == n // 2
    assert time.time() - began < 60


@pytest.mark.parametrize("seed", range(4))
def test_random_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(25), r.randrange(20), float(r.randrange(1 + 10 * seed))) for _ in range(160)] + [(None, 1, 1.0), (1, None, 1.0), (1, 1, None)]
    rows += [(30 + i // 2, 50 + (i + 1) // 2, 100.0 - i) for i in range(15)] + [(3, 50 + k, 200.0 + k) for k in range(4)]
    got = graphs.greedy_pairs(spark.createDataFrame(rows, "a int, b int, score double")).collect()
    assert {tuple(x) for x in got} == greedy(rows) and len(got) == len(greedy(rows))


def test_a_line_of_ancestors(spark):
    n = 1000
    began = time.time()
    got = graphs.ancestors(spark.createDataFrame([(i, i + 1) for i in range(n)], "child int, parent int"))
    assert got.count() == n * (n + 1) // 2 and got.where("depth <> parent - node").count() == 0
    assert time.time() - began < 60


def test_ancestors_in_any_graph(spark):
    r = random.Random(8)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(60)] + [(1, 1), (50, 51), (51, 50), (None, 3), (3, None)]
    up = {}
    for c, p in edges:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    want = {}
    for node in up:
        level, front, seen = 0, {node}, {}
        while front:
            level += 1
            front = {p for x in front for p in up.get(x, ())} - set(seen)
            seen |= {p: level for p in front}
        want |= {(node, p): d for p, d in seen.items()}
    got = graphs.ancestors(spark.createDataFrame(edges, "child int, parent int")).collect()
    assert {(x.node, x.parent): x.depth for x in got} == want and len(got) == len(want)
    assert graphs.ancestors(spark.createDataFrame([], "child int, parent int")).count() == 0


def test_roots_share_the_rows_of_a_node(spark, monkeypatch):
    """Forty roots over 60 nodes: a round holds a row for each node and 32 roots, and labels are those of each root alone."""
    import random

    from tracewell.operators import graphs

    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60), r.choice([0.5, 0.6, 0.7, 0.8, 0.9, 1.0, None])) for _ in range(240)]
    starts = [(n, r.choice([0.65, 0.8, 1.0, None])) for n in range(40)]
    held, kept = [], graphs.kept
    monkeypatch.setattr(graphs, "kept", lambda df, tag="kept": [out := kept(df, tag), held.append(out.count()) if tag == "widest-front" else None][0])
    got = {(x.root, x.node): x.confidence for x in graphs.widest(spark.createDataFrame(starts, "node int, confidence double"), spark.createDataFrame(edges, "a int, b int, confidence double")).collect()}
    want = {(n, n): 0.65 if c is None else c for n, c in starts}
    while True:
        before = dict(want)
        for (root, a), c in before.items():
            for x, b, hop in edges:
                if x == a:
                    want[root, b] = max(want.get((root, b), 0), min(c, 0.5 if hop is None else hop))
        if before == want:
            break
    assert got == want and max(held) <= 2 * 60 < len(want)


def test_paths_are_stored_as_tables(spark, monkeypatch):
    """Steps, nodes that lead on and each level's paths are tables in the shared folder, not checkpoints of rows."""
    from tracewell.operators import graphs

    tags, kept = [], graphs.kept
    monkeypatch.setattr(graphs, "kept", lambda df, tag="kept": (tags.append(tag), kept(df, tag))[1])
    edges = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if a != b], "a int, b int")
    got = graphs.longest_paths(edges.selectExpr("a as node"), edges, 3, 4, 1).collect()
    assert {tuple(r.path) for r in got} == {(0, 1, 2, 3), (1, 0, 2, 3), (2, 0, 1, 3), (3, 0, 1, 2), (4, 0, 1, 2)}
    assert sorted(tags) == ["fronts", "fronts", "steps", "sure", "sure"]

"""Graph queries over all edges against brute force, at the smallest scale."""

import os
import random
from collections import defaultdict

import duckdb
import pytest

from tracewell.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def targets():
    """The sorted targets of each part, from the lines of the orders one by one."""
    lines = duckdb.sql(f"SELECT l_orderkey, l_partkey FROM '{SF}/lineitem.parquet' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey").fetchall()
    out = defaultdict(set)
    for (order, a), (following, b) in zip(lines, lines[1:], strict=False):
        if order == following and a != b:
            out[a].add(b)
    return {a: sorted(bs) for a, bs in out.items()}


def levels(root, step, depth):
    seen, front = {root: 0}, [root]
    for level in range(1, depth + 1):
        front = sorted({b for a in front for b in step.get(a, ())} - set(seen))
        seen |= dict.fromkeys(front, level)
    return seen


def collected(spark, name, *columns):
    return sorted(tuple(row[c] for c in columns) for row in QUERIES[name](spark, SF).collect())


def test_reach(spark, targets):
    want = sorted((root, node, depth) for root in targets for node, depth in levels(root, targets, 4).items())
    assert collected(spark, "q_reach_depth4_all", "root", "node", "depth") == want


def test_impact(spark, targets):
    both = defaultdict(set)
    for a, bs in targets.items():
        for b in bs:
            both[a].add(b)
            both[b].add(a)
    want = sorted((root, node, depth) for root in targets for node, depth in levels(root, both, 2).items())
    assert collected(spark, "q_impact_two_hop_all", "root", "node", "depth") == want


def test_neighbors(spark, targets):
    assert collected(spark, "q_neighbors_topk_all", "a", "b") == sorted((a, b) for a, bs in targets.items() for b in bs[-2:])


def test_reach_capped(spark, targets):
    want = []
    for root in targets:
        found, front = [(root, 0)], [root]
        for level in range(1, 6):
            fresh = []
            for a in front:
                fresh += [b for b in targets.get(a, [])[:24] if b not in fresh and all(b != n for n, _ in found)]
            front = fresh[: 36 - len(found)]
            found += [(b, level) for b in front]
        want += [(root, node, depth, pos) for pos, (node, depth) in enumerate(found, 1)]
    assert collected(spark, "q_reach_capped_all", "root", "node", "depth", "pos") == sorted(want)


def test_reach_wildcard(spark, targets):
    """Unlike a part, a symbol leads wherever any symbol of its path leads."""
    step, own = defaultdict(set), defaultdict(set)
    for a, bs in targets.items():
        own[a // 4].add((a // 4, a % 4))
        step[a // 4] |= {(b // 4, b % 4 if b % 3 else None) for b in bs}
    want = []
    for root, starts in own.items():
        seen, front = dict.fromkeys(starts, 0), starts
        for level in (1, 2, 3):
            front = {x for path, _ in front for x in step.get(path, ())} - set(seen)
            seen |= dict.fromkeys(front, level)
        want += [(root, path, symbol, depth) for (path, symbol), depth in seen.items()]
    got = [tuple(row[c] for c in ("root", "path", "symbol", "depth")) for row in QUERIES["q_reach_wildcard_all"](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def best_paths(root, step, depth, fan_out, n):
    found, front = [], [(root,)]
    for _ in range(depth):
        front = [(*p, b) for p in front for b in step.get(p[-1], [])[:fan_out] if b not in p]
        found += front
    return sorted(found, key=lambda p: (-len(p), ">".join(map(str, p))))[:n]


def test_paths(spark, targets):
    got = defaultdict(list)
    for row in QUERIES["q_paths_top2_all"](spark, SF).collect():
        got[row.root].append(row.path)
    assert {root: len(p) for root, p in got.items()} == dict.fromkeys(targets, 2)
    for root in sorted(targets)[:8]:
        assert sorted(got[root]) == sorted(">".join(map(str, p)) for p in best_paths(root, targets, 4, 24, 2))


@pytest.mark.parametrize(("nodes", "chance"), [(14, 0.15), (14, 0.45), (120, 0.02)])
def test_longest_paths_with_dead_ends(spark, nodes, chance):
    import random

    from tracewell.operators.graphs import longest_paths

    r = random.Random(nodes)
    rows = [(a, b) for a in range(nodes) for b in range(nodes) if a != b and r.random() < chance]
    step = defaultdict(list)
    for a, b in sorted(rows):
        step[a].append(b)
    frame = spark.createDataFrame(rows, "a long, b long")
    got = longest_paths(frame.selectExpr("a as node"), frame, 4, 5, 2).collect()
    want = {(root, p) for root in step for p in best_paths(root, step, 4, 5, 2)}
    assert len(got) == len(want) and {(x.root, tuple(x.path)) for x in got} == want


def test_paths_over_all_targets(spark):
    """The paths that come first as text lead through the 25th and later targets of a part, and by a part of 400 targets."""
    from tracewell.operators.graphs import longest_paths

    r = random.Random(4)
    rows = [(0, b) for b in range(1, 401)] + [(a, r.randrange(401)) for a in range(1, 401) for _ in range(30) if a % 7]
    step = defaultdict(set)
    for a, b in rows:
        if a != b:
            step[a].add(b)
    step = {a: sorted(bs) for a, bs in step.items()}
    frame = spark.createDataFrame([(a, b) for a, bs in step.items() for b in bs], "a long, b long")
    roots = [0, 1, 2, 3, 5]
    got = longest_paths(spark.createDataFrame([(a,) for a in roots], "node long"), frame, 3, None, 3).collect()
    whole = {(root, p) for root in roots for p in best_paths(root, step, 3, 401, 3)}
    assert {(x.root, tuple(x.path)) for x in got} == whole != {(root, p) for root in roots for p in best_paths(root, step, 3, 24, 3)}


def test_all_targets_of_a_part(spark, monkeypatch):
    """The query hands on every target: from part 1 the first path as text begins with its greatest target, the 30th."""
    from tracewell.sources import tables

    rows = [(1, b) for b in range(2, 31)] + [(1, 100)] + [(a, a + k) for a in (*range(2, 31), *range(100, 104)) for k in (1, 2, 3)]
    monkeypatch.setattr(tables, "all_edges", lambda *_: spark.createDataFrame(rows, "a long, b long"))
    got = sorted(x.path for x in QUERIES["q_paths_top2_all"](spark, SF).where("root = 1").collect())
    step = defaultdict(list)
    for a, b in sorted(rows):
        step[a].append(b)
    assert got == sorted(">".join(map(str, p)) for p in best_paths(1, step, 4, 100, 2)) and got[0].startswith("1>100>")


def test_lineage_runs_to_its_end(spark):
    from tracewell.plans.catalog import lineage

    rows = [("long", i) for i in range(60)] + [("gap", i) for i in (1, 2, 4, 5, 6)]
    got = sorted(tuple(x) for x in lineage(spark.createDataFrame(rows, "conv_id string, turn long")).collect())
    assert got == [("gap", 6, i, 6 - i) for i in (4, 5, 6)] + [("long", 59, i, 59 - i) for i in range(60)]

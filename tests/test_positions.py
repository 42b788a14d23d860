"""Joins by position, optional filters and matching against brute force: nulls, ties, empty tables."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewell.operators import filters, graphs, rows, spans, telemetry
from tracewell.plans.selections import match_metrics


@pytest.fixture(scope="module")
def sides():
    r = random.Random(61)
    points = [(i, r.choice(["a", "b", "c", None]), r.choice([None, *range(0, 400, 3)])) for i in range(150)]
    ranges = []
    for i in range(120):
        low = r.randrange(380)
        ranges.append((i, r.choice(["a", "b", None]), low, low + r.choice([0, 5, 5, 90, 300])))
    return points, ranges


def test_containing_span(spark, sides):
    points, ranges = sides
    got = {x.point_id: (x.span_id, x.inside) for x in spans.containing_span(spark.createDataFrame(points, "point_id long, key string, at long"), spark.createDataFrame(ranges, "span_id long, key string, low long, high long")).collect()}
    assert set(got) == {i for i, _, _ in points}
    for i, key, at in points:
        mine = [x for x in ranges if key is not None and at is not None and x[1] == key]
        inner = sorted((h - low, j) for j, _, low, h in mine if low <= at <= h)
        before = sorted((-low, j) for j, _, low, _ in mine if low <= at)
        assert got[i] == ((inner[0][1], True) if inner else (before[0][1] if before else None, False))


def test_nearest_and_overlaps(spark, sides):
    points, ranges = sides
    left, right = spark.createDataFrame(points[:70], "left_id long, key string, at long"), spark.createDataFrame(points[70:], "right_id long, key string, at long")
    got = {x.left_id: (x.right_id, x.distance) for x in spans.nearest(left, right).collect()}
    for i, key, at in points[:70]:
        near = sorted((abs(at - b), j) for j, k, b in points[70:] if key is not None and k == key and at is not None and b is not None)
        assert got.get(i) == ((near[0][1], near[0][0]) if near else None)
    a, b = spark.createDataFrame(ranges[:60], "left_id long, key string, low long, high long"), spark.createDataFrame(ranges[60:], "right_id long, key string, low long, high long")
    found = sorted((x.left_id, x.right_id, x.distance) for x in spans.overlap_scores(a, b).collect())
    want = []
    for i, key, low, high in ranges[:60]:
        scored = [(0 if low <= h and lo <= high else min(abs(low - h), abs(lo - high)), j) for j, k, lo, h in ranges[60:] if key is not None and k == key]
        want += [(i, j, d) for d, j in scored if d == min(scored)[0]]
    assert found == sorted(want)
    empty = left.where("left_id < 0")
    assert spans.nearest(empty, right).count() == spans.nearest(left, right.where("right_id < 0")).count() == 0


def test_intervals_of_any_length(spark):
    r = random.Random(63)
    ranges = [(i, r.choice("ab"), low := r.randrange(-(10**15), 10**15), low + r.choice([0, 63, 64, 10**6, 10**13, 2 * 10**15])) for i in range(160)] + [(160, "a", 5, 4)]
    points = [(i, r.choice("ab"), r.choice(ranges)[r.choice([2, 3])] + r.choice([-1, 0, 1])) for i in range(200)]
    own, other = [x for x in ranges if x[0] % 2], [x for x in ranges if x[0] % 2 == 0]
    frame = lambda rows, id: spark.createDataFrame(rows, f"{id} long, key string, low long, high long")
    got = {x.point_id: x.span_id for x in spans.containing_span(spark.createDataFrame(points, "point_id long, key string, at long"), frame(ranges, "span_id")).collect() if x.inside}
    want = {i: sorted((h - low, j) for j, k, low, h in ranges if k == key and low <= at <= h) for i, key, at in points}
    assert got == {i: found[0][1] for i, found in want.items() if found}
    scores = {(i, j): 0 if low <= h and lo <= high else min(abs(low - h), abs(lo - high)) for i, key, low, high in own for j, k, lo, h in other if key == k and low <= high and lo <= h}
    best = {i: min(d for (a, _), d in scores.items() if a == i) for i, _ in scores}
    assert sorted(tuple(x) for x in spans.overlap_scores(frame(own, "left_id"), frame(other, "right_id")).collect()) == sorted((i, j, d) for (i, j), d in scores.items() if d == best[i])
    assert spans.overlap_scores(frame([], "left_id"), frame(other, "right_id")).count() == spans.overlap_scores(frame(own, "left_id"), frame([], "right_id")).count() == 0


def test_containing_texts_and_frames(spark):
    texts = spark.createDataFrame([(1, "one two three four five"), (2, "two three"), (3, None), (4, "xone two threex")], "id long, text string")
    needles = spark.createDataFrame([(1, "one two three"), (2, "three four five"), (3, None), (4, "a b")], "needle_id long, needle string")
    assert sorted(tuple(x) for x in spans.containing_texts(texts, needles).collect()) == [(1, 1), (1, 2), (4, 1)]
    lines = spark.createDataFrame([("f", i, f"t{i}") for i in range(1, 6)], "path string, line int, text string")
    hits = spark.createDataFrame([("f", 1), ("f", 4), ("f", 4), ("g", 2)], "path string, line int")
    assert {(x.path, x.hit): x.excerpt for x in spans.line_frames(lines, hits, 1).collect()} == {("f", 1): "1: t1\n2: t2", ("f", 4): "3: t3\n4: t4\n5: t5"}
    pairs = spans.look_back(spark.createDataFrame([("f", 1), ("f", 50), ("f", 90)], "path string, line int"), spark.createDataFrame([("f", 81), ("f", 89)], "path string, line int"), 80).collect()
    assert sorted((x.source_line, x.sink_line) for x in pairs) == [(1, 81), (50, 81), (50, 89)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "A", "50%", None), (2, None, "x", 3), (3, " \t", "b_c", 4)], "id int, a string, b string, c int")
    ids = lambda cond: [x.id for x in df.where(cond).orderBy("id").collect()]
    assert ids(filters.optional_equal("a", None)) == [1, 2, 3] and ids(filters.optional_equal("a", "A")) == [1]
    assert ids(filters.excludes(F.col("a") == "A", F.col("b") == "50%")) == [2, 3]  # the second condition decides for row 2
    assert ids(filters.excludes(F.col("a") == "A", F.col("c") > 3)) == [2, 3]  # null decides for row 1 only
    assert ids(filters.mentions(["a", "b"], "%")) == [1] and ids(filters.mentions(["b"], "_C")) == [3]
    assert ids(filters.blank("a")) == [2, 3] and ids(filters.either(a="A", c=3)) == [1, 2] and ids(filters.either(a=None)) == []
    assert [x.id for x in filters.with_keys(df, spark.createDataFrame([(2,), (2,), (None,)], "id int"), "id").collect()] == [2]
    assert df.select(filters.present(i=F.col("id"), c=F.col("c")).alias("j")).first().j == '{"i":1}'
    assert filters.found_or_fail(df, "id", 2).first().b == "x"
    with pytest.raises(PySparkException):
        filters.found_or_fail(df, "id", 9).collect()


def test_match_metrics(spark):
    r = random.Random(62)
    schema = "id long, key long, kind string, place long, label long"
    make = lambda base, n: [(base + i, r.randrange(3), r.choice("xyz"), r.randrange(3), r.randrange(3)) for i in range(n)]
    expected, found = make(0, 14), make(100, 17)
    scored = []
    for a in expected:
        for b in found:
            score = 40 * (a[2] == b[2]) + 35 * (a[3] == b[3]) + 25 * (a[4] == b[4])
            if a[1] == b[1] and score >= 55:
                scored.append((-score, a[0], b[0]))
    used, tp = set(), 0
    for _, a, b in sorted(scored):
        if a not in used and b not in used:
            used |= {a, b}
            tp += 1
    row = match_metrics(spark.createDataFrame(found, schema), spark.createDataFrame(expected, schema)).first()
    p, q = tp / 17, tp / 14
    assert (row.true_positives, row.false_positives, row.false_negatives) == (tp, 17 - tp, 14 - tp)
    assert abs(row.precision - p) < 1e-4 and abs(row.recall - q) < 1e-4 and abs(row.f1 - 2 * p * q / (p + q)) < 2e-4
    none = match_metrics(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).first()
    assert (none.true_positives, none.precision, none.recall) == (0, 1.0, 1.0)


def test_rows_with_nulls_and_without_rows(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, None, 1), (4, None, 1)], "id int, k string, v int")
    assert sorted(x.id for x in rows.first_rows(df, ["k"], [F.desc("v"), F.col("id")]).collect()) == [1, 3]
    assert sorted(x.id for x in rows.ties(df, ["k"], [F.col("v")]).collect()) == [2, 3, 4]
    assert rows.round_robin(df, "k", [F.col("id")], 3).count() == 3
    assert rows.first_rows(df.where("id < 0"), ["k"], [F.col("id")]).count() == 0
    base = spark.createDataFrame([(1, "x"), (2, "y")], "key int, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "key int, v string")
    assert sorted(tuple(x) for x in rows.upsert(base, new, "key", []).collect()) == [(1, "x"), (2, "y"), (3, "w")]
    history = spark.createDataFrame([(1, "k", "failed", 1), (2, "k", "success", 2), (3, "k", "failed", 3), (4, None, "failed", 4)], "id int, k string, outcome string, at int")
    got = {x.k: (x.failures, x.last_failed_at) for x in telemetry.failure_streaks(history, "k", "id", "outcome", "at").collect()}
    assert got == {"k": (1, 3), None: (1, 4)}


def test_ancestors(spark):
    rows_ = [(2, 1), (3, 2), (4, 3), (4, 1), (5, 5), (6, 7), (7, 6)]
    got = {(x.node, x.parent): x.depth for x in graphs.ancestors(spark.createDataFrame(rows_, "child long, parent long")).collect()}
    assert got == {(2, 1): 1, (3, 2): 1, (3, 1): 2, (4, 3): 1, (4, 2): 2, (4, 1): 1, (5, 5): 1, (6, 7): 1, (7, 6): 1, (6, 6): 2, (7, 7): 2}
    assert graphs.ancestors(spark.createDataFrame([], "child long, parent long")).count() == 0
    edges = spark.createDataFrame([(1, 2), (2, 3), (None, 3)], "a long, b long")
    assert [tuple(x) for x in graphs.induced(edges, spark.createDataFrame([(1,), (2,), (None,)], "node long")).collect()] == [(1, 2)]


def test_compare_and_set(spark):
    from tracewell.operators.rows import compare_and_set

    state = spark.createDataFrame([(1, None, "a"), (2, 9, "b"), (3, None, "c"), (None, None, "d"), (4, None, "e")], "k int, worker int, other string")
    claims = spark.createDataFrame([(1, 5, 2), (1, 7, 1), (1, 6, 1), (2, 5, 1), (3, None, 1), (None, 5, 1), (8, 5, 1)], "k int, claimant int, at int")
    got = {tuple(r) for r in compare_and_set(state, claims, "k", "worker", ["at"]).collect()}
    assert got == {(1, 6, "a", True), (2, 9, "b", False), (3, None, "c", False), (None, None, "d", False), (4, None, "e", False)}
    assert compare_and_set(state.where("false"), claims, "k", "worker", ["at"]).count() == 0
    assert compare_and_set(state, claims.where("false"), "k", "worker", ["at"]).where("updated").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_exact_or_nearest(spark, seed):
    r = random.Random(seed)
    some = lambda n: r.choice([None, *range(n)])
    left = [(i, some(3), some(12)) for i in range(40)] + [(40, 7, 1)]
    right = [(i, some(3), r.choice([None, 2, 3, 9]), r.randrange(3)) for i in range(25)]
    want = set()
    for i, key, at in left:
        near = sorted((abs(at - a), p, j) for j, k, a, p in right if key is not None and k == key and None not in (at, a))
        same = [x for x in near if x[0] == 0][:2]
        want |= {(i, j, d) for d, _, j in same or near[:1]}
    a = spark.createDataFrame(left, "left_id long, key int, at int")
    b = spark.createDataFrame(right, "right_id long, key int, at int, priority int")
    got = spans.exact_or_nearest(a, b).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert spans.exact_or_nearest(a.where("false"), b).count() == spans.exact_or_nearest(a, b.where("false")).count() == 0


def test_failure_texts(spark):
    rows_ = [("a", 1, "failed", 1, "x"), ("a", 2, "success", 2, None), ("a", 3, "failed", 3, "b"), ("a", 4, "failed", 4, "c"), (None, 5, "failed", 5, None), ("b", 6, "success", 6, "y")]
    history = spark.createDataFrame(rows_, "k string, id int, outcome string, at int, text string")
    got = {tuple(x) for x in telemetry.failure_streaks(history, "k", "id", "outcome", "at", "text").collect()}
    assert got == {("a", 2, 4, "c"), (None, 1, 5, None)}
    assert telemetry.failure_streaks(history.where("false"), "k", "id", "outcome", "at", "text").count() == 0


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a", 7, 8, 9), (2, "a", 5, 6, 7)], "id int, k string, _n int, _first int, _claimed int")
    order = [F.col("id")]
    assert [tuple(x) for x in rows.first_rows(df, ["k"], order).collect()] == [tuple(x) for x in rows.ties(df, ["k"], order).collect()] == [(1, "a", 7, 8, 9)]
    assert rows.quota_fill(df, "k", order, 1, 5).columns == [*df.columns, "pass"] and rows.quota_fill(df, "k", order, 1, 5).count() == 2
    claims = spark.createDataFrame([(2, 4, 1)], "id int, claimant int, at int")
    got = rows.compare_and_set(df.withColumn("worker", F.lit(None).cast("int")), claims, "id", "worker", ["at"]).collect()
    assert {tuple(x) for x in got} == {(1, "a", 7, 8, 9, None, False), (2, "a", 5, 6, 7, 4, True)}

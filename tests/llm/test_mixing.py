"""The mix against a plain version: targets by resharing, awards one by one, words by stretches of documents."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tracewell.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, place int, draw int"


def plain_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Reshares the excess until no source is above its limit."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full = set()
    while True:
        rest, among = share * sum(sizes.values()) - sum(most * sizes[s] for s in full), sum(weight[s] for s in sizes if s not in full)
        above = {s for s in sizes if s not in full and rest * weight[s] > most * sizes[s] * among}
        if not above:
            return {s: float(most * sizes[s]) if s in full else float(rest * weight[s] / among) if among else 0.0 for s in sizes}
        full |= above


def plain_awards(targets, blocks, seats, most=2):
    given = Counter()
    for _ in range(seats):
        s = max((s for s in targets if given[s] < most * blocks[s]), key=lambda s: (targets[s] / (2 * given[s] + 1), -list(targets).index(s)))
        given[s] += 1
    return given


@pytest.fixture(scope="module")
def rows():
    r = random.Random(41)
    text = lambda n: " ".join("w" * r.randint(1, 5) for _ in range(n))
    out = [(i, text(r.randint(0, 60)), "hot" if i % 3 else r.choice(["a", "b", "", "é", "\U0001f600", "～", None]), "x", 1, 2) for i in range(200)]
    out += [(None, text(9), "a", None, None, None), (7, None, "a", "x", 1, 2), (7, " \n\t", "nothing", "x", 1, 2), (8, None, "nothing", "x", 1, 2), (9, text(3000), "long", "x", 1, 2)]
    return out + [out[5]] * 3


@pytest.mark.parametrize(("resolution", "shards"), [(1 << 20, 4), (300, 7), (40, 1)])
def test_mix(spark, rows, resolution, shards):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made = mixing.mix(frame, resolution=resolution, shards=shards)
    docs = made.documents.collect()
    sizes, taken = Counter(), Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    assert Counter((d.doc_id, d.source, d["size"]) for d in docs) == Counter((i, s, len((t or "").split())) for i, t, s, *_ in rows)
    want, total = plain_targets(sizes), sum(sizes.values())
    for d in docs:
        assert d.source_size == sizes[d.source] and d.target == pytest.approx(want[d.source])
        assert 0 <= d.taken <= 2 * d["size"]
        taken[d.source] += d.taken
    words = max(1, -(-3 * total // (2 * resolution)))
    assert made.block_words == words
    assert all(abs(taken[s] - want[s]) <= 2 * words for s in sizes)
    # whole quotas: the awards of a plain version, and about the mix in each shard
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets, blocks, seats = {s: want[s] for s in order}, {s: -(-sizes[s] // words) for s in order}, (3 * total + words) // (2 * words)
    quotas = {(q.shard, q.source): q.blocks for q in made.quotas.collect()}
    given = Counter()
    for (_, s), n in quotas.items():
        given[s] += n
    if resolution < 1000:
        assert given == +plain_awards(targets, blocks, seats)
    for (_, s), n in quotas.items():
        assert abs(n - want[s] / words / shards) <= 2
    # every awarded block once in a turn; stretches add up to what is taken and hold no word of a document twice in a turn
    pieces, held = made.pieces().collect(), defaultdict(int)
    for p in pieces:
        held[p.doc_id] += p.n_words
        assert p.n_words > 0 and p.first_word >= 0
    by_id = Counter()
    for d in docs:
        by_id[d.doc_id] += d.taken
    assert +by_id == Counter(held)
    again = mixing.mix(frame.repartition(2), resolution=resolution, shards=shards).documents.collect()
    assert sorted(map(repr, again)) == sorted(map(repr, docs))


def test_poor_tables(spark):
    empty = mixing.mix(spark.createDataFrame([], SCHEMA))
    assert empty.documents.collect() == [] and empty.quotas.collect() == []
    wordless = mixing.mix(spark.createDataFrame([(1, None, None, "", 1, 1), (2, " ", "a", "", 1, 1)], SCHEMA))
    assert sorted((d.doc_id, d["size"], d.source_size, d.target, d.taken) for d in wordless.documents.collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = mixing.mix(spark.createDataFrame([(1, "a b c d", None, "", 1, 1)], SCHEMA))
    assert [(d["size"], d.target, d.taken) for d in one.documents.collect()] == [(4, 6.0, 6)]


def test_plan_is_native(spark, rows):
    made = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    plan = made.documents._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))

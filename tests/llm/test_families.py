"""Pairs of one large family of near copies: representatives link it, so that few pairs are left to verify."""

import random

from tracewell.llm import ngram_join


def family(copies, words=150, seed=43):
    r = random.Random(seed)
    base = ["".join(r.choices("abcdefghij", k=7)) for _ in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(1, copies):
        text = list(base)
        for at in r.sample(range(words), r.randint(1, 4)):
            text[at] = f"changed{i}x{at}"
        rows.append((i, " ".join(text)))
    return rows


def test_pairs_follow_the_copies(spark, monkeypatch):
    """Twice the copies, about twice the verified pairs; links as by brute force."""
    seen = []
    verified = ngram_join.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verified", counted)
    for copies in (150, 300):
        rows, k = family(copies), 5
        seen.clear()
        got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, 80, 100).collect()}
        assert sum(seen) <= 2 * copies, seen
        sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for _, t in rows)]
        want = list(range(copies))
        for a in range(copies):
            for b in range(a):
                if want[a] != want[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low, high = sorted((want[a], want[b]))
                    want = [low if x == high else x for x in want]
        assert [got[i] for i in range(copies)] == want and 1 < len(set(want)) < copies / 2

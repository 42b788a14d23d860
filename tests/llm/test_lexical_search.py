"""Ranked search against scores of every document by plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from tracewell.llm import lexical_search
from tracewell.llm.common import forget

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrst", k=2 + i % 14)) for i in range(150)] + ["é", "日本", "Straße", "ÀB", "x1y2z3longer", "42"]


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    """(item, rank, id, score) of every item."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            n = sum(c.values())
            m, score = 10 + 90 * n * n_docs // total, 0
            for t in set(terms(text)) & set(c):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(51)
    prose = lambda n: r.choice([" ", ", ", "\n"]).join(r.choices(WORDS, weights=[1 / (k + 1) for k in range(len(WORDS))], k=n))
    docs = [(i, prose(r.randint(1, 80))) for i in range(220)]
    docs += [(300 + i, docs[4][1]) for i in range(40)] + [docs[9]] * 3 + [(None, docs[4][1]), (None, docs[7][1]), (400, None), (401, ""), (402, "-- !!"), (403, prose(9000)), (404, "a" * 5000), (405, docs[11][1].upper())]
    r.shuffle(docs)
    items = [(i, prose(r.randint(1, 30))) for i in range(25)] + [(90, None), (91, ""), (92, "?!"), (93, docs[4][1]), (94, "a" * 5000), (95, "nowhere-to-be-found zzzz"), (3, prose(5)), (None, docs[0][1] or "x"), (96, prose(2000))]
    return docs, items


@pytest.mark.parametrize(("block_docs", "top", "group"), [(64, 10, 64), (3, 10, 5), (1, 3, 64), (7, 1, 4)])
def test_search(spark, rows, monkeypatch, block_docs, top, group):
    docs, items = rows
    monkeypatch.setattr(lexical_search, "PASS_QUERIES", 11)
    monkeypatch.setattr(lexical_search, "GROUP_BLOCKS", group)
    frame = spark.createDataFrame([(i, t, "own", 1) for i, t in docs], "doc_id long, text string, block string, score int").repartition(3)
    index = lexical_search.build(frame, block_docs=block_docs)
    assert (index.documents, index.terms) == (sum(1 for _, t in docs if terms(t)), sum(len(terms(t)) for _, t in docs))
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = lexical_search.search(index, asked, top=top)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted((tuple(row) for row in got.collect()), key=repr) == brute(docs, items, top)
    forget(index.blocks)


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    """One document of 400 has the rare terms: few blocks are scored, and a bound that equals the threshold still is."""
    docs = [(i, f"common filler{i % 5}") for i in range(400)]
    docs[250] = (250, "rare needle common")
    index = lexical_search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_docs=4)
    asked, scored = lexical_search.Queries(["rare needle common"]), []
    lexical_search.weigh(index, asked)
    plain = lexical_search.Queries.scores
    monkeypatch.setattr(lexical_search.Queries, "scores", lambda self, row, which: scored.append(row["block"]) or plain(self, row, which))
    blocks = [row.asDict() for row in index.blocks.collect()]
    best = lexical_search.scan(iter(blocks), asked, 1)
    assert best.rows[0][0][2] == 250 and len(scored) < 20
    assert lexical_search.first_blocks(index, asked)[0] in {b["block"] for b in blocks}
    asked.least[:] = -best.rows[0][0][0]
    scored.clear()
    assert lexical_search.scan(iter(blocks), asked, 1).rows[0][0][2] == 250 and len(scored) == 1


def test_other_ids_and_empty_tables(spark):
    docs = [("b", "one two"), ("a", "one two"), (None, "one two"), ("é", "two")]
    index = lexical_search.build(spark.createDataFrame(docs, "doc_id string, text string"))
    asked = spark.createDataFrame([("q", "two one")], "item_id string, text string")
    assert [row.doc_id for row in sorted(lexical_search.search(index, asked).collect(), key=lambda row: row.rank)][:2] == ["a", "b"]
    none = lexical_search.build(spark.createDataFrame([], "doc_id long, text string"))
    assert lexical_search.search(none, asked).collect() == []
    assert lexical_search.search(index, asked.where("false")).collect() == []
    assert lexical_search.search(lexical_search.build(spark.createDataFrame([(1, None), (2, "!")], "doc_id long, text string")), asked).collect() == []

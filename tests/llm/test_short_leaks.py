"""Texts with fewer words than a benchmark item, against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tracewell.llm import decontaminate


def similar(a, b):
    k = min(5, len(b))
    x, y = (Counter(tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_texts_shorter_than_an_item(spark):
    """The whole text is compared as one window; the order of its words matters as in any other."""
    r = random.Random(31)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    items = [[word() for _ in range(n)] for n in (59, 40, 24, 12, 9, 3)]
    texts = [w[a : len(w) - b] for w in items for a, b in ((0, 2), (2, 0), (1, 1), (0, 12), (0, 1))]
    texts += [[*items[0][:30], "changed", *items[0][31:57]], items[0][:4], items[4][:4], items[5][:1]]
    texts = [w for w in texts if w]
    want = {}
    for i, w in enumerate(texts):
        for j, item in enumerate(items):
            windows = [w] if len(w) < len(item) else [w[a : a + len(item)] for a in range(len(w) - len(item) + 1)]
            best = max(similar(x, item) for x in windows)
            if best >= 0.8:
                want[i, j] = best
    assert want[0, 0] == 53 / 55
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    got = {(row.doc_id, row.item_id): row for row in decontaminate.leak_pairs(docs, bench).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[x].similarity - want[x]) < 1e-9 for x in want)
    assert (got[0, 0].first_word, got[0, 0].n_words) == (0, 57)
    clean = decontaminate.find_leaks(docs, bench).where(F.size("leaks") == 0)
    assert {row.doc_id for row in clean.collect()} == set(range(len(texts))) - {i for i, _ in want}

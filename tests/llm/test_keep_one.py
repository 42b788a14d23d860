"""One document of each group stays, whatever its ids are."""

import random

from tracewell.llm import ngram_join


def test_null_and_repeated_ids(spark):
    r = random.Random(41)
    texts = [" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(120)) for _ in range(4)]
    near = [[t, t + " one", t + " two"] for t in texts]
    rows = [(None, t) for t in near[0]] + [(7, t) for t in near[1]] + [(None, near[2][0]), (9, near[2][1]), (9, near[2][2])] + [(3, near[3][0]), (2, near[3][1])]
    rows += [(None, near[0][0]), (None, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(row.doc_id, row.text) for row in ngram_join.keep_one(frame).collect()]
    group = {t: i for i, ts in enumerate(near) for t in ts}
    assert sorted((group[t], i or 0) for i, t in got if t) == [(0, 0), (1, 7), (2, 9), (3, 2)]
    assert sorted((i or 0, t or "") for i, t in got if not t) == [(0, ""), (5, "")]

"""The fences of the quality rules follow their groups."""

import random

from tracewell.llm import quality_rules


def text(r, length, symbols=0, n=200):
    """``n`` words of about ``length`` characters, with ``symbols`` symbols."""
    words = ["".join(r.choices("abcdefghijklmnop", k=length + r.choice((-1, 0, 1)))) for _ in range(n)]
    for i in range(symbols):
        words[i] += "#"
    return " ".join(words)


def kept(spark, rows):
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "doc_id long, text string, lang string, source string")
    return {row.doc_id: row.kept for row in quality_rules.judge(frame).collect()}


def test_fences_move_with_their_group(spark):
    """The same texts are judged by what is usual in their group, above and below it."""
    r = random.Random(21)
    rows = [(text(r, 5), "aa", "x") for _ in range(220)] + [(text(r, 9, symbols=16), "bb", "x") for _ in range(220)]
    probes = [text(r, 5, symbols=16), text(r, 9), text(r, 5, symbols=24)]
    rows += [(t, lang, "x") for t in probes for lang in ("aa", "bb")]
    got = kept(spark, rows)
    assert all(got[i] for i in range(440))
    # many symbols and short words, long words, more symbols: in the group of short words, in the group of long ones
    assert [got[440 + i] for i in range(6)] == [False, False, False, True, False, False]
    # symbols alone, in groups of equal word length
    rows = [(text(r, 5), "aa", "x") for _ in range(220)] + [(text(r, 5, symbols=16), "bb", "x") for _ in range(220)]
    rows += [(text(r, 5, symbols=n), lang, "x") for n in (14, 24, 40) for lang in ("aa", "bb")]
    got = kept(spark, rows)
    assert [got[440 + i] for i in range(6)] == [False, True, False, True, False, False]


def test_no_row_count_flips_the_rule(spark):
    """A rare language of long words keeps its texts however few they are; a small group leans on its language alone."""
    r = random.Random(22)
    rows = [(text(r, 5), "aa", "x") for _ in range(400)]
    for lang, n in (("few", 30), ("under", 199), ("over", 200)):
        rows += [(text(r, 30, n=40), lang, "x") for _ in range(n)]
    rows += [(text(r, 5), "aa", "small"), (text(r, 30, n=40), "aa", "small"), (text(r, 30, n=40), None, None)]
    got = kept(spark, rows)
    assert [got[len(rows) - i] for i in (3, 2, 1)] == [True, False, True]
    assert all(got[i] for i in range(len(rows) - 3))


def test_fences_scale_with_their_group(spark):
    """Ten times as many of what a metric counts in a group moves its fence about tenfold: no number in a metric's unit decides."""
    r = random.Random(23)
    rates = [(r.randint(1, 60) if r.random() < 0.3 else 0, r.randint(1, 90) if r.random() < 0.2 else 0, r.randint(5, 200) if r.random() < 0.1 else 0, r.randint(400, 600)) for _ in range(6000)]
    columns = list(quality_rules.METRICS)
    rows = [(k, "s", *[v * scale if m != "word_length" else v for v, m in zip(row, columns, strict=True)]) for k, scale in (("one", 1), ("ten", 10)) for row in rates]
    found = {x.lang: x for x in quality_rules.fences(spark.createDataFrame(rows, f"lang string, source string, {', '.join(f'{m} long' for m in columns)}"), ["lang", "source"], prior_rows=5).collect()}
    for m in columns[:3]:
        assert 8 < found["ten"][f"{m}_high"] / found["one"][f"{m}_high"] < 11.5, m
    assert abs(found["ten"].word_length_high / found["one"].word_length_high - 1) < 0.05

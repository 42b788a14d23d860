"""Training texts are sampled all over, not at their start."""

from tracewell.llm import language_id


def test_sample_covers_whole_texts(spark):
    rows = [(i, "boiler " * 1000 + "body " * 4000 + "ending " * 1000, "aa") for i in range(20)] + [(50, "short text", "bb")]
    got = language_id.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got["bb"] == b"short text"
    assert all(got["aa"].count(w) > 100 for w in (b"boiler", b"body", b"ending"))
    assert got["aa"].count(b"body") > got["aa"].count(b"boiler")
    assert 20 * 2600 <= len(got["aa"]) <= 20 * 2900

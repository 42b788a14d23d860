"""The reader of loosely written objects: what it takes, what it leaves, and that JSON is read as JSON."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracewell.functions import tolerant
from tracewell.sources import files


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("noise {'a': True, b: None,} tail", {"a": True, "b": None}),
        ('<think>{"a": 0}</think>\n```json\n{"a": 2}\n```', {"a": 2}),
        ('<thinking>{"a": 0}</thinking>{"a": 5}<think>{"a": 1}', {"a": 5}),
        ('{"x": 1}\n{"a": 3}', {"a": 3}),
        ('{"a": 1} ```{"a": 2}```', {"a": 2}),
        ("“nothing”", None),
        (None, None),
        ("{", None),
        ("{" * 5000, None),
        ('{"a":' * 3000, None),
        ("{'a': 'it's, well, fine', 'b': [1, .5, -2e3, 'x',],}", {"a": "it's, well, fine", "b": [1, 0.5, -2000.0, "x"]}),
        ("{“a”: ‘b’, c-d: undefined}", {"a": "b", "c-d": None}),
        ('{"a": 1, // why\n /* and */ "b": 2}', {"a": 1, "b": 2}),
        ("function f() { return x } {a: 7}", {"a": 7}),
        ("{a: yes} {'x': 1}", {"x": 1}),
        (r"{'a': 'q\'q\né\ud83d'}", {"a": "q'q\né�"}),
        ("{1: 2, a: {b: {}}, }", {"1": 2, "a": {"b": {}}}),
        ("{a: 1]", None),
        ("{a: 1 b: 2}", None),
    ],
)
def test_chosen(text, want):
    assert tolerant.chosen(text, ("a",)) == want


@given(st.dictionaries(st.text(), st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=10)))
def test_json_is_read_as_json(value):
    assert tolerant.chosen(json.dumps(value)) == value


def test_column(spark):
    rows = spark.createDataFrame([(1, "so: {'k': 1, 'j': [None]}", "old"), (2, None, "old"), (3, "none", "old")], "id int, text string, object string")
    got = {x.id: x.object for x in files.json_objects(rows, "text", ("k",)).collect()}
    assert got == {1: '{"j": [null], "k": 1}', 2: None, 3: None}

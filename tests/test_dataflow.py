"""Flows across files against a plain fixpoint over the same facts, and the readers on small sources."""

import random

import pytest

from tracewell.functions import dataflow as readers
from tracewell.operators import dataflow

FILES = [
    ("a.py", "from b import clean\n@app.get('/x')\ndef show():\n    q = request.args['q']\n    w = clean(q)\n    run(w)\n    keep(q)\n    z = give()\n    os.system(z)\n"),
    ("b.py", "def clean(x):\n    return 'fixed'\ndef run(a, b=1):\n    c = a.strip()\n    inner(1, c)\ndef inner(n, v):\n    eval(v)\ndef keep(y):\n    return y\n"),
    ("c.py", "def give():\n    return input('?')\ndef first(x):\n    return second(x)\ndef second(x):\n    return first(x)\ndef both():\n    a = keep(request.form['n'])\n    b = keep('plain')\n    exec(b)\n    exec(a)\n"),
    ("d.js", "function pass(v) {\n  return v\n}\nconst go = (req) => {\n  const n = pass(req.query)\n  if (n) { db.execute('x' + n) }\n}\n"),
    ("e.php", "<?php\nfunction shown($a) { return $a; }\n$v = shown($_GET['a']);\nsystem($v);\n"),
    ("f.py", "def twice():\n    pass\ndef twice():\n    pass\ntext = str(input())\nos.popen(text.upper())\n"),
    ("g.sql", "SELECT 1"), ("h.py", ""), ("i.py", None), (None, "x = input()"),
]


def plain(rows):
    """All flows by going round until nothing is new."""
    names = {}
    for p, f, _, k, n, *_ in rows:
        if k == "function":
            names.setdefault((p, n), []).append((p, f))
            names.setdefault(n, []).append((p, f))
    meant = {(p, f, s): next((c[0] for c in (names.get((p, n), []), names.get(n, [])) if len(c) == 1), None) for p, f, _, k, n, _, s, _ in rows if k == "call"}
    params = {(p, f, slot): n for p, f, _, k, n, _, _, slot in rows if k == "param"}
    holds = {(p, f, ("param", f, p, slot), n) for (p, f, slot), n in params.items()} | {(p, f, ("input", p, line), n) for p, f, line, k, n, *_ in rows if k == "input"}
    gives, hits = set(), set()
    while True:
        before = len(holds), len(gives), len(hits)
        at = {}
        for p, f, o, n in holds:
            at.setdefault((p, f, n), set()).add(o)
        for p, f, line, k, n, used, site, slot in rows:
            origins = at.get((p, f, used), set())
            if k == "assign":
                holds |= {(p, f, o, n) for o in origins}
            elif k == "return":
                gives |= {(p, f, o) for o in origins}
            elif k == "sink":
                hits |= {(p, f, o, (p, line, n)) for o in origins}
            elif k == "arg":
                callee = meant[p, f, site]
                if callee is None:
                    holds |= {(p, f, o, f"<call {site}>") for o in origins}
                elif slot >= 0:
                    own = ("param", callee[1], callee[0], slot)
                    if (*callee, own) in gives:
                        holds |= {(p, f, o, f"<call {site}>") for o in origins}
                    hits |= {(p, f, o, s) for o in origins for a, b, x, s in list(hits) if (a, b) == callee and x == own}
            elif k == "call" and meant[p, f, site]:
                holds |= {(p, f, o, f"<call {site}>") for a, b, o in gives if (a, b) == meant[p, f, site] and o[0] == "input"}
        if before == (len(holds), len(gives), len(hits)):
            return {(o[1], o[2], *s) for _, _, o, s in hits if o[0] == "input"}


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(x) for x in readers.facts(spark.createDataFrame(FILES, "path string, content string")).collect()]


def test_small_sources(spark, rows):
    got = {tuple(x) for x in dataflow.flows(spark.createDataFrame(rows, readers.SCHEMA)).collect()}
    assert got == plain(rows)
    assert got == {
        ("c.py", 2, "a.py", 9, "process_execution"), ("c.py", 8, "c.py", 11, "code_execution"), ("d.js", 5, "d.js", 6, "query"), ("e.php", 3, "e.php", 4, "process_execution"), ("f.py", 5, "f.py", 6, "process_execution"),
    }  # fmt: skip  q is cleaned, keep(q) goes nowhere, and exec(b) does not hear of a


def test_spans(rows):
    spans = {(p, n): (line, slot) for p, _, line, k, n, _, _, slot in rows if k == "function"}
    assert spans["b.py", "run"] == (3, 5) and spans["d.js", "go"] == (4, 7) and spans["a.py", "show"] == (3, 9)


def test_through_cleaning(spark):
    """The same call with and without what cleans: only one is a flow, three files on."""
    files = [("m.py", "def top():\n    a(input())\ndef side():\n    b(input())\n"), ("n.py", "def a(x):\n    b('no')\n    k = x\n    c(k)\ndef b(x):\n    y = len\n"), ("o.py", "def c(x):\n    os.system(x)\n")]
    got = dataflow.flows(readers.facts(spark.createDataFrame(files, "path string, content string"))).collect()
    assert [tuple(x) for x in got] == [("m.py", 2, "o.py", 2, "process_execution")]


def test_random_programs(spark):
    """Random calls between random functions, cycles included, against the plain fixpoint."""
    r = random.Random(71)
    files = []
    for i in range(12):
        body = [f"def f{i}(x, y):"]
        for k in range(r.randint(2, 5)):
            body.append("    " + r.choice([f"v{k} = x", f"v{k} = f{r.randrange(14)}(y, x)", f"v{k} = 'no'", "v0 = request.args['a']", f"eval({r.choice('xy')})", f"f{r.randrange(12)}(v{max(0, k - 1)}, y)", f"os.system(v{max(0, k - 1)})"]))
        body.append(f"    return {r.choice(['x', 'y', 'v0', 'v1', 'f3(x, y)'])}")
        files.append((f"p{i % 5}/f{i}.py", "\n".join(body) + "\n"))
    found = readers.facts(spark.createDataFrame(files, "path string, content string")).collect()
    want = plain([tuple(x) for x in found])
    got = {tuple(x) for x in dataflow.flows(spark.createDataFrame(found, readers.SCHEMA)).collect()}
    assert got == want and len(want) >= 4
    assert dataflow.flows(spark.createDataFrame([], readers.SCHEMA)).count() == 0


def test_direct_facts_give_the_same_flows_in_fewer_rounds(spark, monkeypatch):
    """Assignments followed while a file is read: names set in turns, in circles and from calls; a chain of files takes about half the rounds."""
    chain = [(f"s{k}.py", f"def step_{k}(x):\n    y = x + 'a'\n    w = y\n    y = w\n    z = step_{k + 1}(y)\n    x = z\n    return z\n") for k in range(6)] + [("s6.py", "def step_6(x):\n    y = x\n    os.system(y)\n    return y\n"), ("m.py", "def show():\n    q = request.args['q']\n    r = step_0(q)\n    eval(r)\n")]
    files = spark.createDataFrame([f for f in FILES if f[0]] + chain, "path string, content string")
    rounds, add = [], dataflow.Pile.add
    monkeypatch.setattr(dataflow.Pile, "add", lambda self, rows: rounds.append(self) or add(self, rows))
    got, counts = [], []
    for direct in (False, True):
        facts = readers.facts(files, direct=direct)
        assert facts.where("kind = 'assign'").isEmpty() == direct
        rounds.clear()
        got.append({tuple(r) for r in dataflow.flows(facts).collect()})
        counts.append(len(rounds))
    assert got[0] == got[1] == plain([tuple(r) for r in readers.facts(files).collect()]) and ("m.py", 2, "s6.py", 3, "process_execution") in got[1]
    assert counts[1] < 0.7 * counts[0]


def test_groups_of_files_give_the_same_flows(spark, rows, monkeypatch):
    """Files that call one another are followed in one task: small sources, a line of 40 files, two scripts of one path, and random programs; no rounds."""
    r = random.Random(72)
    files = [(f"s{k}.py", f"def step_{k}(x):\n    return step_{k + 1}(x)\n") for k in range(40)] + [("s40.py", "def step_40(x):\n    eval(x)\n    return x\n"), ("m.py", "def show():\n    os.system(step_0(request.args['q']))\n")]
    files += [("w.js", "f(location.search)\n"), ("w.js", "f(req.query)\n"), ("v.js", "function f(x) { eval(x) }\n")]
    for i in range(30):
        body = [f"def r{i}(x, y):"] + ["    " + r.choice([f"v{k} = r{r.randrange(32)}(y, x)", f"v{k} = x", "v0 = input()", f"eval({r.choice('xy')})", f"r{r.randrange(30)}(v{max(0, k - 1)}, y)", f"os.system(v{max(0, k - 1)})"]) for k in range(4)]
        files.append((f"r{i % 9}.py" if i < 20 else f"q{i}.py", "\n".join([*body, f"    return {r.choice(['x', 'v0', 'v2'])}", ""])))
    facts = rows + [tuple(x) for x in readers.facts(spark.createDataFrame(files, "path string, content string")).collect()]
    frame = spark.createDataFrame(facts, readers.SCHEMA)
    want = {tuple(x) for x in dataflow.flows(frame).collect()}
    added, add = [], dataflow.Pile.add
    monkeypatch.setattr(dataflow.Pile, "add", lambda self, rows: added.append(self) or add(self, rows))
    got = [tuple(x) for x in dataflow.flows_apart(frame).collect()]
    assert set(got) == want and len(got) == len(want) > 10 and not added
    monkeypatch.setattr(dataflow, "ROWS_A_GROUP", 40)
    assert sorted(tuple(x) for x in dataflow.flows_apart(frame).collect()) == sorted(got) and added
    assert dataflow.flows_apart(spark.createDataFrame([], readers.SCHEMA)).count() == 0


def test_the_query_goes_without_rounds(spark, monkeypatch):
    from tracewell.plans.catalog import QUERIES

    monkeypatch.setattr(dataflow, "Pile", None)
    assert QUERIES["q_flows_across_files"](spark, "/root/testdata/sf0.001").count() > 0


def test_facts_of_some_kinds(spark, rows):
    got = readers.facts(spark.createDataFrame(FILES, "path string, content string"), kinds=("function", "call")).collect()
    assert sorted((tuple(x) for x in got), key=repr) == sorted((x for x in rows if x[3] in ("function", "call")), key=repr) and len(got) < len(rows)

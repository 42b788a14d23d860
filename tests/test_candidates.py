"""Capabilities by the automaton against a search line by line, their judgement, and candidates with keys and stable ids."""

import random
import re

import pytest

from tracewell.functions import capabilities as found_in
from tracewell.functions import dataflow
from tracewell.operators import candidates

LITERALS = [(category, word) for category, words in found_in.CATEGORIES.items() for word in words.split()]


def plain(path, text):
    """Every literal tried on every line by an expression of its own; a capital that becomes two characters stays."""
    out, text = set(), "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip().startswith(("#", "//")):
            continue
        for category, word in LITERALS:
            key = word.removesuffix("(")
            before = r"(?<![^\W])" if key[0].isalnum() else ""
            after = r"[ \t]*\(" if word.endswith("(") else r"(?![^\W])" if key[-1].isalnum() else ""
            if re.search(before + re.escape(key) + after, line):
                out.add((path, n, category))
    return out


def test_categories():
    assert len(found_in.CATEGORIES) == 13 and all(w == w.lower() for _, w in LITERALS)


def test_capabilities_against_single_expressions(spark):
    r = random.Random(81)
    pieces = [w for _, w in LITERALS] + [w.upper() for _, w in LITERALS[::3]] + ["x", "_", ".", " ", "(", "(a)", "\n", "\n# ", "\n// ", "\n    ", "é", "İ", "plain words ", "un", "9"]
    files = [(f"f{i}.py", "".join(r.choices(pieces, k=40))) for i in range(60)] + [("empty.py", ""), ("null.py", None), (None, "os.system(x)"), ("long.py", "y" * 100_000 + " os.system(x)\n" * 3)]
    got = found_in.capabilities(spark.createDataFrame(files, "path string, content string")).collect()
    want = set().union(*[plain(p, t) for p, t in files if p and t])
    assert {(x.path, x.line, x.category) for x in got} == want and len(got) == len(want) > 300
    assert found_in.capabilities(spark.createDataFrame([], "path string, content string")).count() == 0


@pytest.mark.parametrize(
    ("path", "text", "entry", "want"),
    [
        ("a.py", "os.system(x)", None, ("high", 0.71, [])),
        ("admin/a.py", "requests.get(u)", None, ("medium", 0.72, ["control_plane", "external_dependency"])),
        ("a.py", "requests.get(u)", None, ("low", 0.66, ["external_dependency"])),
        ("a.py", "p.read_text()", "GET /x", ("medium", 0.74, ["entry_reachable"])),
        ("admin/a.py", "p.read_text()\nid = 1", "GET /x", ("high", 0.8, ["control_plane", "entry_reachable", "object_boundary"])),
        ("a.py", "fs.writeFile(upload)", "GET /x", ("high", 0.85, ["entry_reachable", "file_lifecycle", "upload_persistence"])),
        ("a.py", "k = os.environ['secret']", "GET /x", ("high", 0.74, ["entry_reachable"])),
        ("a.py", "k = getenv('HOME')", "GET /x", ("medium", 0.74, ["entry_reachable"])),
        ("a.py", "findById(x)", None, ("unknown", 0.66, [])),
    ],
)
def test_judgement(spark, path, text, entry, want):
    found = found_in.capabilities(spark.createDataFrame([(path, text)], "path string, content string"))
    row = found_in.judged(found, spark.createDataFrame([(path, entry), (path, None)], "path string, entry string")).first()
    assert (row.risk, row.confidence, sorted(row.tags)) == want


def test_candidates(spark):
    routes = spark.createDataFrame([("a.py", 3, "GET /x"), ("a.py", 9, "GET /x"), ("a.py", 5, "POST /y")], "path string, line int, name string")
    files = [("web/p.php", "<?php\nsystem($_GET['a']);\n"), ("lib/q.php", "<?php\nfunction f($a) { return system($a); }\n"), ("pages/1.js", "go()\n"), ("src/2.js", "go()\n"), ("a.py", "go()\n")]
    facts = dataflow.facts(spark.createDataFrame(files, "path string, content string"))
    scripts = candidates.web_scripts(facts)
    assert {x.path for x in scripts.collect()} == {"web/p.php", "pages/1.js"}
    flows = spark.createDataFrame([("a.py", 4, "b.py", 7, "query"), ("a.py", 8, "b.py", 7, "query"), ("z.py", 1, "b.py", 7, "query"), ("web/p.php", 2, "web/p.php", 2, "odd")], "source_path string, source_line int, sink_path string, sink_line int, category string")
    able = spark.createDataFrame([("b.py", 7, "process_execution", "GET /x", "high"), ("b.py", 8, "file_read", None, "medium")], "path string, line int, category string, entry string, risk string")
    got = candidates.candidates(routes, scripts, flows, able)
    assert sorted(((x.kind, x.path, x.line, x.entry_point, x.severity) for x in got.collect()), key=repr) == [
        ("capability_chain", "b.py", 7, "GET /x", "high"), ("data_flow", "b.py", 7, "GET /x", "high"), ("data_flow", "b.py", 7, None, "high"), ("data_flow", "web/p.php", 2, "/web/p.php", "unknown"),
        ("entrypoint", "a.py", 3, "GET /x", "unknown"), ("entrypoint", "a.py", 5, "POST /y", "unknown"), ("web_entrypoint", "pages/1.js", 1, "/pages/1.js", "unknown"), ("web_entrypoint", "web/p.php", 1, "/web/p.php", "unknown"),
    ]
    moved = candidates.candidates(routes.withColumn("line", routes["line"] + 20), scripts, flows.limit(0), able)
    ids = {x.candidate_id for x in got.where("kind = 'entrypoint'").collect()}
    assert ids == {x.candidate_id for x in moved.where("kind = 'entrypoint'").collect()} and len(ids) == 2
    known = got.where("kind = 'entrypoint'").selectExpr("candidate_id", "kind", "path", "'confirmed' AS status")
    after = {x.candidate_id: x.status for x in candidates.renewed(known, got).collect()}
    assert len(after) == got.count() and {after[i] for i in ids} == {"confirmed"} and set(after.values()) == {"confirmed", "candidate"}
    assert candidates.candidates(routes.limit(0), scripts.limit(0), flows.limit(0), able.limit(0)).count() == 0

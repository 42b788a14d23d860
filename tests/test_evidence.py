"""References to lines against plain Python; a delta against the whole."""

import random

from tracewell.operators import evidence

NODE = "id long, confidence double, evidence array<string>, status string, review_status string, revision int"
FILE = "path string, content string, is_binary boolean"
MUTE = {"", "<?php", "?>", "{", "}", ";"}


def says(line):
    line = line.strip()
    return not (line in MUTE or line.lower().startswith(("//", "<!--", "/*")) or line.lower() in ("<div>", "</body>", "<br/>"))


def holds(refs, files):
    out = []
    for ref in refs:
        path, _, line = (ref or "").rpartition(":")
        path = path.removeprefix("./")
        if not path or not line.isdigit() or path not in files or files[path] is None:
            continue
        lines = files[path].split("\n")
        at = int(line)
        if 1 <= at <= len(lines) and says(lines[at - 1]) and f"{path}:{at}" not in out:
            out.append(f"{path}:{at}")
    return out


def table_of(spark, files):
    return spark.createDataFrame([(p, c, False) for p, c in files.items()] + [("bin", "a\nb", True)], FILE)


def as_dict(df):
    return {r.id: (r.evidence, r.confidence, r.status, r.review_status, r.revision) for r in df.collect()}


def test_references_and_deltas(spark):
    rng = random.Random(5)
    lines = ["x = 1", "", "  {", "// note", "<div>", "call();", "</BODY>", "<br/>", "?>", "é := 2\r", "<p>"]
    files = {f"f{i}": "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6))) for i in range(30)} | {"none": None}
    refs = lambda: [rng.choice(["", "./"]) + f"{rng.choice([*files, 'gone'])}:{rng.randint(0, 8)}" for _ in range(rng.randint(0, 5))]
    nodes = [(i, rng.choice([0.2, 0.88, 1.0, None]), refs() + rng.choice([[], ["bin:1", "no place", None]]), "unverified", rng.choice(["covered", "open", None]), 1) for i in range(200)] + [(200, 0.5, None, None, None, None)]
    state = evidence.reconcile(spark.createDataFrame(nodes, NODE), table_of(spark, files))
    got = as_dict(state)
    cap = [0.35, 0.82, 0.9, 0.94]
    for id, confidence, given, status, review, revision in nodes:
        want = holds(given or [], files)
        sure = min(confidence or 0.0, cap[min(len(want), 3)])
        then = "investigating" if review == "covered" and not want else review
        new = "source_backed" if want else "unverified"
        changed = (want, sure, new, then) != (given, confidence, status, review)
        assert got[id] == (want, sure, new, then, (revision or 0) + changed)
    after = files | {"f1": None, "f2": "{\n" + (files["f2"] or ""), "f3": "", "f4": "a\nb\nc"}
    state = state.drop("updated", "reopened", "dropped")
    changed = table_of(spark, {p: after[p] for p in ("f1", "f2", "f3", "f4")}).where("path <> 'bin'")
    assert as_dict(evidence.reconcile_changes(state, changed, changed)) == as_dict(evidence.reconcile(state, table_of(spark, after)))


def test_merging_finds(spark):
    nodes = spark.createDataFrame([(1, 0.5, ["a:1"], "source_backed", "covered", 3), (2, None, None, None, None, None)], NODE)
    found = spark.createDataFrame([(1, 0.9, ["b:2", "a:1"]), (1, 0.4, ["a:0", None]), (3, 0.3, None), (None, 1.0, ["x:1"])], "id long, confidence double, evidence array<string>")
    assert as_dict(evidence.merge(nodes, found)) == {
        1: (["a:1", "a:0", "b:2"], 0.9, "source_backed", "covered", 4),
        2: ([], None, "unverified", None, 0),
        3: ([], 0.3, "unverified", "candidate", 1),
    }


def test_no_nodes(spark):
    nodes, files = spark.createDataFrame([], NODE), spark.createDataFrame([], FILE)
    assert evidence.reconcile_changes(nodes, files, files).count() == 0
    assert evidence.merge(nodes, nodes).count() == 0

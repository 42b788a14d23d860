"""Imports resolved to files against a plain reading of the rule, with tails that many files share."""

import random

from tracewell.operators import symbols

ENDINGS = (".py", ".js", ".ts", ".go", ".rs", ".java", "/__init__.py", "/index.js", "/index.ts")


def plain(imports, paths):
    out = set()
    for source, module in imports:
        near = module.startswith("./")
        bare = module.removeprefix("./")
        folder = source.rpartition("/")[0]
        stem = "/".join(x for x in (folder, bare) if x) if near else bare.replace("::", "/").replace(".", "/").replace("\\", "/")
        for end in ENDINGS:
            met = {p for p in paths if p != source and (p == stem + end or not near and p.endswith("/" + stem + end))}
            if met:
                if len(met) == 1:
                    out.add((source, module, met.pop()))
                break
    return out


def test_against_the_rule(spark):
    r = random.Random(9)
    name = lambda: r.choice("abc")
    paths = sorted({"/".join([*(name() for _ in range(r.randrange(3))), name() + r.choice(ENDINGS)]) for _ in range(60)} | {"__init__.py", "a/index.ts/b.py", "no.txt"})
    imports = sorted({(r.choice(paths), r.choice(["", "", "./"]) + r.choice([".", "/", "::"]).join(name() for _ in range(r.randint(1, 3)))) for _ in range(400)})
    found = spark.createDataFrame([(p, 1, "import", m, None) for p, m in imports], "path string, line int, kind string, name string, detail string")
    files = spark.createDataFrame([(p,) for p in paths + paths[:9]], "path string")
    got = [tuple(x) for x in symbols.resolve_imports(found, files).select("from_path", "module", "to_path").collect()]
    want = plain(imports, paths)
    assert set(got) == want and len(got) == len(want) > 20


def test_no_row_for_each_ending(spark):
    """9,000 files that end alike make one row, and an import is asked once: it took a row for each of nine endings before."""
    files = spark.range(9000).selectExpr("concat('o', id, '/main.py') as path")
    found = spark.createDataFrame([("o1/main.py", 1, "import", "main", None)], "path string, line int, kind string, name string, detail string")
    assert symbols.resolve_imports(found, files).count() == 0
    assert symbols.resolve_imports(found, files.where("path in ('o1/main.py', 'o2/main.py')")).collect()[0].to_path == "o2/main.py"

"""Readers of program text, file sources and loosely written JSON."""

import hashlib
import zipfile

import pytest

from tracewell.functions import lines
from tracewell.operators import symbols
from tracewell.sources import files

from .program_sources import MANIFESTS, REPORTS, SOURCES


@pytest.fixture(scope="module")
def found(spark):
    return lines.extract(spark.createDataFrame(SOURCES, "path string, content string")).cache()


def of(found, kind, path):
    return sorted((x.line, x.name, x.detail) for x in found.where(f"kind = '{kind}' and path = '{path}'").collect())


def test_declarations(found):
    assert of(found, "class", "app/orders.py") == [(4, "Base", None), (7, "Orders", None)]
    assert of(found, "function", "app/orders.py") == [(8, "total", "Orders"), (14, "listing", None)]
    assert of(found, "function", "app/util.py") == [(1, "clean", None)]  # not what a comment or a string says
    assert of(found, "function", "cmd/main.go") == [(4, "Run", "Server"), (5, "main", None)]
    assert [x[1] for x in of(found, "function", "web/server.js")] == ["start", "user"]
    assert of(found, "class", "src/Users.java") == [(2, "Users", None)]
    assert of(found, "base", "src/ItemsController.cs") == [(2, "ItemsController", "Base")]


def test_routes_tables_and_risks(found):
    routes = {path: sorted(x[1] for x in of(found, "route", path)) for path, _ in SOURCES}
    assert routes["app/orders.py"] == ["GET /v1/orders"]
    assert routes["web/server.js"] == ["GET /api/items", "GET /both", "POST /both", "POST /login"]
    assert routes["web/cats.ts"] == ["GET /cats/:id"] and routes["cmd/main.go"] == ["GET /v1/ping"]
    assert routes["src/lib.rs"] == ["GET /health", "POST /t"] and routes["src/Users.java"] == ["GET /users/{id}"]
    assert routes["src/ItemsController.cs"] == ["GET /api/items/{id}"] and routes["routes/web.php"] == ["GET /admin/users"]
    assert routes["config/routes.rb"] == ["DELETE /photos/:id", "GET /about", "GET /photos", "GET /photos/:id", "POST /photos", "PUT /photos/:id"]
    assert len(routes["views/urls.py"]) == 8 and "ANY /shop" in routes["views/urls.py"]
    assert [x[1] for x in of(found, "data", "db/schema.sql")] == ["orders", "items"]
    assert {x[1] for x in of(found, "data", "app/orders.py")} == {"orders", "items"}
    assert of(found, "risk", "web/server.js") == [(7, "eval", None)] and of(found, "risk", "app/orders.py") == [(18, "system", "os")]


def test_relations(spark, found):
    edges = {(x.from_path, x.to_path, x.relation) for x in symbols.relationships(found).collect()}
    assert ("app/orders.py", "app/util.py", "calls") in edges and ("app/orders.py", "data:orders", "uses") in edges and ("db/schema.sql", "data:orders", "uses") in edges
    paths = spark.createDataFrame([(p,) for p, _ in SOURCES], "path string")
    assert {(x.from_path, x.to_path) for x in symbols.resolve_imports(found, paths).collect()} == {("app/orders.py", "app/store.py"), ("app/orders.py", "app/util.py"), ("web/server.js", "web/auth.js")}
    more = spark.createDataFrame([("a/x.py", "import m\n"), ("p/m.py", ""), ("q/m.py", "")], "path string, content string")
    assert symbols.resolve_imports(lines.extract(more), more.select("path")).count() == 0  # two files: ambiguous


def test_odd_files(spark):
    odd = spark.createDataFrame([(None, "def f(): pass"), ("a.py", None), ("b.py", ""), ("c.xyz", "def f(): pass"), ("d.py", "def (\n'''open\n" + "(" * 2000), ("e.js", "x" * 200_000)], "path string, content string")
    assert {x.path for x in lines.extract(odd).collect()} <= {"d.py"}
    assert lines.extract(odd.where("false")).count() == 0


def test_flows(spark):
    rows = [(x.path, x.source_line, x.sink_line, x.variable) for x in symbols.flows(spark.createDataFrame(SOURCES, "path string, content string")).collect()]
    assert rows == [("app/orders.py", 15, 18, "text")]
    far = "name = request.args\n" + "\n" * 100 + "eval(name)\n"
    assert symbols.flows(spark.createDataFrame([("a.py", far)], "path string, content string")).count() == 0


def test_tree_and_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "sub" / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "sub" / "big.md").write_text("y" * 500)
    got = {x.path: (x.size, x.sha256, x.language, x.is_binary) for x in files.tree(spark, str(tmp_path), 400).collect()}
    assert got == {"a.py": (6, hashlib.sha256(b"x = 1\n").hexdigest(), "python", False), "sub/b.bin": (3, hashlib.sha256(b"a\0b").hexdigest(), "unknown", True)}
    tree = files.tree(spark, str(tmp_path))
    assert files.manifest_digest(tree).collect() == files.manifest_digest(tree.repartition(3)).collect() != files.manifest_digest(tree.where("size < 10")).collect()
    (tmp_path / "bad.txt").write_bytes(b"a\xffb")
    assert {x.content for x in files.texts(spark, str(tmp_path / "bad.txt")).collect()} == {"a�b"}
    zips = tmp_path / "zips"
    zips.mkdir()
    with zipfile.ZipFile(zips / "one.zip", "w") as z:
        for name in ("ok.txt", "../out.txt", "/abs.txt", "dir/ok.txt"):
            z.writestr(name, name)
    (zips / "broken.zip").write_bytes(b"no archive")
    rows = {(x.path, x.problem): x.content for x in files.archives(spark, str(zips)).collect()}
    assert {k for k, v in rows.items() if v is None} == {("../out.txt", "unsafe"), ("/abs.txt", "unsafe"), (None, "broken")}
    assert bytes(rows["ok.txt", None]) == b"ok.txt" and len(rows) == 5


def test_constants_of_other_files(spark):
    files_ = [
        ("a.js", "export const SHOP = '/shop'\nconst ONE = '/one'\nconst TAIL = 'x'\n"), ("b.js", "const ONE = '/two'\n"),
        ("c.js", "app.get(SHOP + '/cart', f)\napp.post('/v1/' + TAIL, f)\napp.put('/v2/' + gone, f)\napp.patch(ONE + '/y', f)\ncache.get(TAIL)\napp.all(SHOP, f); app.get(SHOP + '/cart', g)\napp.get('/z/' + f(1), g)\n"),
    ]
    found = lines.extract(spark.createDataFrame(files_, "path string, content string"))
    got = symbols.folded_routes(found)
    assert of(got, "route", "c.js") == [
        (1, "GET /shop/cart", "folded"), (2, "POST /v1/x", "folded"), (3, "PUT /v2", "call"), (6, "ANY /shop", "folded"), (6, "GET /shop/cart", "folded"), (7, "GET /z", "call"),
    ]
    assert of(got, "route", "b.js") == [] and got.where("kind = 'open-route'").count() == 0
    assert got.where("kind <> 'route'").count() == found.where("kind not in ('route', 'open-route')").count()
    assert symbols.folded_routes(found.where("false")).count() == 0


def test_reports_and_manifests(spark):
    got = {(x.tool, x.rule, x.path, x.severity) for x in files.tool_findings(spark.createDataFrame(REPORTS, "tool string, report string")).collect()}
    assert got == {("bandit", "B1", "y.py", "low"), ("gitleaks", "key", "k.txt", "high"), ("osv", "O-1", "p.lock", "unknown"), ("osv", "O-2", "p.lock", "unknown"), ("semgrep", "a.b", "x.py", "error"), ("trivy", "V-1", "go.mod", "high")}
    found = {(x.path, x.dependency) for x in files.dependencies(spark.createDataFrame(MANIFESTS, "path string, content string")).collect()}
    assert found == {("package.json", "left"), ("package.json", "right"), ("package.json", "test"), ("requirements-dev.txt", "alpha"), ("requirements-dev.txt", "beta"), ("go.mod", "host.org/x/y"), ("Cargo.toml", "serde"), ("sub/pom.xml", "core"), ("Gemfile", "rails")}


def test_lines_of_files_that_hold_a_flow(spark, monkeypatch):
    """Only paths that take an input and make a risky call are cut into lines; parts of one path count together."""
    seen, numbered = [], symbols.numbered
    monkeypatch.setattr(symbols, "numbered", lambda files: seen.append({r.path for r in files.collect()}) or numbered(files))
    files = [("a.py", "q = request.args['q']\neval(q)\n"), ("b.py", "q = request.args['q']\n"), ("c.py", "eval(q)\n"), ("d.js", "q = request.query\n"), ("d.js", "\neval(q)\n"), ("e.py", None)]
    got = symbols.flows(spark.createDataFrame(files, "path string, content string")).collect()
    assert {tuple(r) for r in got} == {("a.py", 1, 2, "q"), ("d.js", 1, 2, "q")} and seen == [{"a.py", "d.js"}]


def test_flows_of_any_number_of_steps(spark):
    """Names spread as far as assignments go; a name is only taken from lines before, and an input 80 lines back is out of reach."""
    import random
    import re

    chain = "a0 = request.args\n" + "".join(f"a{i} = a{i - 1} + 'x'\n" for i in range(1, 30)) + "eval(a29)\n"
    r = random.Random(6)
    names = "abcdefgh"
    mixed = []
    for k in range(30):
        lines_ = []
        for _ in range(120):
            a, b, c = (r.choice(names) for _ in range(3))
            lines_.append(r.choice([f"{a} = {b} + {c}", f"{a} = {b}", f"{a} = 1", "", f"{a} = input", f"eval({a})"][: 4 if r.random() < 0.9 else 6]))
        mixed.append((f"m{k}.py", "\n".join(lines_)))
    files = [("chain.py", chain), *mixed, (None, chain)]
    want = set()
    for path, text in files[:-1]:
        held = set()  # (name, source line)
        for at, line in enumerate(text.split("\n"), 1):
            if sink := re.match(r"eval\((\w+)", line):
                want |= {(path, s, at, n) for n, s in held if n == sink[1] and at - s <= 80}
            elif given := re.match(r"(\w+) = (.*)", line):
                used = set(re.findall(r"\w+", given[2]))
                held |= {(given[1], s) for n, s in held if n in used} | ({(given[1], at)} if "input" in used or "request" in used else set())
    got = symbols.flows(spark.createDataFrame(files, "path string, content string")).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) and ("chain.py", 1, 31, "a29") in want


def test_hits_do_not_pass_through_the_driver(spark):
    """Many stored hits take little room as a file, which let Spark hand all of them to the driver: no table is broadcast."""
    from tracewell.operators import spans
    from tracewell.session import kept

    hits = kept(spark.range(2000).selectExpr("format_string('orders/o%d/main.py', id) as path", "5 as line"), "hits")
    texts = kept(spark.range(2000).selectExpr("format_string('orders/o%d/main.py', id) as path", "'a\nb\nc\nd\ne\nf' as content"), "texts")
    frames = spans.line_frames(symbols.numbered(texts), hits, 2)
    assert {x.excerpt for x in frames.collect()} == {"3: c\n4: d\n5: e\n6: f"}
    assert "Broadcast" not in frames._jdf.queryExecution().executedPlan().toString()

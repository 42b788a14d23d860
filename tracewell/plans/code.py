"""Registered queries over program text, reports and graphs, and the stream of leases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines, scalars
from ..operators import graphs, rows, spans, symbols
from ..session import kept
from ..sources import files, tables
from ..sources.tables import EDGES_SQL, HUBS_SQL, STEPS_SQL, table
from ..streaming import leases
from .candidates import texts
from .catalog import query

#: The orders' programs: o, first step, whether urgent; and each step with the one behind it.
_PROGRAM_SQL = f"""s AS (SELECT *, lead(k) OVER (PARTITION BY o ORDER BY k) AS next FROM ({STEPS_SQL})), m AS (SELECT o_orderkey AS o, o_orderpriority = '1-URGENT' AS urgent, first FROM orders LEFT JOIN (SELECT o, min(k) AS first FROM s GROUP BY o) ON o = o_orderkey),
a AS (SELECT 'orders/o' || o || '/step' || k || '.py' AS path, * FROM s), b AS (SELECT 'orders/o' || o || '/main.py' AS path, * FROM m), j AS (SELECT 'pages/' || page_id || '.js' AS path, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS js FROM pages)"""


@query(f"""WITH {_PROGRAM_SQL} SELECT path, 1 AS line, 'function' AS kind, 'step_' || o || '_' || k AS name, NULL AS detail FROM a
UNION ALL SELECT path, 2, 'constant', 'y', 'fixed' FROM a WHERE NOT passes UNION ALL SELECT path, 3, unnest(['call', 'risk']), 'system', 'os' FROM a WHERE flag = 'R' UNION ALL SELECT path, CASE flag WHEN 'R' THEN 4 ELSE 3 END, 'call', 'step_' || o || '_' || next, NULL FROM a WHERE next IS NOT NULL
UNION ALL SELECT path, CASE flag WHEN 'R' THEN 6 ELSE 5 END, 'import', 'orders.o' || o || '.step' || next, NULL FROM a WHERE next IS NOT NULL
UNION ALL SELECT path, 1, 'call', 'get', 'app' FROM b UNION ALL SELECT path, 1, 'route', 'GET /orders/' || o, 'decorator' FROM b UNION ALL SELECT path, 2, 'function', 'show_' || o, NULL FROM b
UNION ALL SELECT path, 4, 'call', 'step_' || o || '_' || first, NULL FROM b WHERE first IS NOT NULL UNION ALL SELECT path, 5, unnest(['call', 'risk']), 'eval', NULL FROM b WHERE urgent
UNION ALL SELECT path, CASE WHEN urgent THEN 7 ELSE 6 END, 'import', 'orders.o' || o || '.step' || first, NULL FROM b WHERE first IS NOT NULL
UNION ALL SELECT path, 1, 'call', 'track', NULL FROM j WHERE contains(js, 'track(') UNION ALL SELECT path, 1, 'constant', 't', '</p>' FROM j WHERE contains(js, 'var t="</p>"')""")
def q_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations, imports, calls, routes, tables and risky calls of the orders' programs and of the pages' scripts; constants of other files are folded into routes."""
    return symbols.folded_routes(kept(lines.extract(texts(spark, sf)), "found"))


@query(f"""WITH {_PROGRAM_SQL} SELECT path AS from_path, 'orders/o' || o || '/step' || x || '.py' AS to_path, 'calls' AS relation, 'step_' || o || '_' || x AS name, 0.8::DOUBLE AS confidence
FROM (SELECT path, o, next AS x FROM a UNION ALL SELECT path, o, first FROM b) WHERE x IS NOT NULL""")
def q_call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, handlers and bases joined to the one declaration of their name; names declared more than once link nothing."""
    return symbols.relationships(kept(lines.extract(texts(spark, sf), readers=(lines.declarations, lines.calls, lines.tables, lines.inherits)), "found"))


@query(f"""WITH {_PROGRAM_SQL} SELECT path AS from_path, 'orders.o' || o || '.step' || x AS module, 'orders/o' || o || '/step' || x || '.py' AS to_path FROM (SELECT path, o, next AS x FROM a UNION ALL SELECT path, o, first FROM b) WHERE x IS NOT NULL""")
def q_import_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Imports resolved to files; ambiguous ones to none."""
    src = texts(spark, sf)
    return symbols.resolve_imports(lines.extract(src, readers=(lines.imports,)), src.select("path"))


@query(f"""WITH {_PROGRAM_SQL} SELECT path, 3 AS source_line, 5 AS sink_line, 'r' AS variable, concat_ws(chr(10), '3:     q = request.args[''q'']', '4:     r = ' || coalesce('step_' || o || '_' || first || '(q)', 'q'), '5:     eval(r)', '6:     return r',
 '7: ' || coalesce('from orders.o' || o || '.step' || first || ' import step_' || o || '_' || first, '')) AS excerpt FROM b WHERE urgent""")
def q_extract_literals(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs, what is made from them, and the risky calls within 80 lines that take it, with the lines around."""
    held = kept(symbols.flow_files(kept(texts(spark, sf), "texts")), "flow-files")
    lines_of = symbols.numbered(held)  # lines of files without a flow are in no frame
    found = kept(symbols.followed(lines_of), "literal-flows")
    frames = spans.line_frames(lines_of, found.select("path", F.col("sink_line").alias("line")), 2)
    return found.hint("merge").join(frames.withColumnRenamed("hit", "sink_line"), ["path", "sink_line"], "left")


@query("""SELECT page_id, len(regexp_extract_all(html, '<script>'))::INTEGER AS scripts, len(regexp_extract_all(html, 'track\\('))::INTEGER AS tracks, length(html) AS size FROM pages WHERE contains(html, '<script>')""")
def q_script_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose script does something when it is loaded, with how often: the page itself is the entry."""
    count = lambda what: F.size(F.regexp_extract_all("html", F.lit(what), 0))
    return table(spark, sf, "pages").where(F.contains("html", F.lit("<script>"))).select("page_id", count("<script>").alias("scripts"), count(r"track\(").alias("tracks"), F.length("html").cast("long").alias("size"))


#: The kind of report and of manifest that an order's priority stands for, in the order of PRIORITIES.
TOOLS = ["semgrep", "gitleaks", "bandit", "trivy", "osv"]
MANIFESTS = ["requirements-dev.txt", "package.json", "go.mod", "Cargo.toml", "pom.xml"]


def of_orders(spark: SparkSession, sf: str, names: list[str], parts: list, whole: list) -> DataFrame:
    """(o, name, text): a text for each order that has lines: its parts in order, each kind with its own pattern."""
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))
    kind = table(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), tables.mapped("o_orderpriority", dict(zip(tables.PRIORITIES, names, strict=True))).alias("name"))
    one = F.lit(None).cast("string")
    for name, made in zip(names, parts, strict=True):
        one = F.when(F.col("name") == name, made).otherwise(one)
    held = line.join(kind, "o").withColumn("one", one).groupBy("o", "name").agg(F.sort_array(F.collect_list("one")).alias("ones"))  # an order has few lines
    text = F.lit(None).cast("string")
    for name, (head, between, tail) in zip(names, whole, strict=True):
        text = F.when(F.col("name") == name, F.concat(F.lit(head), F.array_join("ones", between), F.lit(tail))).otherwise(text)
    return held.select("o", "name", text.alias("text"))


@query("""SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'semgrep' WHEN '2-HIGH' THEN 'gitleaks' WHEN '3-MEDIUM' THEN 'bandit' WHEN '4-NOT SPECIFIED' THEN 'trivy' ELSE 'osv' END AS tool, 'R' || l_partkey AS rule, 's' || l_suppkey || '.py' AS path,
CASE o_orderpriority WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'unknown' ELSE CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END END AS severity FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def q_tool_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of five scanners in one shape; each order is a report about its lines, and unreadable ones give nothing."""
    level = F.upper(F.when(F.col("flag") == "R", "high").when(F.col("flag") == "A", "medium").otherwise("low"))
    parts = [
        F.format_string('{"check_id":"R%d","path":"s%d.py","start":{"line":%d},"extra":{"severity":"%s","message":"m"}}', "p", "s", "n", level), F.format_string('{"RuleID":"R%d","File":"s%d.py","StartLine":%d,"Description":"d"}', "p", "s", "n"),
        F.format_string('{"test_id":"R%d","filename":"s%d.py","line_number":%d,"issue_severity":"%s","issue_text":"t"}', "p", "s", "n", level), F.format_string('{"Target":"s%d.py","Vulnerabilities":[{"VulnerabilityID":"R%d","Severity":"%s","Title":"v"}]}', "s", "p", level),
        F.format_string('{"source":{"path":"s%d.py"},"packages":[{"vulnerabilities":[{"id":"R%d","summary":"s"}]}]}', "s", "p"),
    ]
    reports = of_orders(spark, sf, TOOLS, parts, [('{"results":[', ",", "]}"), ("[", ",", "]"), ('{"results":[', ",", "]}"), ('{"Results":[', ",", "]}"), ('{"results":[', ",", "]}")])
    reports = reports.select(F.col("name").alias("tool"), F.col("text").alias("report"))
    broken = table(spark, sf, "region").select(F.lit("bandit").alias("tool"), F.col("r_name").alias("report")).unionByName(table(spark, sf, "region").select(F.lit("other").alias("tool"), F.lit("{}").alias("report")))
    return files.tool_findings(reports.unionByName(broken)).select("tool", "rule", "path", "severity")


@query("""SELECT DISTINCT 'o' || l_orderkey || '/' || CASE o_orderpriority WHEN '1-URGENT' THEN 'requirements-dev.txt' WHEN '2-HIGH' THEN 'package.json' WHEN '3-MEDIUM' THEN 'go.mod' WHEN '4-NOT SPECIFIED' THEN 'Cargo.toml' ELSE 'pom.xml' END AS path,
CASE o_orderpriority WHEN '3-MEDIUM' THEN 'host.org/s' || l_suppkey || '/part' || l_partkey ELSE 'part' || l_partkey END AS dependency FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def q_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """What manifests of five kinds depend on; each order is a manifest of its parts."""
    parts = [F.format_string("part%d==1.%d", "p", "n"), F.format_string('"part%d":"1.%d"', "p", "n"), F.format_string("  host.org/s%d/part%d v1.%d", "s", "p", "n"), F.format_string('part%d = "1.%d"', "p", "n"), F.format_string("<dependency><artifactId>part%d</artifactId><version>1.%d</version></dependency>", "p", "n")]
    whole = [("# parts\n", "\n", "\n"), ('{"name":"o","dependencies":{', ",", "}}"), ("module m\nrequire (\n", "\n", "\n)\n"), ('[package]\nname = "me"\n[dependencies]\n', "\n", "\n"), ("<project>", "", "</project>")]
    manifests = of_orders(spark, sf, MANIFESTS, parts, whole)
    return files.dependencies(manifests.select(F.format_string("o%d/%s", "o", "name").alias("path"), F.col("text").alias("content")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_loose_json(spark: SparkSession, sf: str) -> DataFrame:
    """The object in a text that wraps it in words, single quotes and a comma too many."""
    events = table(spark, sf, "events").select("event_id", F.concat(F.lit("<think>{no}</think> The answer: "), F.replace("props", F.lit('"'), F.lit("'")), F.lit(" done")).alias("text"))
    return files.json_objects(events, "text", ("k",)).select("event_id", F.from_json("object", "k long").k.alias("k"))


@query(f"""WITH RECURSIVE e AS ({EDGES_SQL}), h AS ({HUBS_SQL}), r(label, node, depth) AS (SELECT node, node, 0 FROM h UNION SELECT r.label, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 2)
SELECT node, count(DISTINCT label) AS n, min(label) AS first_label FROM r GROUP BY node""")
def q_label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """The labels of the 20 dearest parts at all parts up to two steps away: how many reach each, and the first."""
    edges = tables.all_edges(spark, sf)
    reached = graphs.reach(tables.hubs(spark, sf), edges, 2)
    return reached.groupBy("node").agg(F.count("*").alias("n"), F.min("root").alias("first_label"))


@query()
def q_reverse_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The three longest simple paths of up to six edges that lead to each of the 20 dearest parts, over 30 edges into a part."""
    back = tables.all_edges(spark, sf).select(F.col("b").alias("a"), F.col("a").alias("b"))
    found = graphs.longest_paths(tables.hubs(spark, sf), back, 6, 30, 3)
    return found.select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), "<").alias("path"), (F.size("path") - 1).alias("hops"))


@query("""WITH RECURSIVE n AS (SELECT o_orderkey AS id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders), p AS (SELECT a.id AS child, b.id AS parent FROM n a JOIN n b ON a.c = b.c AND b.k = a.k // 2),
r(node, parent, depth) AS (SELECT child, parent, 1 FROM p UNION SELECT r.node, p.parent, r.depth + 1 FROM r JOIN p ON p.child = r.parent) SELECT node, parent, min(depth)::INTEGER AS depth FROM r GROUP BY 1, 2""")
def q_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """All that each order descends from, where order k of a customer comes from order k / 2."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    n = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), nth.alias("k"))
    parents = n.select(F.col("id").alias("child"), "c", F.floor(F.col("k") / 2).alias("k")).join(n.select(F.col("id").alias("parent"), "c", "k"), ["c", "k"]).select("child", "parent")
    return graphs.ancestors(parents)


@query("""WITH t AS (SELECT p_brand, p_partkey, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part), b AS (SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS boundaries FROM part GROUP BY 1), r AS (SELECT p_brand, string_agg(p_partkey, '>' ORDER BY n) AS reading FROM t WHERE n <= 4 GROUP BY 1)
SELECT 'pack_' || substr(sha1(p_brand || '|' || reading), 1, 16) AS pack_id, p_brand AS cluster, reading, boundaries FROM r JOIN b USING (p_brand)""")
def q_focus_packs(spark: SparkSession, sf: str) -> DataFrame:
    """For each brand the four parts to read first, in order, its types, and an id that follows from the content."""
    part = table(spark, sf, "part")
    first = rows.first_rows(part, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 4)
    order = F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("o"), "p_partkey")))
    reading = first.groupBy("p_brand").agg(F.array_join(F.transform(order, lambda x: x.p_partkey.cast("string")), ">").alias("reading"))
    kinds = part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("boundaries"))
    return reading.join(kinds, "p_brand").select(scalars.stable_id("pack", F.col("p_brand"), F.col("reading")).alias("pack_id"), F.col("p_brand").alias("cluster"), "reading", "boundaries")


@query("""WITH x AS (SELECT *, count_if(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM events),
y AS (SELECT event_id, user_id, ts, event_type, m - coalesce(max(CASE WHEN event_type = 'purchase' THEN m END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS streak FROM x)
SELECT user_id, event_id, streak::INTEGER AS streak, floor(epoch(ts))::BIGINT + 180 AS blocked_until FROM y WHERE event_type = 'error' AND streak >= 3""")
def q_stream_lease(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as a stream with state for each user: failures in a row, and from the third on a pause of 180 seconds."""
    place = f"{tables.shared_dir(spark)}/leases-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    return leases.failure_pauses(stream, place)

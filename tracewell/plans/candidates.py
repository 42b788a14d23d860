"""Registered queries over program text made of the orders and of the pages: flows across files, capabilities, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import capabilities, dataflow, lines
from ..operators import candidates
from ..operators import dataflow as flow
from ..session import kept
from ..sources import tables
from ..sources.tables import STEPS_SQL, table
from .catalog import query

#: An order's steps, whether an input gets as far as each, and the first step.
_REACH_SQL = f"""s AS ({STEPS_SQL}), t AS (SELECT *, bool_and(passes) OVER (PARTITION BY o ORDER BY k ROWS UNBOUNDED PRECEDING) AS tainted, bool_and(passes) OVER (PARTITION BY o) AS through, row_number() OVER (PARTITION BY o ORDER BY k) = 1 AS is_first FROM s),
e AS (SELECT o_orderkey AS o, o_orderpriority = '1-URGENT' AS urgent, coalesce(through, true) AS through FROM orders LEFT JOIN (SELECT DISTINCT o, through FROM t) ON o = o_orderkey),
f AS (SELECT 'orders/o' || o || '/main.py' AS source_path, 'orders/o' || o || '/step' || k || '.py' AS sink_path, 3 AS sink_line, 'process_execution' AS category FROM t SEMI JOIN e USING (o) WHERE tainted AND flag = 'R'
 UNION ALL SELECT 'orders/o' || o || '/main.py', 'orders/o' || o || '/main.py', 5, 'code_execution' FROM e WHERE urgent AND through),
c AS (SELECT 'orders/o' || o || '/step' || k || '.py' AS path, CASE WHEN is_first AND o IN (SELECT o FROM e) THEN 'GET /orders/' || o END AS entry FROM t WHERE flag = 'R')"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): orders as programs and the scripts of all pages."""
    return tables.program(spark, sf).unionByName(scripts(spark, sf))


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): the scripts of all pages, several of a page under one path."""
    script = F.explode(F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), 1))
    return table(spark, sf, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), script.alias("content"))


def facts_of(programs: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts for flows: an order's file is one row of its path, so its assignments are followed while it is read."""
    return dataflow.facts(programs, direct=True).unionByName(dataflow.facts(pages))


@query(f"WITH {_REACH_SQL} SELECT source_path, 3 AS source_line, sink_path, sink_line, category FROM f")
def q_flows_across_files(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs of the orders' handlers that reach a dangerous call, in whatever file it is."""
    return flow.flows_apart(facts_of(tables.program(spark, sf), scripts(spark, sf)))


def entries(found: DataFrame, sites: DataFrame) -> DataFrame:
    """(path, entry): the routes of each file, also for the files that it calls directly, as ``sites`` tells."""
    routes = found.where("kind = 'route'").select("path", F.col("name").alias("entry"))
    calls = sites.where("to_path is not null and to_path <> path").select("path", "to_path").distinct()
    return routes.unionByName(routes.join(calls, "path").select(F.col("to_path").alias("path"), "entry"))


@query(f"""WITH {_REACH_SQL} SELECT 'cap_' || substr(sha1(path || '|process_execution|3|os.system(y)'), 1, 16) AS capability_id, path, 3 AS line, 'process_execution' AS category, 'os.system(y)' AS evidence, entry,
CASE WHEN entry IS NULL THEN '' ELSE 'entry_reachable' END AS tags, 'high' AS risk, CASE WHEN entry IS NULL THEN 0.71 ELSE 0.79 END::DOUBLE AS confidence FROM c""")
def q_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    """What lines of the program text can do, with tags, risk and confidence."""
    files = kept(texts(spark, sf), "texts")
    # only routes are asked of the one reader; of the facts, which meet one another three times, only functions and calls are told
    found, facts = lines.extract(files, readers=(lines.routes,)), kept(dataflow.facts(files, kinds=("function", "call")), "facts")
    return capabilities.judged(capabilities.capabilities(files), entries(found, flow.sites(facts))).withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH {_REACH_SQL}, p AS (SELECT DISTINCT 'pages/' || page_id || '.js' AS path FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS js FROM pages) WHERE contains(js, 'track(')),
x AS (SELECT 'entrypoint' AS kind, 'orders/o' || o || '/main.py' AS path, 1 AS line, 'GET /orders/' || o AS entry_point, NULL AS category, 'unknown' AS severity, 'orders/o' || o || '/main.py|GET /orders/' || o AS key FROM e
 UNION ALL SELECT 'web_entrypoint', path, 1, '/' || path, NULL, 'unknown', path FROM p
 UNION ALL SELECT 'data_flow', sink_path, sink_line, 'GET /orders/' || substr(split_part(source_path, '/', 2), 2), category, 'high', sink_path || '|' || sink_line || '|' || category || '|GET /orders/' || substr(split_part(source_path, '/', 2), 2) FROM f
 UNION ALL SELECT 'capability_chain', path, 3, entry, 'process_execution', 'high', path || '|3|process_execution|' || coalesce(entry, '-') FROM c)
SELECT 'cand_' || substr(sha1(kind || '|' || key), 1, 16) AS candidate_id, kind, path, line, entry_point, category, severity FROM x""")
def q_audit_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of four kinds: entries, scripts that are entries, flows from inputs, and risky capabilities."""
    programs, pages = kept(tables.program(spark, sf), "programs"), kept(scripts(spark, sf), "scripts")
    files = programs.unionByName(pages)
    found, facts = kept(lines.extract(files, readers=(lines.routes,)), "found"), kept(facts_of(programs, pages), "facts")
    sites = kept(flow.sites(facts), "sites")
    judged = capabilities.judged(capabilities.capabilities(files), entries(found, sites))
    return candidates.candidates(found.where("kind = 'route'").select("path", "line", "name"), candidates.web_scripts(facts), flow.flows_apart(facts, sites), judged)

"""Registered queries: nodes that rest on lines of files, and the part of a graph around seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, graphs, rows
from ..session import kept
from ..sources import tables
from ..sources.tables import HUBS_SQL, LINE_EDGES_SQL, table
from .catalog import query

_SAYS = lambda text: f"coalesce(NOT regexp_matches(string_split({text}, chr(10))[k], '{evidence.MUTE}'), false)"
_CAP = lambda n: f"CASE {n} WHEN 0 THEN 0.35::DOUBLE WHEN 1 THEN 0.82::DOUBLE WHEN 2 THEN 0.9::DOUBLE ELSE 0.94::DOUBLE END"
#: References of orders to lines of documents in two versions of them, and how many of each order hold in the first and then in the second.
CHECKED_SQL = f"""lab AS (SELECT doc_id, max(toxic) AS t, min(quality) AS q FROM labels GROUP BY 1),
v AS (SELECT d.doc_id, d.text AS a, CASE WHEN t = 1 THEN NULL WHEN q = 0 THEN '{{' || chr(10) || d.text ELSE d.text END AS b FROM documents d LEFT JOIN lab USING (doc_id)),
r AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS p, l_linenumber AS k FROM lineitem),
x AS (SELECT id, {_SAYS("a")} AS one, one AND {_SAYS("b")} AS two FROM r LEFT JOIN v ON doc_id = p),
c AS (SELECT id, count(*) AS n0, count_if(one) AS n1, count_if(two) AS n2 FROM x GROUP BY 1),
n AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.99::DOUBLE ELSE 0.6::DOUBLE END AS c0, o_orderstatus = 'F' AS covered, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM orders LEFT JOIN c ON c.id = o_orderkey)"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as nodes; each refers to a line of a document for each of its lines, by part and number. Finished ones are covered."""
    ref = F.format_string("docs/%d.txt:%d", "l_partkey", "l_linenumber")
    line = table(spark, sf, "lineitem").where("l_partkey is not null and l_linenumber is not null").select(F.col("l_orderkey").alias("o"), "l_linenumber", "l_partkey", ref.alias("ref")).distinct()
    refs = line.groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "ref"))), lambda x: x.ref).alias("evidence"))  # an order's lines
    sure = F.when(F.col("o_orderpriority") == "1-URGENT", 0.99).otherwise(0.6)
    review = F.when(F.col("o_orderstatus") == "F", "covered").otherwise("open")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), sure.alias("confidence"), review.alias("review_status"))
    return orders.join(refs, F.col("id") == F.col("o"), "left").select("id", "confidence", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.lit("unverified").alias("status"), "review_status", F.lit(1).alias("revision"))


def files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The documents as files, and the files that change: toxic ones are deleted (null content), those of low quality get a line before the first."""
    path = F.format_string("docs/%d.txt", "doc_id")
    docs = table(spark, sf, "documents").select("doc_id", path.alias("path"), F.col("text").alias("content"), F.lit(False).alias("is_binary"))
    label = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q")).where("t = 1 or q = 0")
    moved = F.when(F.col("t") == 1, F.lit(None)).otherwise(F.concat(F.lit("{\n"), F.col("content")))
    return docs.drop("doc_id"), docs.join(label, "doc_id").select("path", moved.alias("content"), "is_binary")


@query(f"""WITH {CHECKED_SQL}, y AS (SELECT *, least(c0, {_CAP("n1")}) AS c1, least(c1, {_CAP("n2")}) AS c2, covered AND n1 = 0 AS r1, covered AND NOT r1 AND n2 = 0 AS r2 FROM n)
SELECT id, n2 AS n_evidence, c2 AS confidence, CASE WHEN n2 > 0 THEN 'source_backed' ELSE 'unverified' END AS status, CASE WHEN r1 OR r2 THEN 'investigating' WHEN covered THEN 'covered' ELSE 'open' END AS review_status,
 1 + (n0 <> n1 OR c0 <> c1 OR n1 > 0 OR r1)::INTEGER + (n1 <> n2 OR c1 <> c2 OR r2)::INTEGER AS revision, r2 AS reopened FROM y""")
def q_evidence_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """References checked against the lines of all documents, then against the changed documents alone: what no change touches is not computed again."""
    before, changed = files(spark, sf)
    changed = kept(changed, "changed-files")
    state = kept(evidence.reconcile(nodes(spark, sf), before).drop("updated", "reopened", "dropped"), "reconciled")
    after = evidence.reconcile_changes(state, changed, changed)
    return after.select("id", F.size("evidence").cast("long").alias("n_evidence"), "confidence", "status", "review_status", "revision", "reopened")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS k, l_partkey AS p, l_returnflag = 'R' AS late FROM lineitem),
c AS (SELECT id, count(DISTINCT (k, p)) AS n, count(DISTINCT (k, p)) FILTER (late) AS m FROM r GROUP BY 1)
SELECT o_orderkey AS id, coalesce(n, 0) AS n_evidence, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.99::DOUBLE WHEN m > 0 THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS confidence, 1 + (coalesce(m, 0) > 0)::INTEGER AS revision FROM orders LEFT JOIN c ON id = o_orderkey""")
def q_graph_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes merged with finds of the same ids: each returned line is found once more with a confidence of 0.7."""
    late = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.lit(0.7).alias("confidence"), F.array(F.format_string("docs/%d.txt:%d", "l_partkey", "l_linenumber")).alias("evidence"))
    merged = evidence.merge(nodes(spark, sf), late.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi"))
    return merged.select("id", F.size("evidence").cast("long").alias("n_evidence"), "confidence", "revision")


@query(f"""WITH h AS ({HUBS_SQL}), e AS ({LINE_EDGES_SQL}), p AS (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e), c AS (SELECT node, other, count(*) AS weight FROM p WHERE node IN (SELECT node FROM h) GROUP BY 1, 2),
t AS (SELECT other FROM c QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) <= 5), s AS (SELECT node FROM h UNION SELECT other FROM t)
SELECT a, b, count(*) AS weight FROM e WHERE a IN (SELECT node FROM s) AND b IN (SELECT node FROM s) GROUP BY 1, 2""")
def q_induced_view(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 dearest parts, the five parts most often next to each, and all edges among them with their weights."""
    edges = tables.line_edges(spark, sf)
    hubs = kept(tables.hubs(spark, sf), "hubs")
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).join(hubs, "node", "left_semi")
    near = rows.first_rows(pairs.groupBy("node", "other").agg(F.count("*").alias("weight")), ["node"], [F.desc("weight"), F.col("other")], 5)
    seen = kept(hubs.unionByName(near.select(F.col("other").alias("node"))).distinct(), "view")
    return graphs.induced(edges, seen).groupBy("a", "b").agg(F.count("*").alias("weight"))

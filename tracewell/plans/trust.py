"""Registered queries about how far a path can be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs
from ..sources import tables
from ..sources.tables import HUBS_SQL, TRUSTED_EDGES_SQL, table
from .catalog import query

_STARTS_SQL = f"SELECT node, CASE WHEN p_size > 5 THEN round(0.6::DOUBLE + p_size / 125.0::DOUBLE, 3) END AS confidence FROM ({HUBS_SQL}) JOIN part ON p_partkey = node"


def starts(spark: SparkSession, sf: str) -> DataFrame:
    """(node, confidence): the 20 dearest parts, with a confidence by size; the smallest tell none."""
    size = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") > 5, F.round(0.6 + F.col("p_size") / 125.0, 3)).alias("confidence"))
    return tables.hubs(spark, sf).join(size, "node")


@query(f"""WITH RECURSIVE e AS (SELECT a, b, round(max(coalesce(confidence, 0.5)), 3) AS hop FROM ({TRUSTED_EDGES_SQL}) GROUP BY a, b), s AS ({_STARTS_SQL}),
r(root, node, confidence) AS (SELECT node, node, coalesce(confidence, 0.65) FROM s UNION SELECT r.root, e.b, least(r.confidence, e.hop) FROM r JOIN e ON e.a = r.node)
SELECT root, node, max(confidence) AS confidence FROM r GROUP BY root, node""")
def q_path_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """How far every part can be trusted from each of the 20 dearest: the weakest hop of the best path."""
    return graphs.widest(starts(spark, sf), tables.trusted_edges(spark, sf))


@query(f"""WITH RECURSIVE e AS (SELECT a, b, max(coalesce(confidence, 0.5)) AS hop FROM ({TRUSTED_EDGES_SQL}) GROUP BY a, b), f AS (SELECT a, b, hop FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 24), s AS ({_STARTS_SQL}),
p(root, path, confidence) AS (SELECT node, [node], coalesce(confidence, 0.65) FROM s UNION ALL SELECT root, list_append(path, f.b), least(p.confidence, f.hop) FROM p JOIN f ON f.a = path[len(path)] WHERE len(path) < 4 AND NOT list_contains(path, f.b)),
k AS (SELECT root, array_to_string(path, '>') AS path, len(path) - 1 AS hops, round(confidence, 3) AS confidence FROM p WHERE len(path) > 1)
SELECT root, path, hops::INTEGER AS hops, confidence FROM k QUALIFY row_number() OVER (PARTITION BY root ORDER BY hops DESC, path) <= 5""")
def q_trace_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """The five longest traces of up to three hops from each of the 20 dearest parts, over 24 targets of a part, with the confidence of their weakest hop."""
    edges = tables.trusted_edges(spark, sf)
    found = graphs.longest_paths(tables.hubs(spark, sf), edges, 3, 24, 5)
    judged = graphs.path_confidence(found, starts(spark, sf), edges)
    return judged.select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), (F.size("path") - 1).alias("hops"), "confidence")

"""Registered queries about payloads: contracts, list items, proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payloads
from ..functions.payloads import Field
from ..sources.tables import SEVERITIES, table
from .catalog import query

EVENT = (
    Field("k", "integer", ("key",), required=True, low=0, high=90), Field("title", "text", ("name",), required=True), Field("severity", "text", default="unknown", allowed=(*SEVERITIES, "unknown")),
    Field("confidence", "number", default=0.7, low=0, high=1), Field("evidence", "texts", default=()), Field("done", "flag"),
)

#: The text of an event's payload by event_id % 9: as it should be, with aliases, wrong types, blank, out of range, cut off, a list, null.
_TEXT_SQL = """CASE event_id % 9 WHEN 0 THEN '{"k": ' || k || ', "title": " ' || event_type || ' ", "severity": "high", "confidence": 0.5, "evidence": ["a", " ", null, 3, " b "], "done": true}'
 WHEN 1 THEN '{"key": ' || k || ', "name": "' || event_type || '"}' WHEN 2 THEN '{"k": "' || k || '", "title": 5, "evidence": {}, "done": "yes"}' WHEN 3 THEN '{"k": ' || k || ', "title": " ", "severity": "severe", "confidence": 1.5}'
 WHEN 4 THEN props || ',' WHEN 5 THEN '[' || props || ']' WHEN 6 THEN NULL WHEN 7 THEN '{"k": null, "key": ' || k || ', "title": "' || event_type || '", "confidence": 1, "evidence": []}' ELSE props END"""


def event_text() -> Column:
    k, kind, props = F.get_json_object("props", "$.k"), F.col("event_type"), F.col("props")
    lit, n = F.lit, F.col("event_id") % 9
    return (
        F.when(n == 0, F.concat(lit('{"k": '), k, lit(', "title": " '), kind, lit(' ", "severity": "high", "confidence": 0.5, "evidence": ["a", " ", null, 3, " b "], "done": true}')))
        .when(n == 1, F.concat(lit('{"key": '), k, lit(', "name": "'), kind, lit('"}')))
        .when(n == 2, F.concat(lit('{"k": "'), k, lit('", "title": 5, "evidence": {}, "done": "yes"}')))
        .when(n == 3, F.concat(lit('{"k": '), k, lit(', "title": " ", "severity": "severe", "confidence": 1.5}')))
        .when(n == 4, F.concat(props, lit(",")))
        .when(n == 5, F.concat(lit("["), props, lit("]")))
        .when(n == 7, F.concat(lit('{"k": null, "key": '), k, lit(', "title": "'), kind, lit('", "confidence": 1, "evidence": []}')))
        .when(n == 8, props)
    )


@query(f"""WITH t AS (SELECT event_id, {_TEXT_SQL} AS text FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)), j AS (SELECT event_id, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM t),
v AS (SELECT event_id, j, j IS NULL AS broken, json_type(j) <> 'OBJECT' AS shape, nullif(json_type(j, '$.k'), 'NULL') AS k_type, coalesce(nullif(json_type(j, '$.k'), 'NULL'), nullif(json_type(j, '$.key'), 'NULL')) AS any_k, CASE WHEN coalesce(json_type(j, '$.k'), 'NULL') = 'NULL' THEN j->'$.key' ELSE j->'$.k' END AS k,
 coalesce(json_type(j, '$.title'), json_type(j, '$.name')) AS t_type, json_type(j, '$.title') AS own_t, trim(coalesce(j->>'$.title', j->>'$.name')) AS title, json_type(j, '$.severity') AS s_type, j->>'$.severity' AS severity, json_type(j, '$.confidence') AS c_type, (j->>'$.confidence')::DOUBLE AS confidence, json_type(j, '$.evidence') AS e_type, json_type(j, '$.done') AS d_type FROM j),
r AS (SELECT *, CASE WHEN any_k IS NULL THEN 'k:missing' WHEN any_k NOT IN ('UBIGINT', 'BIGINT') THEN 'k:type' WHEN (k::VARCHAR)::BIGINT > 90 THEN 'k:range' END AS r1, CASE WHEN t_type IS NULL THEN 'title:missing' WHEN t_type <> 'VARCHAR' THEN 'title:type' WHEN title = '' THEN 'title:blank' END AS r2,
 CASE WHEN severity NOT IN ('critical', 'high', 'medium', 'low', 'info', 'unknown') THEN 'severity:value' END AS r3, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence:range' END AS r4, CASE WHEN e_type <> 'ARRAY' THEN 'evidence:type' END AS r5, CASE WHEN d_type <> 'BOOLEAN' THEN 'done:type' END AS r6 FROM v)
SELECT event_id, CASE WHEN NOT broken AND NOT shape AND any_k IN ('UBIGINT', 'BIGINT') THEN (k::VARCHAR)::BIGINT END AS k, CASE WHEN NOT broken AND NOT shape AND t_type = 'VARCHAR' THEN title END AS title,
 CASE WHEN NOT broken AND NOT shape THEN coalesce(severity, 'unknown') END AS severity, CASE WHEN NOT broken AND NOT shape THEN coalesce(confidence, 0.7) END::DOUBLE AS confidence, CASE WHEN broken OR shape OR e_type <> 'ARRAY' THEN NULL WHEN event_id % 9 = 0 THEN 'a,b' ELSE '' END AS evidence, CASE WHEN NOT broken AND NOT shape AND d_type = 'BOOLEAN' THEN (j->>'$.done')::BOOLEAN END AS done,
 CASE WHEN broken THEN 'broken' WHEN shape THEN 'shape' ELSE concat_ws(',', r1, r2, r3, r4, r5, r6) END AS reasons,
 CASE WHEN broken OR shape THEN '' ELSE concat_ws(',', CASE WHEN k_type IS NULL AND any_k IS NOT NULL THEN 'k:alias' END, CASE WHEN own_t IS NULL AND t_type IS NOT NULL THEN 'title:alias' END, CASE WHEN s_type IS NULL THEN 'severity:default' END, CASE WHEN c_type IS NULL THEN 'confidence:default' END, CASE WHEN e_type IS NULL THEN 'evidence:default' END) END AS repairs FROM r""")
def q_payload_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's payload, also broken ones, against one contract: typed fields, reasons for quarantine, and what was mended."""
    rows = payloads.checked(table(spark, sf, "events").select("event_id", event_text().alias("text")), "text", EVENT)
    return rows.select("event_id", "fields.k", "fields.title", "fields.severity", "fields.confidence", F.array_join("fields.evidence", ",").alias("evidence"), "fields.done", F.array_join("reasons", ",").alias("reasons"), F.array_join("repairs", ",").alias("repairs"))


LINE = (Field("part", "integer", ("part_id",), required=True), Field("qty", "number", required=True, low=1, high=40), Field("flag", "text", default="N", allowed=("A", "N", "R")))


@query("""WITH l AS (SELECT l_orderkey, l_partkey AS part, l_quantity AS qty, l_returnflag AS flag, l_linestatus AS status FROM lineitem),
r AS (SELECT *, concat_ws(',', CASE WHEN status = 'F' AND flag = 'R' THEN 'part:type' END, CASE WHEN qty > 40 THEN 'qty:range' END) AS reasons, concat_ws(',', CASE WHEN flag = 'A' THEN 'part:alias' END, CASE WHEN flag = 'N' THEN 'flag:default' END) AS repairs FROM l)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE reasons = '') AS accepted, coalesce(sum(qty) FILTER (WHERE reasons = ''), 0)::DOUBLE AS qty, string_agg(DISTINCT reasons, ';' ORDER BY reasons) FILTER (WHERE reasons <> '') AS reasons, string_agg(DISTINCT repairs, ';' ORDER BY repairs) FILTER (WHERE repairs <> '') AS repairs FROM r GROUP BY l_orderkey""")
def q_payload_items(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each order as items of one payload, checked one by one: how many are accepted, and why others are not."""
    line, flag = table(spark, sf, "lineitem"), F.col("l_returnflag")
    text, lit = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit
    part = F.when((F.col("l_linestatus") == "F") & (flag == "R"), F.concat(lit('"part": "'), text("l_partkey"), lit('"'))).when(flag == "A", F.concat(lit('"part_id": '), text("l_partkey"))).otherwise(F.concat(lit('"part": '), text("l_partkey")))
    item = F.concat(lit("{"), part, lit(', "qty": '), text("l_quantity"), F.when(flag != "N", F.concat(lit(', "flag": "'), flag, lit('"'))).otherwise(lit("")), lit("}"))
    texts = line.withColumn("one", item).groupBy("l_orderkey").agg(F.concat(F.lit('{"lines": ['), F.array_join(F.collect_list("one"), ", "), F.lit("]}")).alias("text"))  # an order has few lines
    rows = payloads.checked(payloads.items(texts, "text", "items", "lines"), "item", LINE)
    good, some = F.size("reasons") == 0, lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.size(c) > 0, F.array_join(c, ",")))), ";"), F.lit(""))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(good).alias("accepted"), F.coalesce(F.sum(F.when(good, F.col("fields.qty"))), F.lit(0.0)).alias("qty"), some("reasons").alias("reasons"), some("repairs").alias("repairs"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE page_id % 7 WHEN 0 THEN host <> '' AND path <> '' AND NOT contains(path, '...') WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false WHEN 5 THEN false ELSE false END AS complete FROM u""")
def q_proof_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a page's proof is complete: a whole exchange, a command, or one that lacks its host, its response, says TODO, is a list or broken."""
    host, path = F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1), F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    request = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\nHost: "), host)
    packet = lambda request, response="HTTP/1.1 200 OK", payload="x": F.to_json(F.struct(F.lit("t").alias("title"), request.alias("request"), F.lit(response).alias("response"), F.lit(payload).alias("payload")))
    n = F.col("page_id") % 7
    text = (
        F.when(n == 0, packet(request)).when(n == 1, packet(F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1")))).when(n == 2, packet(F.concat(F.lit("curl "), F.lit("http://h/"))))
        .when(n == 3, packet(request, "")).when(n == 4, packet(request, payload="TODO")).when(n == 5, F.concat(F.lit("["), packet(request), F.lit("]"))).otherwise(F.lit("{"))
    )
    return table(spark, sf, "pages").select("page_id", payloads.complete_proof(payloads.parsed(text)).alias("complete"))

"""More registered queries: guards, coverage, usage, merges, exports, graph seeds and line extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import rows
from ..sources import tables
from ..sources.tables import EDGES_SQL, FINDINGS_SQL, SEVERITIES, table
from .catalog import RANK_SQL, query


@query("""WITH l AS (SELECT l_partkey, floor(l_quantity)::BIGINT AS q, l_linenumber FROM lineitem WHERE l_linenumber >= 6)
SELECT p_partkey, coalesce(sum(q), 0)::BIGINT AS quantity, coalesce(max(l_linenumber), 0) AS top FROM part LEFT JOIN l ON l_partkey = p_partkey GROUP BY p_partkey""")
def q_empty_safe_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Sums with 0 for parts without lines; lines are summed before the join."""
    per = table(spark, sf, "lineitem").where("l_linenumber >= 6").groupBy("l_partkey").agg(F.sum(F.floor("l_quantity")).alias("q"), F.max("l_linenumber").alias("m"))
    joined = table(spark, sf, "part").join(per, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select("p_partkey", F.coalesce("q", F.lit(0)).alias("quantity"), F.coalesce("m", F.lit(0)).alias("top"))


@query("""WITH m AS (SELECT p_brand, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS clean FROM part)
SELECT p_brand, count(*) FILTER (WHERE clean) AS unreturned, count(*) AS parts FROM m GROUP BY p_brand""")
def q_anti_inside_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of each brand, and how many never came back."""
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_partkey").distinct()
    joined = table(spark, sf, "part").join(returned, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.groupBy("p_brand").agg(F.count_if(F.col("l_partkey").isNull()).alias("unreturned"), F.count("*").alias("parts"))


@query("""WITH s AS (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, max(o_orderdate) AS d, max(s) AS s FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, greatest(d, s) AS last_active, d IS NULL AS never FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def q_idle_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """The latest of all kinds of activity, each aggregated before it is joined."""
    shipped = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    per = table(spark, sf, "orders").join(shipped, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_custkey").agg(F.max("o_orderdate").alias("d"), F.max("s").alias("s"))
    joined = table(spark, sf, "customer").join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", F.greatest("d", "s").alias("last_active"), F.col("d").isNull().alias("never"))


@query(f"WITH e AS ({EDGES_SQL}) SELECT a, b FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY b DESC) <= 2")
def q_neighbors_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The two greatest targets of each part."""
    return rows.first_rows(tables.all_edges(spark, sf), ["a"], [F.desc("b")], 2)


@query()
def q_neighbors_topk_all(spark: SparkSession, sf: str) -> DataFrame:
    """The two greatest targets of each part, over all edges."""
    return rows.first_rows(tables.all_edges(spark, sf), ["a"], [F.desc("b")], 2)


TIMELINE_SQL = """SELECT o_custkey AS project_id, 'opened' AS kind, o_orderkey AS ref, o_orderdate AS happened FROM orders
UNION ALL SELECT o_custkey, 'shipped', o_orderkey, s FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


@query(f"WITH t AS ({TIMELINE_SQL}) SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY happened, kind, ref) AS INTEGER) AS seq FROM t")
def q_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Events of several kinds in one numbered line for each project."""
    orders = table(spark, sf, "orders")
    shipped = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("s"))
    event = lambda kind, at: [F.col("o_custkey").alias("project_id"), F.lit(kind).alias("kind"), F.col("o_orderkey").alias("ref"), F.col(at).alias("happened")]
    both = orders.select(*event("opened", "o_orderdate")).unionByName(orders.join(shipped, F.col("l_orderkey") == F.col("o_orderkey")).select(*event("shipped", "s")))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("project_id").orderBy("happened", "kind", "ref")))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, sum(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM orders)
SELECT o_orderkey, o_custkey, used::BIGINT AS used FROM r WHERE used <= 1000000""")
def q_budget_fit(spark: SparkSession, sf: str) -> DataFrame:
    """What fits into each customer's budget, newest first."""
    line = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.sum(F.floor("o_totalprice")).over(line).alias("used")).where("used <= 1000000")


@query("""WITH g AS (SELECT o_custkey AS k, 1 AS no FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
 UNION ALL SELECT c_custkey, 3 FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)),
n AS (SELECT k, no, count(*) AS blocking FROM g GROUP BY 1, 2), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY no) = 1)
SELECT c_custkey, coalesce(no, 0) AS guard_no, coalesce(blocking, 0) AS blocking FROM customer LEFT JOIN f ON k = c_custkey""")
def q_guard_battery(spark: SparkSession, sf: str) -> DataFrame:
    """The first guard that blocks each project, with the number of rows that block; 0 if none does."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    per = orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).alias("urgent")
    )
    joined = customers.join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    guards = [(1, F.col("pending") > 0, F.col("pending")), (2, F.col("urgent") > 0, F.col("urgent")), (3, F.col("o_custkey").isNull(), F.lit(1))]
    number, blocking = F.lit(0), F.lit(0)
    for no, blocks, n in reversed(guards):
        number, blocking = F.when(blocks, no).otherwise(number), F.when(blocks, n).otherwise(blocking)
    return joined.select("c_custkey", number.alias("guard_no"), blocking.cast("long").alias("blocking"))


@query("""WITH l AS (SELECT DISTINCT doc_id FROM labels), m AS (SELECT d.doc_id, concat_ws(',', CASE WHEN l.doc_id IS NULL THEN 'label' END, CASE WHEN n_chars < 200 THEN 'body' END, CASE WHEN source IS NULL THEN 'source' END) AS missing
 FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id) SELECT * FROM m WHERE missing <> ''""")
def q_missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("labelled")).distinct()
    joined = table(spark, sf, "documents").select("doc_id", "n_chars", "source").join(labelled, F.col("labelled") == F.col("doc_id"), "left")
    missing = F.concat_ws(",", F.when(F.col("labelled").isNull(), "label"), F.when(F.col("n_chars") < 200, "body"), F.when(F.col("source").isNull(), "source"))
    return joined.select("doc_id", missing.alias("missing")).where("missing <> ''")


@query("""WITH c AS (SELECT user_id, min(ts) AS cut FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.user_id, count(*) FILTER (WHERE event_type = 'purchase') AS exact, count(*) FILTER (WHERE event_type <> 'purchase' AND (cut IS NULL OR ts < cut)) AS estimated
FROM events e LEFT JOIN c ON c.user_id = e.user_id GROUP BY 1""")
def q_usage_cutover(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates count only up to the first exact record of their worker."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_type")
    cut = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("cut"))
    exact = F.col("event_type") == "purchase"
    return events.join(cut, "user_id", "left").groupBy("user_id").agg(F.count_if(exact).alias("exact"), F.count_if(~exact & (F.col("cut").isNull() | (F.col("ts") < F.col("cut")))).alias("estimated"))


@query("""WITH c AS (SELECT user_id, min(ts) AS cut FROM events WHERE event_type = 'purchase' GROUP BY 1), t AS (SELECT e.user_id, coalesce(floor(value * 100), 0)::BIGINT AS regular, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k
 FROM events e LEFT JOIN c ON c.user_id = e.user_id WHERE event_type = 'purchase' OR cut IS NULL OR ts < cut)
SELECT user_id, sum(regular)::BIGINT AS regular, (10 * sum(k))::BIGINT AS cached, sum(k)::BIGINT AS output, (3 * sum(regular) + 10 * sum(k) + 15 * sum(k))::BIGINT / 1e6 AS cost FROM t GROUP BY 1""")
def q_usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each user, estimated up to the first exact record and exact from there, and what they cost."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_type", "value", "props")
    cut = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("cut"))
    counts = events.join(cut, "user_id", "left").where((F.col("event_type") == "purchase") | F.col("cut").isNull() | (F.col("ts") < F.col("cut")))
    k = F.coalesce(F.from_json("props", "k long").k, F.lit(0))
    per = counts.groupBy("user_id").agg(F.sum(F.coalesce(F.floor(F.col("value") * 100), F.lit(0))).alias("regular"), F.sum(k * 10).alias("cached"), F.sum(k).alias("output"))
    return per.withColumn("cost", scalars.cost({"regular": 3, "cached": 1, "output": 15}))


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS worker FROM orders), f AS (SELECT l_orderkey AS k, l_suppkey AS claimant FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_suppkey) = 1)
SELECT o_orderkey, coalesce(worker, claimant) AS worker, worker IS NULL AND k IS NOT NULL AS updated FROM s LEFT JOIN f ON k = o_orderkey""")
def q_claim_once(spark: SparkSession, sf: str) -> DataFrame:
    """Open orders that suppliers claim, the first claim of each counts; orders with a worker keep theirs."""
    state = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("worker"))
    claims = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("claimant"), "l_shipdate")
    return rows.compare_and_set(state, claims, "o_orderkey", "worker", ["l_shipdate"])


@query("""SELECT o_orderkey, l_linenumber, l_partkey, p_brand, s_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 WHERE o_orderstatus = 'P'""")
def q_composite_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Inner joins and an outer one with a condition on its right side."""
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    paid = table(spark, sf, "supplier").where("s_acctbal > 0")
    joined = orders.join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return joined.join(paid, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("o_orderkey", "l_linenumber", "l_partkey", "p_brand", "s_name")


@query("SELECT p_brand, p_type, p_size, min(p_partkey) AS owner FROM part GROUP BY 1, 2, 3 HAVING count(DISTINCT p_partkey) = 1")
def q_distinct_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    """Names that one key owns: smallest and largest owner are the same, so no distinct count is needed."""
    owners = table(spark, sf, "part").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("owner"), F.max("p_partkey").alias("last"))
    return owners.where("owner = last").drop("last")


@query("""WITH w AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS running, max(ts) AS seen FROM events GROUP BY 1)
SELECT user_id, running FROM w WHERE running < 40 ORDER BY running, seen DESC, user_id LIMIT 5""")
def q_pick_worker(spark: SparkSession, sf: str) -> DataFrame:
    """The five workers that are next in turn: least loaded first, then seen last."""
    load = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("running"), F.max("ts").alias("seen"))
    return load.where("running < 40").orderBy("running", F.desc("seen"), "user_id").limit(5).select("user_id", "running")


@query("SELECT r_name AS name, false AS builtin FROM region UNION ALL SELECT * FROM (VALUES ('ALL', true), ('NONE', true)) v(name, builtin)")
def q_builtin_union(spark: SparkSession, sf: str) -> DataFrame:
    """Stored names with two fixed ones."""
    return table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit(False).alias("builtin")).unionByName(spark.createDataFrame([("ALL", True), ("NONE", True)], "name string, builtin boolean"))


@query(f"""WITH f AS ({FINDINGS_SQL}) SELECT project_id, count(*) AS n, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'pending_review') AS pending,
 CASE WHEN count(*) FILTER (WHERE status = 'pending_review') > 0 THEN 'review' WHEN count(*) FILTER (WHERE status = 'candidate') > 0 THEN 'validate' ELSE 'done' END AS queue FROM f GROUP BY project_id""")
def q_coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of each project by status, and the queue that it goes to next."""
    status = lambda s: F.count_if(F.col("status") == s)
    per = tables.findings(spark, sf).groupBy("project_id").agg(F.count("*").alias("n"), status("confirmed").alias("confirmed"), status("pending_review").alias("pending"), status("candidate").alias("open"))
    return per.select("project_id", "n", "confirmed", "pending", F.when(F.col("pending") > 0, "review").when(F.col("open") > 0, "validate").otherwise("done").alias("queue"))


@query(f"WITH f AS ({FINDINGS_SQL}) SELECT project_id, id, severity, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {RANK_SQL}, created_at, id) AS INTEGER) AS place FROM f WHERE status = 'confirmed'")
def q_retest_list(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed findings of each project, the worst first."""
    order = Window.partitionBy("project_id").orderBy(scalars.rank_of("severity", SEVERITIES), "created_at", "id")
    return tables.findings(spark, sf).where("status = 'confirmed'").select("project_id", "id", "severity", F.row_number().over(order).alias("place"))


@query("""WITH old AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1), new AS (SELECT * FROM orders WHERE o_orderkey % 3 = 0), kept AS (SELECT o_orderkey FROM old WHERE o_orderstatus = 'F')
SELECT o_orderkey, 'kept' AS origin FROM kept UNION ALL SELECT o_orderkey, 'rebuilt' FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM kept)""")
def q_incremental_keep(spark: SparkSession, sf: str) -> DataFrame:
    """Decided rows survive a rebuild; all others come from it."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    kept = orders.where("o_orderkey % 2 = 1 and o_orderstatus = 'F'").select("o_orderkey", F.lit("kept").alias("origin"))
    return kept.unionByName(orders.where("o_orderkey % 3 = 0").join(kept, "o_orderkey", "left_anti").select("o_orderkey", F.lit("rebuilt").alias("origin")))


@query(f"""WITH f AS ({FINDINGS_SQL}), b AS (SELECT project_id, id // 10000 AS block, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM f GROUP BY 1, 2), t AS (SELECT project_id, count(*) AS total FROM f GROUP BY 1)
SELECT project_id, block, '{{"project":' || project_id || ',"block":' || block || ',"total":' || total || ',"ids":[' || ids || ']}}' AS payload FROM b JOIN t USING (project_id)""")
def q_export_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each project's findings as JSON, a payload for each block of 10,000 ids: a large project takes more payloads, not a longer one."""
    found = tables.findings(spark, sf).select("project_id", "id")
    blocks = found.groupBy("project_id", F.expr("id div 10000").alias("block")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    totals = blocks.groupBy("project_id").agg(F.sum(F.size("ids")).alias("total"))
    return blocks.join(totals, "project_id").select("project_id", "block", F.to_json(F.struct(F.col("project_id").alias("project"), "block", "total", "ids")).alias("payload"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50 OFFSET 20")
def q_scan_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of lines: 50 after the first 20, the latest first."""
    order = [F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf, "lineitem").orderBy(*order).offset(20).limit(50).select(*order[1:])


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)passw|secret|api[_-]?key') THEN 'secret' WHEN contains(text, '@') THEN 'personal' WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') THEN 'license' ELSE 'prose' END AS kind FROM documents""")
def q_text_classify(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that matches."""
    text = F.col("text")
    kind = F.when(text.rlike("(?i)passw|secret|api[_-]?key"), "secret").when(text.contains("@"), "personal").when(text.rlike("(?i)licen[sc]e|copyright"), "license").otherwise("prose")
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"))


@query("""WITH l AS (SELECT DISTINCT doc_id FROM labels), m AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS bare, count(*) FILTER (WHERE n_chars < 200) AS short FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY lang),
s AS (SELECT lang, n, 100 - 40 * bare // n - 30 * short // n AS score FROM m)
SELECT lang, n, score, CASE WHEN score >= 85 THEN 'good' WHEN score >= 70 THEN 'usable' WHEN score >= 50 THEN 'weak' ELSE 'poor' END AS grade FROM s""")
def q_index_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Penalties by share of unlabelled and of short documents."""
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("labelled")).distinct()
    joined = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(labelled, F.col("labelled") == F.col("doc_id"), "left")
    per = joined.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("labelled").isNull()).alias("bare"), F.count_if(F.col("n_chars") < 200).alias("short"))
    scored = per.select("lang", "n", F.expr("100 - (40 * bare) div n - (30 * short) div n").alias("score"))
    return scored.withColumn("grade", F.when(F.col("score") >= 85, "good").when(F.col("score") >= 70, "usable").when(F.col("score") >= 50, "weak").otherwise("poor"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS size FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1""")
def q_cluster_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each cluster, by an aggregate that combines before the shuffle."""
    first = F.min(F.struct("l_partkey", "l_suppkey")).alias("f")
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first, F.count("*").alias("size")).select("l_orderkey", "l_linenumber", "f.l_partkey", "f.l_suppkey", "size")


@query("""WITH p AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, count(*) FILTER (WHERE k BETWEEN 0 AND 49) AS parsed, count(*) FILTER (WHERE k IS NULL OR NOT k BETWEEN 0 AND 49) AS quarantined FROM p GROUP BY 1""")
def q_contract_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that meet the contract, and those set aside; a missing value does not meet it."""
    fits = F.coalesce(F.from_json("props", "k long").k.between(0, 49), F.lit(False))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(fits).alias("parsed"), F.count_if(~fits).alias("quarantined"))


@query("""WITH l AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1)
SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'refuted' WHEN quality = 1 THEN 'confirmed' WHEN quality = 0 THEN 'weak' ELSE 'open' END AS status FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id""")
def q_evidence_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """A status from all evidence of a node; the decisive kind wins."""
    evidence = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    status = F.when(F.col("toxic") == 1, "refuted").when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "weak").otherwise("open")
    return table(spark, sf, "documents").select("doc_id").join(evidence, "doc_id", "left").select("doc_id", status.alias("status"))


@query("SELECT CASE event_type WHEN 'click' THEN 'visit' WHEN 'view' THEN 'visit' WHEN 'purchase' THEN 'sale' WHEN 'error' THEN 'fault' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1")
def q_alias_map(spark: SparkSession, sf: str) -> DataFrame:
    names = tables.mapped("event_type", {"click": "visit", "view": "visit", "purchase": "sale", "error": "fault"})
    return table(spark, sf, "events").groupBy(F.coalesce(names, F.col("event_type")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH f AS ({FINDINGS_SQL}) SELECT project_id, min({RANK_SQL}) AS worst, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses, max(score) AS score, count(*) AS revision FROM f GROUP BY project_id""")
def q_lattice_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one key merged: the worst severity, the union of tags, the best score; any order gives the same."""
    per = tables.findings(spark, sf).groupBy("project_id")
    return per.agg(F.min(scalars.rank_of("severity", SEVERITIES)).alias("worst"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"), F.max("score").alias("score"), F.count("*").alias("revision"))


@query("""SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'part_of' AS relation FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'part_of' FROM customer UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'status:' || o_orderstatus, 'has' FROM orders""")
def q_graph_seed(spark: SparkSession, sf: str) -> DataFrame:
    """Typed edges of all kinds in one table, with ids that name their kind."""
    named = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    edge = lambda df, a, b, relation: df.select(a.alias("source_id"), b.alias("target_id"), F.lit(relation).alias("relation"))
    nations = edge(table(spark, sf, "nation"), named("nation", "n_nationkey"), named("region", "n_regionkey"), "part_of")
    customers = edge(table(spark, sf, "customer"), named("customer", "c_custkey"), named("nation", "c_nationkey"), "part_of")
    return nations.unionByName(customers).unionByName(edge(table(spark, sf, "orders"), named("customer", "o_custkey"), named("status", "o_orderstatus"), "has").distinct())


@query("""SELECT n_regionkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal DESC, c_custkey) <= 3""")
def q_graph_view(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds with their first three neighbours; Spark limits ranks before the shuffle, so a region is never gathered."""
    joined = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.first_rows(joined, ["n_regionkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("n_regionkey", "c_custkey")


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INTEGER AS links FROM pages""")
def q_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Title and number of links of each page."""
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)).alias("links"))

"""Registered queries over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graphs, rows, spans, telemetry
from ..sources import tables
from ..sources.tables import EDGES_SQL, FINDINGS_SQL, HISTORY_SQL, HUBS_SQL, SEVERITIES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its name, with its SQL if SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"


@query(f"""WITH f AS ({FINDINGS_SQL}), r AS (SELECT f.*, c_name AS title, row_number() OVER (PARTITION BY project_id, severity ORDER BY score DESC, id) AS n,
 count(*) OVER (PARTITION BY project_id, severity) AS merged FROM f JOIN customer ON c_custkey = project_id WHERE status = 'confirmed')
SELECT id, project_id, title, severity, {RANK_SQL} AS severity_rank, score, merged FROM r WHERE n = 1""")
def q_list_report(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed findings with their project, the best of each (project, severity) with the number merged into it."""
    found = rows.filtered(tables.findings(spark, sf), status="confirmed", severity=None)
    # one aggregation, partial before the shuffle: no group is sorted or held in one task
    first = F.min(F.struct((-F.col("score")).alias("order"), "id", "score")).alias("first")
    best = found.groupBy("project_id", "severity").agg(first, F.count("*").alias("merged")).join(tables.projects(spark, sf), "project_id")
    return best.select("first.id", "project_id", "title", "severity", scalars.rank_of("severity", SEVERITIES).alias("severity_rank"), "first.score", "merged")


@query(f"""WITH f AS ({FINDINGS_SQL}), d(severity) AS (VALUES ('critical'), ('high'), ('medium'), ('low'), ('none'))
SELECT d.severity, count(f.id) AS n FROM d LEFT JOIN f ON f.severity = d.severity GROUP BY d.severity""")
def q_summary_fixed_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by severity, for a fixed list of severities; a missing one counts 0, one outside the list is left out."""
    return rows.fixed_domain(tables.findings(spark, sf), "severity", ["critical", "high", "medium", "low", "none"])


@query("""WITH m AS (SELECT max(CAST(ts AS DATE)) AS d FROM events), c AS (SELECT d - CAST(i AS INTEGER) AS day FROM m, range(7) t(i))
SELECT strftime(c.day, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS purchases
FROM c LEFT JOIN events e ON CAST(e.ts AS DATE) = c.day GROUP BY 1""")
def q_trend_dense7(spark: SparkSession, sf: str) -> DataFrame:
    """The last seven days of the log, days without events kept."""
    events = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type")
    days = events.agg(F.max("day").alias("d")).select(F.explode(F.sequence(F.date_sub("d", 6), F.col("d"))).alias("day"))
    joined = days.join(events, "day", "left")
    return joined.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


@query("SELECT p_type AS kind, p_brand AS brand, count(*) AS n FROM part WHERE trim(p_type) <> '' GROUP BY 1, 2")
def q_group_count_nonblank(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by kind and brand; blank kinds are left out."""
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("kind"), F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")).where(F.trim("kind") != "")


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0)::BIGINT AS finished,
 coalesce(sum(CASE WHEN o_totalprice < 1000 THEN 1 ELSE 0 END), 0)::BIGINT AS small FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def q_conditional_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are summed by customer before the joins, so nothing fans out."""
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("o"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_totalprice") < 1000).alias("s"))
    joined = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return joined.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), total("o", "orders"), total("f", "finished"), total("s", "small"))


@query("""SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent,
 (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS latest FROM customer""")
def q_scalar_subcounts(spark: SparkSession, sf: str) -> DataFrame:
    """Several counts for each customer from one grouping of orders; 0 for a customer without orders, whose latest day is null."""
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.max("o_orderdate").alias("latest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, sf, "customer").join(per, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", zero("orders"), zero("urgent"), "latest")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_orphan_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a pending order."""
    pending = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(pending, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query(f"""WITH h AS ({HISTORY_SQL}), t AS (SELECT *, coalesce(max(CASE WHEN outcome = 'success' THEN id END) OVER (PARTITION BY worker), -1) AS l FROM h)
SELECT worker, count(*) AS failures, max(started_at) AS last_failed_at FROM t WHERE id > l AND outcome = 'failed' GROUP BY worker""")
def q_failure_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Each worker's failures since its last success."""
    return telemetry.failure_streaks(tables.task_history(spark, sf), "worker", "id", "outcome", "started_at")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1")
def q_latest_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    """All orders of each customer's last day."""
    return rows.ties(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC) = 1 AS is_current FROM orders""")
def q_latest_one(spark: SparkSession, sf: str) -> DataFrame:
    """For each order whether it is its customer's current one: by status, then the latest, then the greatest key."""
    order = Window.partitionBy("o_custkey").orderBy(scalars.rank_of("o_orderstatus", ["F", "P"]), F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(order) == 1).alias("is_current"))


SNAPSHOT_SQL = "SELECT l_partkey AS path, year(l_shipdate) AS y, md5(string_agg(l_orderkey || ':' || l_linenumber || ':' || l_suppkey, ',' ORDER BY l_orderkey, l_linenumber, l_suppkey)) AS digest FROM lineitem GROUP BY 1, 2"


@query(f"""WITH s AS ({SNAPSHOT_SQL}), y AS (SELECT max(y) AS top FROM s), a AS (SELECT path, digest FROM s, y WHERE s.y = top - 2), b AS (SELECT path, digest FROM s, y WHERE s.y = top - 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.digest = b.digest THEN 'unchanged' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.path = b.path""")
def q_diff_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each part's lines between two years: lines are counted by year, so no part's lines are gathered."""
    line = ["l_orderkey", "l_linenumber", "l_suppkey"]
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("path"), F.year("l_shipdate").alias("y"), *line)
    top = F.broadcast(lines.agg(F.max("y").alias("top")))  # one row
    two = lines.crossJoin(top).where("y between top - 2 and top - 1").groupBy("path", *line)
    counted = two.agg(F.count_if(F.col("y") == F.col("top") - 2).alias("a"), F.count_if(F.col("y") == F.col("top") - 1).alias("b"))
    both = counted.groupBy("path").agg(F.sum("a").alias("before"), F.sum("b").alias("after"), F.bool_and(F.col("a") == F.col("b")).alias("same"))
    change = F.when(F.col("before") == 0, "added").when(F.col("after") == 0, "deleted").when(F.col("same"), "unchanged").otherwise("modified")
    return both.select("path", change.alias("change"))


@query(f"""WITH RECURSIVE e AS ({EDGES_SQL}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), s AS ({HUBS_SQL}),
r(root, node, depth) AS (SELECT node, node, 0 FROM s UNION SELECT r.root, u.b, r.depth + 1 FROM r JOIN u ON u.a = r.node WHERE r.depth < 2)
SELECT root, node, min(depth)::INTEGER AS depth FROM r GROUP BY 1, 2""")
def q_impact_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 dearest parts and what is two steps away from them in either direction."""
    return graphs.reach(tables.hubs(spark, sf), tables.line_edges(spark, sf), 2, both_ways=True)


@query(f"""WITH RECURSIVE e AS ({EDGES_SQL}), r(root, node, depth) AS (SELECT node, node, 0 FROM ({HUBS_SQL}) UNION SELECT r.root, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 4)
SELECT root, node, min(depth)::INTEGER AS depth FROM r GROUP BY 1, 2""")
def q_reach_depth4(spark: SparkSession, sf: str) -> DataFrame:
    """Four steps from the 20 dearest parts."""
    return graphs.reach(tables.hubs(spark, sf), tables.line_edges(spark, sf), 4)


@query()
def q_impact_two_hop_all(spark: SparkSession, sf: str) -> DataFrame:
    """What is two steps away from each part in either direction, over all edges."""
    return graphs.reach_all(tables.line_edges(spark, sf), 2, both_ways=True)


@query()
def q_reach_depth4_all(spark: SparkSession, sf: str) -> DataFrame:
    """Four steps from each part, over all edges."""
    return graphs.reach_all(tables.line_edges(spark, sf), 4)


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM ({EDGES_SQL})) WHERE n <= 3),
p(root, path) AS (SELECT DISTINCT a, [a] FROM e UNION ALL SELECT root, list_append(path, e.b) FROM p JOIN e ON e.a = path[len(path)] WHERE len(path) < 4 AND NOT list_contains(path, e.b)),
k AS (SELECT root, array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM p WHERE len(path) > 1)
SELECT root, path, hops::INTEGER AS hops FROM k QUALIFY row_number() OVER (PARTITION BY root ORDER BY hops DESC, path) <= 2""")
def q_paths_top2(spark: SparkSession, sf: str) -> DataFrame:
    """The two longest simple paths of up to three edges from each part, over the three smallest targets of a part."""
    edges = tables.all_edges(spark, sf)
    found = graphs.paths(edges.select(F.col("a").alias("node")).distinct(), edges, 3, 3).select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), (F.size("path") - 1).alias("hops"))
    return rows.first_rows(found, ["root"], [F.desc("hops"), F.col("path")], 2)


@query()
def q_paths_top2_all(spark: SparkSession, sf: str) -> DataFrame:
    """The two longest simple paths of up to four edges from each part, over all edges and all targets of a part."""
    edges = tables.all_edges(spark, sf)
    found = graphs.longest_paths(edges.select(F.col("a").alias("node")), edges, 4, None, 2)
    return found.select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), (F.size("path") - 1).alias("hops"))


@query("""WITH RECURSIVE l(conv_id, start, turn, depth) AS (SELECT conv_id, max(turn), max(turn), 0 FROM conversations GROUP BY conv_id
 UNION ALL SELECT l.conv_id, l.start, c.turn, l.depth + 1 FROM l JOIN conversations c ON c.conv_id = l.conv_id AND c.turn = l.turn - 1 WHERE l.depth < 20)
SELECT DISTINCT conv_id, start AS last_turn, turn, depth::INTEGER AS depth FROM l""")
def q_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """What each conversation's last turn descends from, turn by turn; turns follow one another, so a gap ends the line."""
    return lineage(table(spark, sf, "conversations"))


def lineage(conversations: DataFrame) -> DataFrame:
    turns = conversations.select("conv_id", "turn").distinct()
    last = Window.partitionBy("conv_id")
    numbered = turns.withColumns({"last_turn": F.max("turn").over(last), "behind": F.count("*").over(last.orderBy(F.desc("turn")))})
    line = numbered.where(F.col("last_turn") - F.col("turn") == F.col("behind") - 1)
    return line.select("conv_id", "last_turn", "turn", (F.col("behind") - 1).cast("int").alias("depth"))


@query("""SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers, count_if(c_acctbal < 0) AS negative,
 6 * count(DISTINCT n_nationkey) + 3 * count_if(c_acctbal < 0) AS weight FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""")
def q_module_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Nations, customers and debtors of each region with a weight; customers are counted by nation before the joins."""
    per = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"), F.count_if(F.col("c_acctbal") < 0).alias("m"))
    joined = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    out = joined.groupBy("r_name").agg(F.count("*").alias("nations"), F.coalesce(F.sum("c"), F.lit(0)).alias("customers"), F.coalesce(F.sum("m"), F.lit(0)).alias("negative"))
    return out.withColumn("weight", 6 * F.col("nations") + 3 * F.col("negative"))


@query("""WITH e AS (SELECT * FROM events WHERE event_type = 'error'), c AS (SELECT * FROM events WHERE event_type = 'click'),
j AS (SELECT e.event_id, c.event_id AS click_id, abs(epoch(e.ts)::BIGINT - epoch(c.ts)::BIGINT) AS distance FROM e JOIN c ON e.user_id = c.user_id)
SELECT event_id, click_id, distance FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY distance, click_id) = 1""".replace("epoch(e.ts)::BIGINT", "floor(epoch(e.ts))::BIGINT").replace("epoch(c.ts)::BIGINT", "floor(epoch(c.ts))::BIGINT"))
def q_nearest_line(spark: SparkSession, sf: str) -> DataFrame:
    """For each error the click of the same user that is nearest in time."""
    events = table(spark, sf, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    of = lambda kind, name: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("user_id").alias("key"), F.col("s").alias("at"))
    found = spans.nearest(of("error", "left_id"), of("click", "right_id"))
    return found.select(F.col("left_id").alias("event_id"), F.col("right_id").alias("click_id"), "distance")


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS at FROM events),
j AS (SELECT l.event_id, r.event_id AS linked_id, abs(l.at - r.at) AS distance, CASE r.event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS priority FROM e l JOIN e r ON l.user_id = r.user_id WHERE l.event_type = 'error' AND r.event_type <> 'error'),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance, priority, linked_id) AS n FROM j)
SELECT event_id, linked_id, distance FROM n WHERE n = 1 OR n = 2 AND distance = 0""")
def q_exact_or_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """For each error two events of its user on its day, purchases before clicks; where there is none, the one on the nearest day."""
    events = table(spark, sf, "events").withColumn("day", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400))
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("left_id"), F.col("user_id").alias("key"), F.col("day").alias("at"))
    others = events.where("event_type <> 'error'").select(F.col("event_id").alias("right_id"), F.col("user_id").alias("key"), F.col("day").alias("at"), scalars.rank_of("event_type", ["purchase", "click"]).alias("priority"))
    return spans.exact_or_nearest(errors, others).select(F.col("left_id").alias("event_id"), F.col("right_id").alias("linked_id"), "distance")


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def q_doc_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each text: ids are aggregated by digest, so whole texts do not sort."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    first = docs.groupBy(F.sha2("text", 256).alias("d")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(first, "doc_id", "left_semi")


@query(f"""WITH f AS ({FINDINGS_SQL}), s AS (SELECT id, 60 - 12 * {RANK_SQL} + CASE status WHEN 'confirmed' THEN 25 WHEN 'pending_review' THEN 10 ELSE 0 END + CASE WHEN score > 100000 THEN 15 ELSE 0 END AS raw FROM f)
SELECT id, CAST(least(100, greatest(0, raw)) AS INTEGER) AS priority FROM s""")
def q_priority_score(spark: SparkSession, sf: str) -> DataFrame:
    """Points for severity, status and score, clamped to 0 to 100."""
    raw = 60 - 12 * scalars.rank_of("severity", SEVERITIES) + F.when(F.col("status") == "confirmed", 25).when(F.col("status") == "pending_review", 10).otherwise(0) + F.when(F.col("score") > 100000, 15).otherwise(0)
    return tables.findings(spark, sf).select("id", F.least(F.lit(100), F.greatest(F.lit(0), raw)).cast("int").alias("priority"))


@query("""WITH n AS (SELECT p_partkey, p_type, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part)
SELECT p_partkey, p_type, CAST(CASE WHEN k = 1 THEN 1 WHEN k <= 5 THEN 2 ELSE 3 END AS INTEGER) AS pass FROM n ORDER BY pass, p_retailprice DESC, p_partkey LIMIT 40""")
def q_quota_fill(spark: SparkSession, sf: str) -> DataFrame:
    """40 parts: the best of each type, then up to five of each, then the rest."""
    return rows.quota_fill(table(spark, sf, "part"), "p_type", [F.desc("p_retailprice"), F.col("p_partkey")], 5, 40).select("p_partkey", "p_type", "pass")


@query("SELECT p_partkey, p_brand, CAST(k AS INTEGER) AS turn FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) ORDER BY k, p_brand LIMIT 60")
def q_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """60 parts from all brands in turn."""
    return rows.round_robin(table(spark, sf, "part"), "p_brand", [F.desc("p_size"), F.col("p_partkey")], 60).select("p_partkey", "p_brand", "turn")


@query("SELECT o_orderkey, format('f{:03d}', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS seq_id FROM orders")
def q_seq_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Orders numbered within each customer, as ids of three digits or more."""
    return table(spark, sf, "orders").select("o_orderkey", F.format_string("f%03d", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).alias("seq_id"))


@query("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error' QUALIFY recent >= 2""")
def q_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Errors with another of the same user in the 900 seconds before."""
    return telemetry.rate_limited(table(spark, sf, "events").where("event_type = 'error'"), "user_id", "ts", "event_id", 900, 2).select("user_id", "event_id", "recent")


LEASES_SQL = "SELECT event_id, CASE WHEN event_type <> 'view' THEN ts END AS heartbeat FROM events"


@query(f"""WITH l AS ({LEASES_SQL}) SELECT event_id, 'intent' AS queue FROM l WHERE floor(epoch(TIMESTAMP '2024-01-20')) - floor(epoch(heartbeat)) > 3600
UNION ALL SELECT event_id, 'background' FROM l WHERE coalesce(floor(epoch(TIMESTAMP '2024-01-20')) - floor(epoch(heartbeat)) > 10800, true)""")
def q_lease_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Both rules: a missing heartbeat never expires an intent and always a background task."""
    leases = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("ts")).alias("heartbeat"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    one = telemetry.expired(leases, "heartbeat", now, 3600, null_expires=False).select("event_id", F.lit("intent").alias("queue"))
    return one.union(telemetry.expired(leases, "heartbeat", now, 10800, null_expires=True).select("event_id", F.lit("background").alias("queue")))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def q_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Events since a day."""
    return table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", "event_type")


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, 'N' AS o_orderstatus, round(o_totalprice * 2, 2) AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(s.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(s.o_orderstatus, n.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, s.o_totalprice) AS o_totalprice FROM s FULL JOIN n ON s.o_orderkey = n.o_orderkey""")
def q_upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Prices change, the status of known rows stays."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"))
    return rows.upsert(orders.where("o_orderkey % 3 <> 0"), new, "o_orderkey", ["o_totalprice"])


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def q_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers that occur more than once in an order."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH u AS (SELECT page_id, lower(url) AS url FROM pages), p AS (SELECT page_id, regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1) AS path FROM u)
SELECT page_id, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/[0-9]+', '/:id', 'g') AS route FROM p""")
def q_route_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's route: its path in lower case with numbers as a parameter."""
    return table(spark, sf, "pages").select("page_id", scalars.route_key(F.col("url")).alias("route"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{4,}'))), ',') AS ids FROM documents WHERE regexp_matches(text, '[0-9]{4,}')")
def q_regex_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct numbers of four digits or more of each text that has one, in order."""
    found = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]{4,}"), 0))), ",")
    return table(spark, sf, "documents").where(F.col("text").rlike("[0-9]{4,}")).select("doc_id", found.alias("ids"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark: SparkSession, sf: str) -> DataFrame:
    """One field of each JSON object; null where it is missing."""
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query(f"""WITH h AS ({HISTORY_SQL}), c AS (SELECT worker, count(*) FILTER (WHERE outcome = 'success') AS done, count(duration) FILTER (WHERE outcome = 'success') AS n, (sum(round(duration * 100)::BIGINT) FILTER (WHERE outcome = 'success'))::BIGINT AS cents FROM h GROUP BY worker)
SELECT worker, done, CASE WHEN n > 0 THEN sign(cents) * ((abs(cents) + 5 * n) // (10 * n)) / 10.0::DOUBLE END AS mean_duration FROM c""")
def q_worker_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Each worker's successes and their mean duration to a tenth, halves away from zero.

    Durations count in hundredths, which add up exactly in any order: a sum of doubles leaves a half's side to chance.
    """
    return worker_means(tables.task_history(spark, sf))


def worker_means(history: DataFrame) -> DataFrame:
    success = F.col("outcome") == "success"
    cents = F.round(F.when(success, F.col("duration")) * 100).cast("long")
    sums = history.groupBy("worker").agg(F.count_if(success).alias("done"), F.count(cents).alias("n"), F.sum(cents).alias("cents"))
    return sums.select("worker", "done", F.expr("CASE WHEN n > 0 THEN sign(cents) * ((abs(cents) + 5 * n) div (10 * n)) / 10.0D END").alias("mean_duration"))


@query("SELECT source, sha256(string_agg(doc_id || chr(9) || n_chars || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def q_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of each source's lines in order of id."""
    return digests(table(spark, sf, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    """The digest is sequential, so a task reads a source's sorted lines, but batch by batch: none is gathered."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.col("n_chars").cast("string"), F.lit("\n"))
    dealt = docs.select("source", "doc_id", "n_chars").repartition("source").sortWithinPartitions("source", "doc_id", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda name, state: pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([state and state.hexdigest()], pa.string())], names=["source", "digest"])
        begun, source, state = False, None, None
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or name != source:
                    if begun:
                        yield out(source, state)
                    begun, source, state = True, name, None
                if text is not None:
                    state = state or hashlib.sha256()
                    state.update(text.encode())
        if begun:
            yield out(source, state)

    return dealt.select("source", line.alias("line")).mapInArrow(run, "source string, digest string")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT k, 'both' AS part FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'only' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def q_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with finished orders, by whether they have pending ones too."""
    orders = table(spark, sf, "orders")
    a, b = (orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FP")
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.subtract(b).withColumn("part", F.lit("only")))


@query("SELECT conv_id, arg_max(text, turn) AS last_text, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def q_sse_last(spark: SparkSession, sf: str) -> DataFrame:
    """The assistant's last turn of each conversation."""
    return table(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"), F.max("turn").alias("turn"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def q_tail_n(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last three events."""
    return rows.first_rows(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, errors, CASE WHEN lag(errors) OVER (ORDER BY day) IS NULL THEN 'first' WHEN errors > lag(errors) OVER (ORDER BY day) THEN 'up' WHEN errors < lag(errors) OVER (ORDER BY day) THEN 'down' ELSE 'same' END AS change FROM d""")
def q_state_change(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts against the day before; one row a day, so the ordered window stays small."""
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    before = F.lag("errors").over(Window.orderBy("day"))
    change = F.when(before.isNull(), "first").when(F.col("errors") > before, "up").when(F.col("errors") < before, "down").otherwise("same")
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "errors", change.alias("change"))


@query("SELECT n_nationkey, n_name, CAST((row_number() OVER (ORDER BY n_nationkey) - 1 - 7 + 25) % 25 AS INTEGER) AS place FROM nation")
def q_rotated_order(spark: SparkSession, sf: str) -> DataFrame:
    """The nations, a fixed list of 25, rotated by a cursor of 7."""
    return table(spark, sf, "nation").select("n_nationkey", "n_name", ((F.row_number().over(Window.orderBy("n_nationkey")) - 1 - 7 + 25) % 25).cast("int").alias("place"))


from . import audit, candidates, changes, code, evidence, exports, judgements, payloads, reports, resumed, selections, trust  # noqa: E402, F401  register their queries here

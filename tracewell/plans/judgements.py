"""Registered queries: scores and grades, guards, merges, checks, queues and their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import filters, rows
from ..sources import tables
from ..sources.tables import FINDINGS_SQL, SEVERITIES, table
from .catalog import RANK_SQL, query


def reasons(*pairs: tuple[Column, str], most: int | None = None) -> Column:
    """The texts whose conditions hold, in order, joined by commas; at most the first ``most``."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in pairs]))
    return F.array_join(F.slice(found, 1, most) if most else found, ",")


@query(f"""WITH f AS ({FINDINGS_SQL}), s AS (SELECT f.*, 70 - 15 * {RANK_SQL} + CASE status WHEN 'confirmed' THEN 20 WHEN 'candidate' THEN -10 ELSE 0 END + CASE WHEN score > 200000 THEN 15 WHEN score < 20000 THEN -5 ELSE 0 END AS raw FROM f)
SELECT id, least(100, greatest(0, raw))::INTEGER AS points, array_to_string(list_filter([CASE WHEN severity IN ('critical', 'high') THEN 'severe' END, CASE WHEN status = 'confirmed' THEN 'confirmed' END, CASE WHEN status = 'candidate' THEN 'unproven' END,
CASE WHEN score > 200000 THEN 'large' END, CASE WHEN score < 20000 THEN 'small' END], lambda x: x IS NOT NULL)[1:2], ',') AS why FROM s""")
def q_scored_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """A score from rules, clamped to 0 to 100, with the first two reasons; sorted reading is by (points, id)."""
    f = tables.findings(spark, sf)
    large, small = F.col("score") > 200000, F.col("score") < 20000
    status = F.when(F.col("status") == "confirmed", 20).when(F.col("status") == "candidate", -10).otherwise(0)
    raw = 70 - 15 * scalars.rank_of("severity", SEVERITIES) + status + F.when(large, 15).when(small, -5).otherwise(0)
    why = reasons((F.col("severity").isin("critical", "high"), "severe"), (F.col("status") == "confirmed", "confirmed"), (F.col("status") == "candidate", "unproven"), (large, "large"), (small, "small"), most=2)
    return f.select("id", F.least(F.lit(100), F.greatest(F.lit(0), raw)).cast("int").alias("points"), why.alias("why"))


@query("""WITH m AS (SELECT source, count(*) AS n, count(l.doc_id) AS labelled, count_if(n_chars < 200) AS short, count(DISTINCT lang) AS langs FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source)
SELECT source, (CAST(floor(least(labelled * 100 / n, 40)) AS INTEGER) + CASE WHEN short * 5 <= n THEN 30 ELSE 0 END + least(langs, 3) * 10)::INTEGER AS ready,
concat_ws(',', CASE WHEN labelled * 100 < 40 * n THEN 'labels' END, CASE WHEN short * 5 > n THEN 'length' END, CASE WHEN langs < 3 THEN 'languages' END) AS missing FROM m""")
def q_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Points of capped terms for each source, and what it lacks."""
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("l")).distinct()
    joined = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(labelled, F.col("l") == F.col("doc_id"), "left")
    m = joined.groupBy("source").agg(F.count("*").alias("n"), F.count("l").alias("labelled"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_distinct("lang").alias("langs"))
    few, brief, narrow = F.col("labelled") * 100 < F.col("n") * 40, F.col("short") * 5 > F.col("n"), F.col("langs") < 3
    points = F.floor(F.least(F.col("labelled") * 100 / F.col("n"), F.lit(40))) + F.when(~brief, 30).otherwise(0) + F.least(F.col("langs"), F.lit(3)) * 10
    return m.select("source", points.cast("int").alias("ready"), reasons((few, "labels"), (brief, "length"), (narrow, "languages")).alias("missing"))


@query("""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, url, html FROM pages),
t AS (SELECT page_id, CASE WHEN regexp_matches(path, '[.]html?$') THEN 'static' WHEN regexp_matches(path, '[.](php|jsp|aspx?)$') THEN 'script' ELSE 'route' END AS kind, starts_with(url, 'http://') AS plain, contains(url, 'utm_') AS tracked, regexp_matches(html, '(?i)<script') AS scripted, starts_with(host, 'm.') AS mobile FROM u)
SELECT page_id, kind, concat_ws(',', CASE WHEN mobile THEN 'mobile' END, CASE WHEN plain THEN 'plain' END, CASE WHEN scripted THEN 'scripted' END, CASE WHEN tracked THEN 'tracked' END) AS tags,
CASE WHEN plain AND scripted THEN 'high' WHEN tracked OR kind = 'script' THEN 'medium' ELSE 'low' END AS risk FROM t""")
def q_capability_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Kind by suffix, tags, and a risk level from the tags."""
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    kind = F.when(path.rlike("[.]html?$"), "static").when(path.rlike("[.](php|jsp|aspx?)$"), "script").otherwise("route")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1))
    plain, tracked, scripted, mobile = F.col("url").startswith("http://"), F.col("url").contains("utm_"), F.col("html").rlike("(?i)<script"), host.startswith("m.")
    tags = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in ((mobile, "mobile"), (plain, "plain"), (scripted, "scripted"), (tracked, "tracked"))]))
    tagged = table(spark, sf, "pages").select("page_id", kind.alias("kind"), tags.alias("t"))
    has = lambda *names: F.size(F.array_except(F.array(*[F.lit(x) for x in names]), "t")) == 0
    risk = F.when(has("plain", "scripted"), "high").when(has("tracked") | (F.col("kind") == "script"), "medium").otherwise("low")
    return tagged.select("page_id", "kind", F.array_join("t", ",").alias("tags"), risk.alias("risk"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, regexp_matches(line, '(?i)(passw|secret|token|api[_-]?key)') AS pos, regexp_matches(line, '[0-9]{3,}|[=:@]') AS strong, regexp_matches(line, '(?i)(example|sample|may be|could)') AS neg FROM s)
SELECT doc_id, CAST(max(CASE WHEN pos AND strong AND NOT neg THEN 2 WHEN pos AND NOT neg THEN 1 ELSE 0 END) AS INTEGER) AS level, count_if(pos)::BIGINT AS mentions FROM h GROUP BY doc_id HAVING count_if(pos) > 0""")
def q_polarity(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that mention a secret: 2 with evidence, 1 without, and none where the line takes it back."""
    lines = F.split("text", "\n")
    pos = lambda x: x.rlike("(?i)(passw|secret|token|api[_-]?key)")
    sure = lambda x: pos(x) & ~x.rlike("(?i)(example|sample|may be|could)")
    level = F.when(F.exists(lines, lambda x: sure(x) & x.rlike("[0-9]{3,}|[=:@]")), 2).when(F.exists(lines, sure), 1).otherwise(0)
    out = table(spark, sf, "documents").select("doc_id", level.cast("int").alias("level"), F.size(F.filter(lines, pos)).cast("long").alias("mentions"))
    return out.where("mentions > 0")


@query("""SELECT doc_id, (CASE WHEN regexp_matches(text, '[0-9]{5,}') THEN 30 ELSE 0 END + CASE WHEN contains(text, '@') THEN 25 ELSE 0 END + CASE WHEN regexp_matches(text, 'https?://') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)copyright|license') THEN -15 ELSE 0 END)::INTEGER AS evidence FROM documents""")
def q_weighted_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """A sum of weights of the patterns that a text has."""
    weights = [("[0-9]{5,}", 30), ("@", 25), ("https?://", 20), ("(?i)copyright|license", -15)]
    total = sum((F.when(F.col("text").rlike(p), w).otherwise(0) for p, w in weights), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", total.cast("int").alias("evidence"))


@query("""WITH e AS (SELECT user_id, count(DISTINCT event_type) AS kinds, count_if(event_type = 'purchase') AS bought, count_if(event_type = 'error') AS failed, avg(value) AS v FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN kinds = 0 THEN 0.35 WHEN kinds = 1 THEN least(0.82, 0.95) WHEN kinds <= 3 THEN 0.9 ELSE 0.94 END::DOUBLE AS confidence,
CASE WHEN bought > 0 AND failed > 0 THEN 'L3' WHEN bought > 0 THEN 'L2' WHEN failed > 0 THEN 'L1' ELSE 'L0' END AS level FROM e""")
def q_evidence_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence capped by the number of kinds of evidence, and a level by which of them there are."""
    of = lambda t: F.count_if(F.col("event_type") == t)
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), of("purchase").alias("bought"), of("error").alias("failed"))
    cap = F.when(F.col("kinds") == 0, 0.35).when(F.col("kinds") == 1, 0.82).when(F.col("kinds") <= 3, 0.90).otherwise(0.94)
    level = F.when((F.col("bought") > 0) & (F.col("failed") > 0), "L3").when(F.col("bought") > 0, "L2").when(F.col("failed") > 0, "L1").otherwise("L0")
    return e.select("user_id", F.least(F.lit(0.95), cap).alias("confidence"), level.alias("level"))


@query("""WITH t(kind, class) AS (VALUES ('ECONOMY', 'basic'), ('STANDARD', 'basic'), ('PROMO', 'offer'), ('LARGE', 'size'), ('SMALL', 'size')) SELECT coalesce(class, 'other') AS class, count(*) AS n FROM part LEFT JOIN t ON kind = upper(trim(p_type)) GROUP BY 1""")
def q_class_map(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of parts by class, from a fixed map; what the map lacks is other."""
    pairs = [("ECONOMY", "basic"), ("STANDARD", "basic"), ("PROMO", "offer"), ("LARGE", "size"), ("SMALL", "size")]
    known = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    name = F.coalesce(F.try_element_at(known, F.upper(F.trim("p_type"))), F.lit("other"))
    return table(spark, sf, "part").groupBy(name.alias("class")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count_if(event_type = 'error') AS failed, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN failed * 4 > n THEN 'failing' WHEN users < 5 THEN 'idle' WHEN n > 500 THEN 'busy' ELSE 'ok' END AS status FROM d""")
def q_health(spark: SparkSession, sf: str) -> DataFrame:
    """A status for each day; the first rule that applies."""
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_distinct("user_id").alias("users"))
    status = F.when(F.col("failed") * 4 > F.col("n"), "failing").when(F.col("users") < 5, "idle").when(F.col("n") > 500, "busy").otherwise("ok")
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("day"), status.alias("status"))


@query("""WITH d AS (SELECT lang, count(*) AS docs FROM documents GROUP BY 1), l AS (SELECT lang, count(*) AS labels FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, count(*) AS pages FROM pages GROUP BY 1)
SELECT lang, coalesce(docs, 0) AS docs, coalesce(labels, 0) AS labels, coalesce(pages, 0) AS pages, CASE WHEN docs IS NULL THEN 'pages_only' WHEN labels IS NULL THEN 'unlabelled' WHEN pages IS NULL THEN 'partial' WHEN labels * 4 >= docs THEN 'strong' ELSE 'weak' END AS status
FROM d FULL JOIN l USING (lang) FULL JOIN p USING (lang)""")
def q_language_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, labels and pages of each language, and a status; full joins over one row a language."""
    docs = table(spark, sf, "documents")
    d = docs.groupBy("lang").agg(F.count("*").alias("docs"))
    one = table(spark, sf, "labels").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("labels"))
    p = table(spark, sf, "pages").groupBy(F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang")).agg(F.count("*").alias("pages"))
    status = F.when(F.col("docs").isNull(), "pages_only").when(F.col("labels").isNull(), "unlabelled").when(F.col("pages").isNull(), "partial").when(F.col("labels") * 4 >= F.col("docs"), "strong").otherwise("weak")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.join(one, "lang", "full").join(p, "lang", "full").select("lang", zero("docs"), zero("labels"), zero("pages"), status.alias("status"))


GUARDS_SQL = """SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN 2 WHEN o_orderstatus = 'P' THEN 3 WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 4
WHEN o_orderstatus = 'O' AND o_totalprice > 400000 THEN 5 WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 6 WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 7 WHEN o_totalprice IS NULL THEN 8 END AS no, o_orderkey AS id FROM orders"""


@query(f"""WITH g AS ({GUARDS_SQL} UNION ALL SELECT c_custkey, 9, c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 10, c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)),
r AS (SELECT k, no, id, row_number() OVER (PARTITION BY k, no ORDER BY id) AS n, min(no) OVER (PARTITION BY k) AS first_no FROM g WHERE no IS NOT NULL)
SELECT k AS project_id, no::INTEGER AS guard_no, id FROM r WHERE no = first_no AND n <= CASE WHEN no <= 3 THEN 10 WHEN no <= 8 THEN 20 ELSE 200 END""")
def q_completion_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Ten guards in order; of each project the rows that the first failing guard names, 10, 20 or 200 at most."""
    o, status, priority = table(spark, sf, "orders"), F.col("o_orderstatus"), F.col("o_orderpriority")
    pending, open_ = status == "P", status == "O"
    checks = [
        pending & (priority == "1-URGENT"), pending & (priority == "2-HIGH"), pending, open_ & (priority == "1-URGENT"), open_ & (F.col("o_totalprice") > 400000),
        open_ & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")), open_ & (priority == "2-HIGH"), F.col("o_totalprice").isNull(),
    ]
    no = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(checks, 1))):
        no = F.when(c, i).otherwise(no)
    found = o.select(F.col("o_custkey").alias("project_id"), no.alias("guard_no"), F.col("o_orderkey").alias("id"))
    customers = table(spark, sf, "customer")
    of = lambda df, n: df.select(F.col("c_custkey").alias("project_id"), F.lit(n).alias("guard_no"), F.col("c_custkey").alias("id"))
    every = found.unionByName(of(customers.where("c_acctbal < 0"), 9)).unionByName(of(customers.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), 10)).where("guard_no is not null")
    first = every.groupBy("project_id").agg(F.min("guard_no").alias("first_no"))
    nth = F.row_number().over(Window.partitionBy("project_id", "guard_no").orderBy("id"))
    limit = F.when(F.col("guard_no") <= 3, 10).when(F.col("guard_no") <= 8, 20).otherwise(200)
    kept = every.withColumn("n", nth).where("n <= 200").where(F.col("n") <= limit)  # the fixed bound first: Spark limits ranks before the shuffle
    return kept.join(first, "project_id").where("guard_no = first_no").select("project_id", "guard_no", "id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice >= 1000 THEN NULL WHEN o_orderpriority IS NULL THEN 'no priority' WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'urgent and pending' WHEN o_orderstatus = 'P' THEN 'pending' WHEN c_custkey IS NULL THEN 'no project'
WHEN c_acctbal < 0 THEN 'project in debt' WHEN o_totalprice < 1000 THEN 'too small' WHEN o_orderstatus = 'O' THEN 'open' END AS reason FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def q_blocker_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Why an order is not done, the first of seven reasons; null if it is."""
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    why = F.when((s == "F") & (F.col("o_totalprice") >= 1000), F.lit(None)).when(p.isNull(), "no priority").when((s == "P") & (p == "1-URGENT"), "urgent and pending").when(s == "P", "pending").when(F.col("c_custkey").isNull(), "no project")
    return joined.select("o_orderkey", why.when(F.col("c_acctbal") < 0, "project in debt").when(F.col("o_totalprice") < 1000, "too small").when(s == "O", "open").alias("reason"))


@query("""SELECT 'order without customer' AS rule, count(*) AS broken FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'line without part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 50) UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def q_referential(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose reference is missing, by rule."""
    t = lambda name: table(spark, sf, name)
    rules = [
        ("order without customer", t("orders"), "o_custkey", t("customer"), "c_custkey"), ("line without order", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        ("line without part", t("lineitem"), "l_partkey", t("part").where("p_size < 50"), "p_partkey"), ("label without document", t("labels").withColumnRenamed("doc_id", "labelled"), "labelled", t("documents"), "doc_id"),
    ]
    out = None
    for name, rows_, key, owner, own in rules:
        one = rows_.join(owner.select(own), F.col(key) == F.col(own), "left_anti").agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken")
        out = one if out is None else out.unionByName(one)
    return out


CONCLUSIONS_SQL = "SELECT event_id AS id, user_id AS node, ts AS w, CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS strength, event_type AS verdict FROM events"


def conclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as conclusions about users, some stronger than others."""
    strength = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("node"), F.col("ts").alias("at"), strength.alias("strength"), F.col("event_type").alias("verdict"))


@query(f"""WITH c AS ({CONCLUSIONS_SQL}), m AS (SELECT *, max(strength) OVER (PARTITION BY node ORDER BY w, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c)
SELECT id, node, best IS NULL OR strength >= best AS activated, row_number() OVER (PARTITION BY node ORDER BY strength DESC, w DESC, id DESC) = 1 AS is_current FROM m""")
def q_guarded_activation(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each conclusion was taken when it came, which a weaker one is not, and which one holds now."""
    c = conclusions(spark, sf)
    before = F.max("strength").over(Window.partitionBy("node").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1))
    now = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("strength"), F.desc("at"), F.desc("id"))) == 1
    return c.select("id", "node", (before.isNull() | (F.col("strength") >= before)).alias("activated"), now.alias("is_current"))


@query(f"""WITH c AS ({CONCLUSIONS_SQL}), l AS (SELECT node, verdict FROM c QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, id DESC) = 1), n AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 3 = 0 THEN 'purchase' WHEN c_custkey % 3 = 1 THEN ' ' ELSE NULL END AS status FROM customer)
SELECT n.node, coalesce(l.verdict, n.status) AS status, l.verdict IS NOT NULL AND (n.status IS NULL OR trim(n.status) = '' OR n.status <> l.verdict) AS changed FROM n LEFT JOIN l USING (node)""")
def q_backfill_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes take the verdict of their latest conclusion where theirs is blank or differs."""
    latest = conclusions(spark, sf).groupBy("node").agg(F.max_by("verdict", F.struct("at", "id")).alias("verdict"))
    own = F.col("c_custkey") % 3
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.when(own == 0, "purchase").when(own == 1, " ").alias("status"))
    changed = F.col("verdict").isNotNull() & (filters.blank("status") | (F.col("status") != F.col("verdict")))
    return nodes.join(latest, "node", "left").select("node", F.coalesce("verdict", "status").alias("status"), changed.alias("changed"))


@query("""WITH s AS (SELECT l_partkey AS path, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT * FROM s WHERE y = 1997), t AS (SELECT * FROM s WHERE y = 1998), j AS (SELECT b.path AS bp, t.path AS tp, b.n AS bn, t.n AS tn FROM b FULL JOIN t USING (path)),
m AS (SELECT count(bp) AS base, count(tp) AS target, count_if(bp IS NULL OR tp IS NULL OR bn <> tn) AS changed, count_if(tp IS NULL) AS deleted FROM j)
SELECT base, target, changed, round(changed / greatest(base, target, 1), 4) AS ratio, concat_ws(',', CASE WHEN changed / greatest(base, target, 1) >= 0.35 THEN 'many changes' END, CASE WHEN deleted > 0 THEN 'deletions' END) AS reasons FROM m""")
def q_change_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """How much changed between two years, and why all of it should be looked at again."""
    year = F.year("l_shipdate")
    per = table(spark, sf, "lineitem").where(year.isin(1997, 1998)).groupBy("l_partkey").agg(F.count_if(year == 1997).alias("bn"), F.count_if(year == 1998).alias("tn"))
    m = per.agg(F.count_if(F.col("bn") > 0).alias("base"), F.count_if(F.col("tn") > 0).alias("target"), F.count_if(F.col("bn") != F.col("tn")).alias("changed"), F.count_if((F.col("bn") > 0) & (F.col("tn") == 0)).alias("deleted"))
    ratio = F.col("changed") / F.greatest("base", "target", F.lit(1))
    return m.select("base", "target", "changed", F.round(ratio, 4).alias("ratio"), reasons((ratio >= 0.35, "many changes"), (F.col("deleted") > 0, "deletions")).alias("reasons"))


FINGERPRINT_SQL = "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN sha1(concat_ws('|', 'target', o_custkey, o_orderpriority)) ELSE sha1(concat_ws('|', 'text', o_custkey, lower(trim(o_orderstatus)))) END AS fingerprint FROM orders"


@query(f"WITH f AS (SELECT id, substr(fingerprint, 1, 16) AS fingerprint FROM ({FINGERPRINT_SQL})) SELECT id, fingerprint, min(id) OVER (PARTITION BY fingerprint) AS survivor FROM f QUALIFY survivor <> id")
def q_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that repeat another's fingerprint, and the one that stays; a structured target counts before wording."""
    part = lambda kind, c: F.substring(F.sha1(F.concat_ws("|", F.lit(kind), F.col("o_custkey").cast("string"), c)), 1, 16)
    mark = F.when(F.col("o_orderstatus") == "O", part("target", F.col("o_orderpriority"))).otherwise(part("text", F.lower(F.trim("o_orderstatus"))))
    keyed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), mark.alias("fingerprint"))
    least = keyed.groupBy("fingerprint").agg(F.min("id").alias("survivor"))
    return keyed.join(least, "fingerprint").where("survivor <> id").select("id", "fingerprint", "survivor")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, min(l_orderkey * 1000000 + l_partkey) AS survivor FROM lineitem GROUP BY 1, 2), r AS (SELECT DISTINCT l_orderkey * 1000000 + l_partkey AS ref, l_orderkey, l_linenumber FROM lineitem)
SELECT ref, survivor FROM r JOIN m USING (l_orderkey, l_linenumber) WHERE ref <> survivor""")
def q_repoint(spark: SparkSession, sf: str) -> DataFrame:
    """After a merge by (order, line number): each reference to a merged row and the survivor that it points to now."""
    ref = (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("ref")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ref).distinct()
    merged = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("ref").alias("survivor"))
    return lines.join(merged, ["l_orderkey", "l_linenumber"]).where("ref <> survivor").select("ref", "survivor")


@query("""WITH r AS (SELECT p_partkey AS id, 'ref-' || p_partkey % 700 AS ref FROM part), m AS (SELECT ref, min(id) AS id FROM r GROUP BY ref) SELECT event_id, coalesce('id-' || m.id, 'ref-' || k) AS target, CASE WHEN m.id IS NULL THEN NULL ELSE 'ref-' || k END AS known_ref
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS k FROM events) LEFT JOIN m ON m.ref = 'ref-' || k""")
def q_local_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Local references resolved to ids; an unknown one stands for itself, and its own reference is null."""
    known = table(spark, sf, "part").groupBy(F.concat(F.lit("ref-"), (F.col("p_partkey") % 700).cast("string")).alias("ref")).agg(F.min("p_partkey").alias("id"))
    asked = table(spark, sf, "events").select("event_id", F.concat(F.lit("ref-"), (F.from_json("props", "k long").k * 10).cast("string")).alias("asked"))
    joined = asked.join(known, F.col("asked") == F.col("ref"), "left")
    return joined.select("event_id", F.coalesce(F.concat(F.lit("id-"), F.col("id").cast("string")), "asked").alias("target"), F.when(F.col("id").isNotNull(), F.col("asked")).alias("known_ref"))


@query("""WITH t AS (SELECT doc_id, regexp_matches(text, '(?i)(unverified|untested|guess)') AS weak, regexp_matches(text, '[a-z]+[.][a-z]+') OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS backed FROM documents)
SELECT CASE WHEN backed AND NOT weak THEN 'kept' ELSE 'dropped' END AS part, count(*) AS n FROM t GROUP BY 1""")
def q_backed_split(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with evidence and no mark against them are kept; how many are, and how many are not."""
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("g")).distinct()
    joined = table(spark, sf, "documents").join(good, F.col("g") == F.col("doc_id"), "left")
    backed = F.col("text").rlike("[a-z]+[.][a-z]+") | F.col("g").isNotNull()
    return joined.groupBy(F.when(backed & ~F.col("text").rlike("(?i)(unverified|untested|guess)"), "kept").otherwise("dropped").alias("part")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey AS project_id, count(*) AS n, count_if(o_orderstatus <> 'F') AS open FROM orders GROUP BY 1), c AS (SELECT project_id, 'complete' AS step, n AS v FROM o WHERE open = 0 UNION ALL SELECT project_id, 'stay', open FROM o WHERE open > 0)
SELECT project_id, step, v FROM c WHERE project_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT project_id, 'reopen', n FROM o WHERE open = 0 AND project_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def q_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Projects that complete, stay or, with feedback against them, are opened again: the terminal rows of those are taken out and replaced."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "F").alias("open"))
    against = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("project_id"))
    steps = o.select("project_id", F.when(F.col("open") == 0, "complete").otherwise("stay").alias("step"), F.when(F.col("open") == 0, F.col("n")).otherwise(F.col("open")).alias("v"))
    again = o.where("open = 0").join(against, "project_id", "left_semi").select("project_id", F.lit("reopen").alias("step"), F.col("n").alias("v"))
    return steps.join(against, "project_id", "left_anti").unionByName(again)


@query("""SELECT c_mktsegment AS segment, count_if(o_orderstatus = 'P') AS open_required, count_if(o_orderstatus = 'F' AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) AS missing_retest, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN c_custkey END) AS proven, min(o_orderstatus) AS least_status
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
def q_delivery_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts for some segments: open, without retest, projects with proof."""
    customers = rows.filtered(table(spark, sf, "customer"), c_mktsegment=["BUILDING", "MACHINERY"])
    joined = table(spark, sf, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    done = F.col("o_orderstatus") == "F"
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count_if(F.col("o_orderstatus") == "P").alias("open_required"), F.count_if(done & F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")).alias("missing_retest"), F.count_distinct(F.when(done, F.col("c_custkey"))).alias("proven"), F.min("o_orderstatus").alias("least_status")
    )


@query("""WITH r AS (SELECT event_id, user_id, ts, count_if(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - coalesce(max(CASE WHEN event_type = 'purchase' THEN e END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS streak, event_type
FROM (SELECT *, count_if(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS e FROM events))
SELECT event_id, user_id, streak, CASE WHEN streak >= 3 THEN 'failed' ELSE 'pending' END AS state FROM r WHERE event_type = 'error'""")
def q_retry_state(spark: SparkSession, sf: str) -> DataFrame:
    """Failures since the last success: the third in a row fails for good, earlier ones are tried again."""
    line = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = table(spark, sf, "events").withColumn("e", F.count_if(F.col("event_type") == "error").over(line))
    reset = F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("e"))).over(line), F.lit(0))
    return upto.withColumn("streak", F.col("e") - reset).where("event_type = 'error'").select("event_id", "user_id", "streak", F.when(F.col("streak") >= 3, "failed").otherwise("pending").alias("state"))


@query("SELECT conv_id, turn, right(text, 80) AS tail, length(text) > 80 AS truncated FROM conversations")
def q_text_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last 80 characters of each turn, and whether there were more."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.right("text", F.lit(80)).alias("tail"), (F.length("text") > 80).alias("truncated"))


@query("""WITH i AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{4,}'))) AS ref FROM documents), n AS (SELECT ref, count(*) AS docs, min(doc_id) AS first_doc FROM i GROUP BY ref), r AS (SELECT ref FROM n WHERE docs > 1)
SELECT doc_id, ref FROM i WHERE ref NOT IN (SELECT ref FROM r)""")
def q_retracted_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that a text names and that no other text names too: what several name counts as taken back."""
    named = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), 0))).alias("ref"))
    taken = named.groupBy("ref").agg(F.count("*").alias("docs")).where("docs > 1").select("ref")
    return named.join(taken, "ref", "left_anti").select("doc_id", "ref")


@query("""WITH u AS (SELECT page_id, string_split(trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), '/') AS s FROM pages), f AS (SELECT page_id, list_filter(s, lambda x: x <> '' AND NOT regexp_matches(x, '^([0-9]+|v[0-9]+|api|de|en|es|fr|[{:].*)$')) AS k, s FROM u)
SELECT page_id, coalesce(regexp_replace(k[1], '[.][a-z]+$', ''), 'root') AS feature, '/site/' || array_to_string(s, '/') AS joined, list_contains(s, '..') AS unsafe FROM f""")
def q_feature_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A page's first telling path segment, its route under a prefix, and whether it climbs out of it."""
    return table(spark, sf, "pages").select("page_id", scalars.feature_key(F.col("url")).alias("feature"), scalars.route_join(F.lit("/site/"), scalars.url_path(F.col("url"))).alias("joined"), (~scalars.is_safe_path(scalars.url_path(F.col("url")))).alias("unsafe"))


@query("""WITH e AS (SELECT doc_id, 'src/' || source || '/' || lang || '.txt:' || n_chars || CASE WHEN n_chars % 2 = 0 THEN ' first' ELSE '' END AS ref FROM documents)
SELECT doc_id, regexp_extract(ref, '^(.+?):([0-9]+)(.*)$', 1) AS path, CAST(regexp_extract(ref, '^(.+?):([0-9]+)(.*)$', 2) AS BIGINT) AS line, trim(regexp_extract(ref, '^(.+?):([0-9]+)(.*)$', 3)) AS note FROM e""")
def q_locators(spark: SparkSession, sf: str) -> DataFrame:
    """References of the form path:line note taken apart."""
    ref = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit(".txt:"), F.col("n_chars").cast("string"), F.when(F.col("n_chars") % 2 == 0, " first").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", scalars.locator(ref).alias("r")).select("doc_id", "r.*")


@query(f"""WITH f AS ({FINDINGS_SQL}), t AS (SELECT project_id, id, severity, row_number() OVER (PARTITION BY project_id ORDER BY {RANK_SQL}, id) AS n FROM f)
SELECT p.project_id, p.id, (SELECT string_agg(t.id, ',' ORDER BY t.n) FROM t WHERE t.project_id = p.project_id AND t.n <= 5) AS related, (SELECT count(*) FROM t WHERE t.project_id = p.project_id) AS total FROM t p WHERE n = 1""")
def q_evidence_packet(spark: SparkSession, sf: str) -> DataFrame:
    """The worst finding of each project with the first five of its project's; lists are cut to their limit before they are gathered."""
    order = [scalars.rank_of("severity", SEVERITIES), F.col("id")]
    ranked = tables.findings(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy(*order)))
    few = ranked.where("n <= 5").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("r"))
    total = tables.findings(spark, sf).groupBy("project_id").agg(F.count("*").alias("total"))
    related = F.array_join(F.transform("r", lambda x: x.id.cast("string")), ",")
    return few.join(total, "project_id").select("project_id", F.col("r")[0].id.alias("id"), related.alias("related"), "total")

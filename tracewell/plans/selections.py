"""Registered queries: optional filters, projections, positions, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import filters, graphs, rows, spans
from ..sources import tables
from ..sources.tables import FINDINGS_SQL, SEVERITIES, table
from .catalog import RANK_SQL, query


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS project_id, nullif(o_orderpriority, '5-LOW') AS priority, o_orderstatus AS status, o_orderdate AS happened, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT id, project_id, priority FROM f WHERE NOT (status = 'O' AND priority IN ('1-URGENT', '2-HIGH')) AND project_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)
AND CAST(happened AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND (c_name ILIKE '%9%' OR c_mktsegment ILIKE '%build%') AND status = 'O'""")
def q_optional_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Filters that may be absent, a negated pair (null priorities decide nothing and go), keys from a table, a search over columns, days."""
    orders = table(spark, sf, "orders").withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    joined = orders.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    kept = joined.where(filters.optional_equal("o_orderstatus", "O") & filters.optional_equal("priority", None)).where(filters.excludes(F.col("o_orderstatus") == "O", F.col("priority").isin("1-URGENT", "2-HIGH")))
    kept = kept.where(filters.between_days("o_orderdate", "1996-01-01", "1999-12-31")).where(filters.mentions(["c_name"], "9") | filters.mentions(["c_mktsegment"], "Build"))
    keys = table(spark, sf, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("o_custkey"))
    return filters.with_keys(kept, keys, "o_custkey").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), "priority")


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey = 7 OR p_brand = 'Brand#13' UNION ALL SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(concat_ws(' ', p_name, p_type)), 'promo|bolt') AND p_size IN (1, 5, 9)""")
def q_either_key(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by one key or another, and rows with any of several words in two columns and a value from a list."""
    part = table(spark, sf, "part")
    one = part.where(filters.either(p_partkey=7, p_brand="Brand#13", p_type=None))
    other = rows.filtered(part.where(filters.any_keyword(["p_name", "p_type"], ["Promo", "bolt"])), p_size=[1, 5, 9])
    return one.unionByName(other).select("p_partkey", "p_name")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id = 17""")
def q_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One row by its key; the query fails where there is none."""
    return filters.found_or_fail(table(spark, sf, "events"), "event_id", 17).select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' ORDER BY coalesce(nullif(l_linenumber, 1), 0), l_orderkey, l_partkey, l_suppkey LIMIT 40 OFFSET 10""")
def q_page_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A page of named columns under a filter; an order key that is null counts as 0."""
    order = [F.coalesce(F.nullif("l_linenumber", F.lit(1)), F.lit(0)), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")]
    return filters.page_of(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber"], order, 40, 10, "l_returnflag = 'R'")


@query(f"""WITH f AS ({FINDINGS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {RANK_SQL}, created_at DESC, id) AS n FROM f WHERE status = 'confirmed')
SELECT 'full' AS profile, project_id, id FROM r WHERE n <= 10 UNION ALL SELECT 'reason', project_id, id FROM r WHERE n <= 4 AND severity IN ('critical', 'high')
UNION ALL SELECT 'explore', project_id, id FROM r WHERE n <= 2""")
def q_profile_select(spark: SparkSession, sf: str) -> DataFrame:
    """What each profile shows of a project: profiles differ in the number of rows and in what is required."""
    order = [scalars.rank_of("severity", SEVERITIES), F.desc("created_at"), F.col("id")]
    ranked = tables.findings(spark, sf).where("status = 'confirmed'").withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy(*order))).where("n <= 10")
    serious = F.col("severity").isin("critical", "high")
    profiles = F.array_compact(F.array(F.lit("full"), F.when(F.col("n") <= 4, F.when(serious, F.lit("reason"))), F.when(F.col("n") <= 2, F.lit("explore"))))
    return ranked.select(F.explode(profiles).alias("profile"), "project_id", "id")


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS t, nullif(source, 'src0') AS source, n_chars, lang FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 57)) || '...' END AS clip, '{' || '"id":' || doc_id || CASE WHEN nullif(lang, 'en') IS NULL THEN '' ELSE ',"lang":"' || lang || '"' END || '}' AS brief,
CAST(round_even(n_chars / 8.0, 0) AS BIGINT) AS eighths, least(100, greatest(0, n_chars - 500)) AS extra FROM d""".replace("[\\s]+", "[ \\t\\n\\v\\f\\r]+"))
def q_projection_brief(spark: SparkSession, sf: str) -> DataFrame:
    """A clipped text, a JSON object without null fields, rounding half to even, and clamping."""
    docs = table(spark, sf, "documents")
    brief = filters.present(id=F.col("doc_id"), lang=F.nullif("lang", F.lit("en")))
    return docs.select("doc_id", scalars.clip(F.col("text"), 60).alias("clip"), brief.alias("brief"), F.bround(F.col("n_chars") / 8, 0).cast("long").alias("eighths"), F.least(F.lit(100), F.greatest(F.lit(0), F.col("n_chars") - 500)).alias("extra"))


@query("""WITH s AS (SELECT o_orderkey AS span_id, o_custkey AS key, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS low, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 20 + o_orderkey % 90 AS high FROM orders),
p AS (SELECT l_orderkey * 1000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS point_id, o_custkey AS key, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
i AS (SELECT point_id, span_id FROM p JOIN s USING (key) WHERE pos BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY high - low, span_id) = 1),
b AS (SELECT point_id, span_id FROM p JOIN s USING (key) WHERE low <= pos QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY low DESC, span_id) = 1)
SELECT p.point_id, coalesce(i.span_id, b.span_id) AS span_id, i.span_id IS NOT NULL AS inside FROM p LEFT JOIN i USING (point_id) LEFT JOIN b USING (point_id)""")
def q_containing_span(spark: SparkSession, sf: str) -> DataFrame:
    """For each shipped line the shortest span of its customer's orders that holds its day, else the last that had begun."""
    day = lambda c: F.date_diff(F.col(c).cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    orders = table(spark, sf, "orders")
    own = orders.select(F.col("o_orderkey").alias("span_id"), F.col("o_custkey").alias("key"), day("o_orderdate").alias("low"), (day("o_orderdate") + 20 + F.col("o_orderkey") % 90).alias("high"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = table(spark, sf, "lineitem").withColumn("nth", nth).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    points = lines.select((F.col("l_orderkey") * 1000000 + F.col("nth")).alias("point_id"), F.col("o_custkey").alias("key"), day("l_shipdate").alias("at"))
    return spans.containing_span(points, own)


INTERVALS_SQL = """SELECT o_orderkey AS id, o_custkey AS key, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS low, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 30 AS high, o_orderstatus AS s FROM orders"""


@query(f"""WITH x AS ({INTERVALS_SQL}), j AS (SELECT a.id AS left_id, b.id AS right_id, CASE WHEN a.low <= b.high AND b.low <= a.high THEN 0 ELSE least(abs(a.low - b.high), abs(b.low - a.high)) END AS distance
FROM x a JOIN x b ON a.key = b.key WHERE a.s = 'P' AND b.s = 'F') SELECT left_id, right_id, distance::BIGINT AS distance FROM j QUALIFY rank() OVER (PARTITION BY left_id ORDER BY distance) = 1""")
def q_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Pending orders' intervals against finished ones of the customer: all at the smallest distance, 0 where they overlap."""
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    both = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("key"), day.alias("low"), (day + F.col("o_orderkey") % 30).alias("high"))
    side = lambda status, name: both.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias(name), "key", "low", "high")
    return spans.overlap_scores(side("P", "left_id"), side("F", "right_id"))


@query("""WITH n AS (SELECT item_id AS needle_id, regexp_extract(text, '^(?:\\S+ ){6}\\S+') AS needle FROM benchmark) SELECT doc_id AS id, needle_id FROM documents JOIN n ON contains(text, needle) WHERE needle <> ''""")
def q_contains_theta(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain the first seven words of a benchmark item."""
    needles = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle_id"), F.regexp_extract("text", r"^(?:\S+ ){6}\S+", 0).alias("needle")).where("needle <> ''")
    return spans.containing_texts(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), needles)


@query("SELECT doc_id AS id, item_id AS needle_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE regexp_matches(b.text, '^[^ ]* [^ ]+ [^ ]')")
def q_contains_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a whole benchmark item as it is; items of two words are not looked for."""
    needles = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    return spans.containing_texts(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), needles)


def match_scores(found: DataFrame, expected: DataFrame, least: int = 55) -> DataFrame:
    """(a, b, score) of expectations ``a`` and findings ``b`` of one key with a score of at least ``least`` of 100.

    Both have (id, key, kind, place, label): 40 for the kind, 35 for the place, 25 for the label.
    """
    f = found.select(F.col("id").alias("b"), "key", *[F.col(c).alias(f"f_{c}") for c in ("kind", "place", "label")])
    part = lambda c, n: F.when(F.col(c) == F.col(f"f_{c}"), n).otherwise(0)
    # a score of 55 takes two equal columns: pairs meet on those, not on the key alone
    pairs = None
    for two in (("kind", "place"), ("kind", "label"), ("place", "label")):
        both = expected.join(f, [expected["key"] == f["key"], *[expected[c] == f[f"f_{c}"] for c in two]]).select(F.col("id").alias("a"), "b", (part("kind", 40) + part("place", 35) + part("label", 25)).alias("score"))
        pairs = both if pairs is None else pairs.unionByName(both)
    return pairs.where(F.col("score") >= least).distinct()


def match_metrics(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(true_positives, false_positives, false_negatives, precision, recall, f1) after matching one to one, best scores first; 0 of 0 is 1."""
    taken = graphs.greedy_pairs(match_scores(found, expected))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(taken, "tp").crossJoin(n(found, "found")).crossJoin(n(expected, "expected"))  # three rows of one number each
    p, r = scalars.ratio(F.col("tp"), F.col("found")), scalars.ratio(F.col("tp"), F.col("expected"))
    out = one.select(F.col("tp").alias("true_positives"), (F.col("found") - F.col("tp")).alias("false_positives"), (F.col("expected") - F.col("tp")).alias("false_negatives"), p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 4)))


@query()
def q_match_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Finished orders as findings against pending ones as expectations of the customer, by priority, year and price class."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("kind"), F.year("o_orderdate").alias("place"), F.floor(F.col("o_totalprice") / 50000).alias("label"), "o_orderstatus"
    )
    return match_metrics(orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), orders.where("o_orderstatus = 'P'").drop("o_orderstatus"))


@query("""WITH p AS (SELECT p_type AS kind, p_brand AS name, count(*) AS n FROM part GROUP BY 1, 2), o AS (SELECT kind, name, n FROM p WHERE n > 1)
SELECT kind, string_agg(name || '=' || n, ',' ORDER BY name) AS histogram, sum(n)::BIGINT AS total FROM o GROUP BY kind""")
def q_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by two keys, then one text a kind with its entries in order; entries are as many as brands, not rows."""
    counts = table(spark, sf, "part").groupBy(F.col("p_type").alias("kind"), F.col("p_brand").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("name", "n"))), lambda x: F.concat_ws("=", x["name"], x["n"].cast("string")))
    return counts.groupBy("kind").agg(F.array_join(entries, ",").alias("histogram"), F.sum("n").alias("total"))


def count_by(df: DataFrame, field: str, limit: int) -> DataFrame:
    """(value, n) of a column named by the caller, the most frequent first, then by value; blanks are left out."""
    counts = df.groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.where(~filters.blank("value")).orderBy(F.desc("n"), "value").limit(limit)


@query("""SELECT * FROM (SELECT 'part' AS source, CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, value LIMIT 5) UNION ALL
SELECT * FROM (SELECT 'events', event_type, count(*) AS n FROM events WHERE trim(event_type) <> '' GROUP BY 2 ORDER BY n DESC, event_type LIMIT 5)""")
def q_count_by_field(spark: SparkSession, sf: str) -> DataFrame:
    """The five most frequent values of two columns."""
    of = lambda name, field: count_by(table(spark, sf, name), field, 5).select(F.lit(name).alias("source"), "value", "n")
    return of("part", "p_size").unionByName(of("events", "event_type"))


@query("""WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus AS t FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), b AS (SELECT DISTINCT o_custkey, o_orderstatus AS t FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'),
u AS (SELECT c_custkey, list_sort(coalesce((SELECT list(t) FROM a WHERE o_custkey = c_custkey), [])) AS x, list_sort(coalesce((SELECT list(t) FROM b WHERE o_custkey = c_custkey), [])) AS y FROM customer)
SELECT c_custkey, array_to_string(list_concat(x, list_filter(y, lambda t: NOT list_contains(x, t))), ',') AS statuses, list_has_all(y, x) AS subset, list_has_any(x, y) AS meets FROM u""")
def q_array_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses before and since 1997 of each customer: joined in order of appearance, whether the first are among the second, whether they meet."""
    orders = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("t"), (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")).alias("early"))
    per = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.when(F.col("early"), F.col("t")))).alias("x"), F.array_sort(F.collect_set(F.when(~F.col("early"), F.col("t")))).alias("y"))
    empty = F.array().cast("array<string>")
    both = table(spark, sf, "customer").join(per, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("x", empty).alias("x"), F.coalesce("y", empty).alias("y"))
    return both.select("c_custkey", F.array_join(filters.unique_in_order(F.col("x"), F.col("y")), ",").alias("statuses"), (F.size(F.array_except("x", "y")) == 0).alias("subset"), F.arrays_overlap("x", "y").alias("meets"))


@query("""SELECT p.p_partkey, p.p_name, q.p_name AS other, levenshtein(p.p_name, q.p_name)::INTEGER AS edits FROM (SELECT DISTINCT ON (p_name) p_name, p_partkey FROM part ORDER BY p_name, p_partkey) p
JOIN (SELECT DISTINCT p_name FROM part) q ON p.p_name < q.p_name AND split_part(p.p_name, ' ', 2) = split_part(q.p_name, ' ', 2) WHERE levenshtein(p.p_name, q.p_name) <= 3""")
def q_fuzzy_title(spark: SparkSession, sf: str) -> DataFrame:
    """Different names of one head word that are at most three edits apart; names are collapsed first."""
    names = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")).withColumn("head", F.split_part("p_name", F.lit(" "), F.lit(2)))
    other = names.select(F.col("p_name").alias("other"), "head")
    return names.join(other, "head").where("p_name < other").withColumn("edits", F.levenshtein("p_name", "other", 3)).where("edits >= 0").select("p_partkey", "p_name", "other", "edits")

"""Registered queries about changes of tables: streams into tables, deletion with what hangs on it, budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import rows
from ..sources import tables, zips
from ..sources.tables import FINDINGS_SQL, SEVERITIES, table
from ..streaming import sinks
from .catalog import RANK_SQL, query


@query("""SELECT 'pages/' || page_id || '.html' AS path, octet_length(encode(coalesce(html, '')))::BIGINT AS size, sha256(coalesce(html, '')) AS sha256, NULL::VARCHAR AS problem FROM pages""")
def q_archive_members(spark: SparkSession, sf: str) -> DataFrame:
    """The pages written as ZIP archives, a member each, and read back as a table of members."""
    place = f"{tables.shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    pages = table(spark, sf, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "html")
    zips.write(pages, "path", "html", place)
    spark.dataSource.register(zips.ZipMembers)
    return spark.read.format("zip_members").option("path", place).load().select("path", "size", "sha256", "problem")


@query("""SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def q_stream_append_once(spark: SparkSession, sf: str) -> DataFrame:
    """The event log streamed into a table, then the same batches once more from the start: every row is there once."""
    source, place = table(spark, sf, "events"), f"{tables.shared_dir(spark)}/appended-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events*.parquet")
    into = sinks.BatchTable(spark, f"{place}/table", source.schema)
    for run in range(2):  # the second run has lost its checkpoint
        sinks.drain(stream, into.append(), f"{place}/state-{run}")
    return into.read().groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY 1, 2""")
def q_stream_insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each user and kind, inserted from a stream; what comes later is ignored, and so is a second run."""
    source, place = table(spark, sf, "events"), f"{tables.shared_dir(spark)}/inserted-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events*.parquet")
    into = sinks.BatchTable(spark, f"{place}/table", source.schema)
    for run in range(2):
        sinks.drain(stream, into.insert_missing(["user_id", "event_type"], [F.col("event_id")]), f"{place}/state-{run}")
    return into.read().select("user_id", "event_type", F.col("event_id").alias("first_event"))


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey >= 3), o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 3)), l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 3) ON o_custkey = c_custkey)),
e AS (SELECT CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 3) THEN NULL ELSE user_id END AS user_id FROM events)
SELECT 'customer' AS name, count(*) AS n, count(c_custkey) AS referring FROM c UNION ALL SELECT 'orders', count(*), count(o_custkey) FROM o UNION ALL SELECT 'lineitem', count(*), count(l_orderkey) FROM l UNION ALL SELECT 'events', count(*), count(user_id) FROM e""")
def q_cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of three nations deleted: their orders and the lines of those go with them, their events stay without a user."""
    line = F.monotonically_increasing_id().alias("line")
    held = {"customer": table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "orders": table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "lineitem": table(spark, sf, "lineitem").select("l_orderkey", line), "events": table(spark, sf, "events").select("event_id", "user_id")}
    refers = [("orders", "o_custkey", "customer", "cascade"), ("lineitem", "l_orderkey", "orders", "cascade"), ("events", "user_id", "customer", "null")]
    left = rows.cascade(held, {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "line", "events": "event_id"}, refers, {"customer": held["customer"].where("c_nationkey < 3")})
    counted = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count(column).alias("referring")) for (name, df), column in zip(left.items(), ("c_custkey", "o_custkey", "l_orderkey", "user_id"), strict=True)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


#: Bytes of an export, and of what is required in it.
SOFT, HARD = 240, 400
_SIZE = """length('{"id":' || id || ',"severity":"' || severity || '","status":"' || status || '"}') + 1"""


@query(f"""WITH f AS (SELECT id, project_id, severity, {RANK_SQL} AS rank, {_SIZE} AS size FROM ({FINDINGS_SQL})), t AS (SELECT *, sum(size) OVER (PARTITION BY project_id ORDER BY rank >= 2, rank, id ROWS UNBOUNDED PRECEDING) AS total FROM f)
SELECT project_id, id, severity, (total - size)::BIGINT AS bytes_before, rank < 2 AND total > {SOFT} AS forced FROM t WHERE total <= {SOFT} OR rank < 2 AND total <= {HARD}""")
def q_budget_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The findings that each project's export of 240 bytes holds, worst first; critical and high ones up to 400."""
    size = F.length(F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"severity":"'), F.col("severity"), F.lit('","status":"'), F.col("status"), F.lit('"}'))) + 1
    found = tables.findings(spark, sf).select("id", "project_id", "severity", size.cast("long").alias("size"), scalars.rank_of("severity", SEVERITIES).alias("rank"))
    return rows.within_budget(found, "project_id", ["rank", "id"], "size", F.col("rank") < 2, SOFT, HARD).select("project_id", "id", "severity", "bytes_before", "forced")

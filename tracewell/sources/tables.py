"""Tables, and views of them in the shape that the operators work on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severities from worst to least, and the order priorities that stand for them.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = {"F": "confirmed", "P": "pending_review", "O": "candidate"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(column: str, pairs: dict[str, str], default: str | None = None) -> F.Column:
    """A fixed mapping as a CASE, which the optimiser folds and pushes."""
    out = F.lit(default)
    for key, value in reversed(pairs.items()):
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("project_id"),
        mapped("o_orderpriority", dict(zip(PRIORITIES, SEVERITIES, strict=True))).alias("severity"),
        mapped("o_orderstatus", STATUSES).alias("status"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderdate").alias("created_at"),
    )


def task_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("worker"),
        F.col("ts").alias("started_at"),
        mapped("event_type", {"error": "failed", "purchase": "success", "signup": "released"}, "other").alias("outcome"),
        F.col("value").alias("duration"),
    )


#: The same views for the SQL side.
FINDINGS_SQL = """SELECT o_orderkey AS id, o_custkey AS project_id,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'low' WHEN '5-LOW' THEN 'info' END AS severity,
 CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'pending_review' WHEN 'O' THEN 'candidate' END AS status,
 o_totalprice AS score, o_orderdate AS created_at FROM orders"""
HISTORY_SQL = """SELECT event_id AS id, user_id AS worker, ts AS started_at,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'released' ELSE 'other' END AS outcome, value AS duration FROM events"""
LINE_EDGES_SQL = """SELECT a, b FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b"""
EDGES_SQL = LINE_EDGES_SQL.replace("SELECT a, b", "SELECT DISTINCT a, b", 1)
TRUSTED_EDGES_SQL = """SELECT a, b, confidence FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS b,
 CASE WHEN abs(l_discount - 0.05) > 0.001 THEN 0.5::DOUBLE + floor(l_quantity / 10) / 10 END AS confidence FROM lineitem) WHERE b IS NOT NULL AND a <> b"""
HUBS_SQL = "SELECT p_partkey AS node FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20"


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges between consecutive parts of an order, one for each time that they follow one another."""
    from pyspark.sql import Window

    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(line).alias("b"))
    return rows.where("b is not null and a <> b")


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct ones of ``line_edges``."""
    return line_edges(spark, sf_dir).distinct()


def trusted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, confidence): ``line_edges`` with a confidence of 0.5 to 1 by the quantity of the first of both lines; lines with a discount of 0.05 tell none."""
    from pyspark.sql import Window

    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    sure = F.when(F.abs(F.col("l_discount") - 0.05) > 0.001, 0.5 + F.floor(F.col("l_quantity") / 10) / 10)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(line).alias("b"), sure.alias("confidence"))
    return rows.where("b is not null and a <> b")


#: The steps of every order as SQL: its lines in order, each number once.
STEPS_SQL = "SELECT l_orderkey AS o, l_linenumber AS k, min(l_quantity) >= 10 AS passes, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2"


def program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): the orders as program text, a file for each line and one for each order.

    An order is a web handler that hands an input to the step of its first line; each step hands it on to the next, unless its
    quantity is below 10, which replaces it; returned lines give it to the shell. Urgent orders evaluate what comes back.
    """
    from pyspark.sql import Window

    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k")).agg((F.min("l_quantity") >= 10).alias("passes"), F.max("l_returnflag").alias("flag"))
    line = line.withColumn("next", F.lead("k").over(Window.partitionBy("o").orderBy("k")))
    text = lambda pattern, *columns: F.format_string(pattern, *columns)
    nothing = F.lit("")
    step = F.concat(
        text("def step_%d_%d(x):\n", "o", "k"), F.when(F.col("passes"), text("    y = x + '%s'\n", "flag")).otherwise(F.lit("    y = 'fixed'\n")), F.when(F.col("flag") == "R", F.lit("    os.system(y)\n")).otherwise(nothing),
        F.when(F.col("next").isNotNull(), text("    z = step_%1$d_%2$d(y)\n    return z\nfrom orders.o%1$d.step%2$d import step_%1$d_%2$d\n", "o", "next")).otherwise(F.lit("    return y\n")),
    )
    steps = line.select(text("orders/o%d/step%d.py", "o", "k").alias("path"), step.alias("content"))
    first = line.groupBy("o").agg(F.min("k").alias("first"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), "o_orderpriority").join(first, "o", "left")
    body = F.when(F.col("first").isNotNull(), text("    r = step_%d_%d(q)\n", "o", "first")).otherwise(F.lit("    r = q\n"))
    main = F.concat(text("@app.get('/orders/%d')\ndef show_%d():\n    q = request.args['q']\n", "o", "o"), body, F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("    eval(r)\n")).otherwise(nothing), F.lit("    return r\n"), F.when(F.col("first").isNotNull(), text("from orders.o%1$d.step%2$d import step_%1$d_%2$d\n", "o", "first")).otherwise(nothing))
    return steps.unionByName(orders.select(text("orders/o%d/main.py", "o").alias("path"), main.alias("content")))


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node): the 20 dearest parts, which queries ask about where an answer for every part would be all pairs."""
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select(F.col("p_partkey").alias("node"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a new one where none is set, on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    if not base:
        base = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")

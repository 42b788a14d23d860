"""Contiguous shards of nearly equal size, cut on a global prefix sum of bytes.

Rows are dealt by range and sorted within partitions; each partition yields its total, the
totals' running sums (one number a partition) give every partition its start, and a row's
shard follows from the byte offset at which it begins. The order is (text digest, id), so
equal texts lie together and a large group of them still spreads over partitions.
A group of equal texts no larger than ``whole`` of a shard stays in the shard where it begins, also where it lies in
two partitions; a larger one is cut like anything else, since shards would not balance otherwise.

Null texts have no bytes (and the checksum 0); null ids sort first. Repeated rows keep separate slots.
Fewer rows than shards leave shards empty. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of one range; more rows make more ranges.
RANGE_ROWS = 500_000


def weighed(docs: DataFrame, id: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """(id, size, text_crc32, text_key): what sharding needs of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id).alias("doc_id"),
        (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("text_key"),
    )


def cut(rows: DataFrame, shards: int, whole: float = 0.01, partitions: int | None = None) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows of (doc_id, size, text_key, ...)."""
    spark = rows.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    # the last key only deals out rows that repeat both others
    order = ("text_key", "doc_id", "copy")
    dealt = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("copy")
    # a partition's rows carry its number and their place in it; written, since range bounds are sampled anew each time
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "ranged")
    ends = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("text_key").alias("first_key"), F.max("text_key").alias("last_key"))
    outer = dealt.join(F.broadcast(ends.select("part", "first_key", "last_key")), "part").groupBy("part")
    outer = outer.agg(*[F.sum(F.when(F.col("text_key") == F.col(f"{x}_key"), F.col("size"))).alias(f"{x}_bytes") for x in ("first", "last")])
    parts = ends.join(outer, "part").orderBy("part").collect()  # a row for each partition
    starts, total = group_starts(parts)
    target = max(1, -(-total // shards))
    known = spark.createDataFrame(starts, "part int, start_bytes long, start_rows long, first_key long, first_begin long, first_total long, last_key long, last_begin long, last_total long")

    line, group = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("part", "text_key")
    placed = dealt.join(F.broadcast(known), "part").withColumns({"own_begin": F.col("start_bytes") + F.sum("size").over(line) - F.col("size"), "row_number": F.col("start_rows") + F.count("*").over(line) - 1})
    placed = placed.withColumns({"group_begin": F.min("own_begin").over(group), "group_total": F.sum("size").over(group)})
    # a group at a partition's edge may begin before it or go on behind it
    edge = lambda x, inside: F.when(F.col("text_key") == F.col("first_key"), F.col(f"first_{x}")).when(F.col("text_key") == F.col("last_key"), F.col(f"last_{x}")).otherwise(F.col(inside))
    begin = F.when(edge("total", "group_total") <= int(target * whole), edge("begin", "group_begin")).otherwise(F.col("own_begin"))
    placed = placed.withColumn("shard", F.least(F.floor(begin / target), F.lit(shards - 1)).cast("int")).select(*rows.columns, "shard", "row_number")
    placed = stored(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("row_number").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("row_number") - F.col("first_row")).drop("first_row", "row_number")


def group_starts(parts: list[Row]) -> tuple[list[tuple[int, ...]], int]:
    """For each partition where its bytes and rows start, and beginning and bytes of its first and its last group of equal texts, wherever they begin and end."""
    groups, owners, start_bytes, start_rows, previous = [], [], 0, 0, None
    for p in parts:
        if previous is None or previous != p["first_key"]:
            groups.append([start_bytes, 0])
        groups[-1][1] += p["first_bytes"]
        first = groups[-1]
        if p["last_key"] != p["first_key"]:
            groups.append([start_bytes + p["bytes"] - p["last_bytes"], p["last_bytes"]])
        owners.append((p["part"], start_bytes, start_rows, p["first_key"], first, p["last_key"], groups[-1]))
        previous = p["last_key"]
        start_bytes += p["bytes"]
        start_rows += p["rows"]
    return [(part, at, row, a, *first, b, *last) for part, at, row, a, first, b, last in owners], start_bytes

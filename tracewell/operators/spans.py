"""Joins by position: the span that holds a point, the nearest point, overlaps of intervals, texts that contain others.

None pairs all rows of a key: spans are cut into buckets and joined by bucket, nearest rows come from ordered
windows, and texts meet by a word. Null keys and positions match nothing. Results do not depend on partitioning,
as every order ends in an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


#: Levels begin at blocks of two to the power of this many positions.
LOW_LEVEL = 6


def _level(low: str, high: str) -> Column:
    """The least level whose blocks are longer than an interval, so that it touches two of them at most."""
    size = F.greatest(F.col(high).cast("double") - F.col(low).cast("double"), F.lit(0.0))
    return F.greatest(F.lit(LOW_LEVEL), F.floor(F.log2(size + 1)).cast("int") + 1)


def _block(at: Column | str, level: Column | str) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.pow(F.lit(2.0), level)).cast("long")


def _levels(intervals: DataFrame) -> list[int]:
    """The levels in use, 60 at most."""
    return sorted(r["level"] for r in intervals.select("level").distinct().collect())


def containing_span(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(point_id, span_id, inside) for each point: the smallest span of its key that holds it, else the last that begins before it, else null.

    ``points`` has (point_id, key, at), ``spans`` has (span_id, key, low, high). Equal spans: the smallest id. A span
    lies in one or two blocks of the level of its length, however long it is, and a point asks once on each level in use.
    """
    points, spans = kept(points.select("point_id", "key", "at"), "points"), kept(spans.select("span_id", "key", "low", "high").withColumn("level", _level("low", "high")), "spans")
    sound = spans.where("low <= high")
    cut = sound.withColumn("block", F.explode(F.sequence(_block("low", "level"), _block("high", "level"))))
    asked = points.withColumn("l", F.explode(F.array([F.lit(n) for n in _levels(sound)]).cast("array<int>"))).select("point_id", F.col("key").alias("k"), "at", "l", _block("at", "l").alias("b"))
    hit = asked.join(cut, (F.col("k") == F.col("key")) & (F.col("l") == F.col("level")) & (F.col("b") == F.col("block")) & F.col("at").between(F.col("low"), F.col("high")))
    best = hit.groupBy("point_id").agg(F.min(F.struct((F.col("high") - F.col("low")).alias("size"), "span_id")).alias("best")).select(F.col("point_id").alias("held"), F.col("best.span_id").alias("inner_id"))
    # the last span that begins at or before a point: one ordered pass over both
    begins = spans.select("key", F.col("low").alias("at"), F.lit(0).alias("kind"), (-F.col("span_id")).alias("tie"), "span_id", F.lit(None).cast("long").alias("point_id"))
    asks = points.select("key", "at", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast("long").alias("span_id"), "point_id")
    line = Window.partitionBy("key").orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    before = begins.unionByName(asks).where("key is not null and at is not null").withColumn("last_id", F.last("span_id", ignorenulls=True).over(line)).where("kind = 1").select("point_id", "last_id")
    out = points.select("point_id").join(before, "point_id", "left").join(best, F.col("point_id") == F.col("held"), "left")
    return out.select("point_id", F.coalesce("inner_id", "last_id").alias("span_id"), F.col("inner_id").isNotNull().alias("inside"))


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, distance): for each left row the right row of its key with the smallest distance, then the smallest id.

    ``left`` has (left_id, key, at), ``right`` has (right_id, key, at). The nearest row is the last one before or the
    first one behind, so two passes over the ordered union find it.
    """
    other = right.where("key is not null and at is not null").groupBy("key", "at").agg(F.min("right_id").alias("right_id"))
    both = other.select("key", "at", F.lit(0).alias("kind"), "right_id", F.lit(None).cast("long").alias("left_id")).unionByName(left.select("key", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("right_id"), "left_id"))
    found = F.when(F.col("kind") == 0, F.struct("at", "right_id"))
    line = Window.partitionBy("key").orderBy("at", "kind")
    back = F.last(found, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(found, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    asked = both.withColumns({"back": back, "ahead": ahead}).where("kind = 1 and key is not null and at is not null")
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("at")).alias("distance"), F.col(f"{c}.right_id").alias("right_id")))
    return asked.withColumn("best", F.least(side("back"), side("ahead"))).where("best is not null").select("left_id", "best.right_id", "best.distance")


def exact_or_nearest(left: DataFrame, right: DataFrame, n: int = 2) -> DataFrame:
    """(left_id, right_id, distance): the first ``n`` right rows at a left row's own position, or else the one nearest row.

    ``left`` has (left_id, key, at), ``right`` has (right_id, key, at, priority). Rows at one distance follow by
    priority, then id. The right side is cut to ``n`` rows a position before it is joined, and nearest rows come from
    two passes over the ordered union, so a busy position or key makes no pairs.
    """
    asked = left.where("key is not null and at is not null").select("left_id", "key", "at")
    placed = right.where("key is not null and at is not null").select("right_id", "key", "at", "priority")
    first = placed.withColumn("n", F.row_number().over(Window.partitionBy("key", "at").orderBy("priority", "right_id"))).where(F.col("n") <= n)
    same = asked.join(first, ["key", "at"]).select("left_id", "right_id", F.lit(0).cast("long").alias("distance"))
    best = placed.groupBy("key", "at").agg(F.min(F.struct("priority", "right_id")).alias("best"))
    alone = asked.join(best.select("key", "at"), ["key", "at"], "left_anti")
    both = best.withColumn("left_id", F.lit(None).cast("long")).unionByName(alone, allowMissingColumns=True)
    found = F.when(F.col("best").isNotNull(), F.struct("at", "best"))
    line = Window.partitionBy("key").orderBy("at")
    back = F.last(found, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(found, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("at")).cast("long").alias("distance"), F.col(f"{c}.best").alias("best")))
    near = both.withColumns({"back": back, "ahead": ahead}).where("left_id is not null").withColumn("nearest", F.least(side("back"), side("ahead"))).where("nearest is not null")
    return same.unionByName(near.select("left_id", F.col("nearest.best.right_id").alias("right_id"), F.col("nearest.distance").alias("distance")))


def overlap_scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, distance): all right intervals of a left interval's key at the smallest distance, 0 for an overlap.

    ``left`` has (left_id, key, low, high), ``right`` has (right_id, key, low, high). Two intervals meet on the level of the longer
    one, in the block in which their intersection begins; an interval has a row or two for each level in use from its own on. For
    intervals without an overlap one ordered pass finds the nearest end before and the nearest beginning behind, and the
    right intervals with that end or beginning are joined back.
    """
    own = kept(left.where("low <= high").select("left_id", "key", "low", "high").withColumn("level", _level("low", "high")), "left-intervals")
    other = kept(right.where("low <= high").select("right_id", F.col("key").alias("k"), F.col("low").alias("l"), F.col("high").alias("h")).withColumn("own_level", _level("l", "h")), "right-intervals")
    levels = F.array([F.lit(n) for n in sorted({*_levels(own), *_levels(other.select(F.col("own_level").alias("level")))})]).cast("array<int>")

    def dealt(df: DataFrame, low: str, high: str, level: str, at: str, block: str) -> DataFrame:
        upward = df.withColumn(at, F.explode(F.filter(levels, lambda n: n >= F.col(level))))
        return upward.withColumn(block, F.explode(F.sequence(_block(low, at), _block(high, at))))

    begins = _block(F.greatest("low", "l"), F.col("at_level"))
    where = (F.col("k") == F.col("key")) & (F.col("at_level") == F.col("on_level")) & (F.col("b") == F.col("block"))
    meet = dealt(own, "low", "high", "level", "at_level", "block").join(dealt(other, "l", "h", "own_level", "on_level", "b"), where & (F.col("at_level") == F.greatest("level", "own_level")) & (F.col("block") == begins) & (F.col("l") <= F.col("high")) & (F.col("h") >= F.col("low")))
    overlap = kept(meet.select("left_id", "right_id", F.lit(0).cast("long").alias("distance")), "overlaps")
    alone = own.join(overlap, "left_id", "left_anti")
    none = F.lit(None).cast("long")
    # a beginning or an end at an asked position would be an overlap, so rows at one position need no order among them
    edges = F.array(F.struct(F.col("l").alias("at"), F.lit("begin").alias("kind")), F.struct(F.col("h").alias("at"), F.lit("end").alias("kind")))
    asks = F.array(F.struct(F.col("low").alias("at"), F.lit("low").alias("kind")), F.struct(F.col("high").alias("at"), F.lit("high").alias("kind")))
    marks = other.where("k is not null").select(F.col("k").alias("key"), F.explode(edges).alias("x")).select("key", "x.at", "x.kind").distinct()
    line = Window.partitionBy("key").orderBy("at", "kind")
    edge = lambda kind: F.when(F.col("kind") == kind, F.col("at"))
    both = marks.withColumn("left_id", none).unionByName(alone.where("key is not null").select("key", F.explode(asks).alias("x"), "left_id").select("key", "x.at", "x.kind", "left_id"))
    seen = both.withColumns({"back": F.last(edge("end"), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "ahead": F.first(edge("begin"), ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))})
    asked = seen.where("left_id is not null").select("left_id", "key", F.when(F.col("kind") == "low", F.struct((F.col("at") - F.col("back")).alias("distance"), F.col("back").alias("edge"), F.lit("end").alias("kind"))).otherwise(F.struct((F.col("ahead") - F.col("at")).alias("distance"), F.col("ahead").alias("edge"), F.lit("begin").alias("kind"))).alias("x")).select("left_id", "key", "x.*").where("edge is not null")
    near = asked.groupBy("left_id", "key").agg(F.min("distance").alias("distance"), F.collect_list(F.struct("distance", "edge", "kind")).alias("sides"))  # two at most
    near = near.select("left_id", "key", "distance", F.explode(F.filter("sides", lambda x: x.distance == F.col("distance"))).alias("x")).select("left_id", "key", "distance", "x.edge", "x.kind")
    ends = other.select("right_id", "k", F.explode(edges).alias("e")).select("right_id", "k", F.col("e.at").alias("e"), F.col("e.kind").alias("kind_of"))
    rest = near.join(ends, (F.col("key") == F.col("k")) & (F.col("edge") == F.col("e")) & (F.col("kind") == F.col("kind_of")))
    return overlap.unionByName(rest.select("left_id", "right_id", F.col("distance").cast("long").alias("distance")).distinct())


def containing_texts(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(id, needle_id): texts that contain a needle as it is, without pairing them all.

    ``texts`` has (id, text), ``needles`` has (needle_id, needle) of three blank-separated words or more; others are not
    looked for. The join key is the inner word of a needle, which a text must have between blanks, that the fewest texts have;
    only words of needles leave the scan of the texts. What meets is checked.
    """
    parts = F.split("needle", " ")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    asked = needles.select("needle_id", F.explode(F.array_distinct(inner)).alias("word")).where("word <> ''")
    held = kept(texts.select("id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).join(asked.select("word").distinct(), "word", "left_semi"), "words")
    counted = asked.join(held.groupBy("word").agg(F.count("*").alias("n")), "word", "left")
    anchors = counted.groupBy("needle_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("x")).select("needle_id", F.col("x.word").alias("word"))
    meet = held.join(anchors, "word").select("id", "needle_id")
    return meet.join(texts, "id").join(needles, "needle_id").where(F.col("text").contains(F.col("needle"))).select("id", "needle_id").distinct()


def line_frames(lines: DataFrame, hits: DataFrame, radius: int) -> DataFrame:
    """(path, hit, excerpt): the lines from ``radius`` before a hit to as many behind it, numbered.

    ``lines`` has (path, line, text), ``hits`` has (path, line). Each hit asks for its 2 * radius + 1 lines by
    number, so no file is gathered. Stored hits are far smaller than in memory, so a join must not go by their size and hand
    them all to the driver: both sides are dealt by path and line.
    """
    asked = hits.select("path", F.col("line").alias("hit")).distinct().withColumn("line", F.explode(F.sequence(F.col("hit") - radius, F.col("hit") + radius)))
    found = asked.hint("merge").join(lines, ["path", "line"])
    numbered = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: F.concat_ws(": ", x.line.cast("string"), x.text))
    return found.groupBy("path", "hit").agg(F.array_join(numbered, "\n").alias("excerpt"))


def look_back(sources: DataFrame, sinks: DataFrame, distance: int) -> DataFrame:
    """(path, source_line, sink_line) with the source at most ``distance`` lines before the sink, joined by blocks of lines."""
    block = lambda c: F.floor(F.col(c) / (distance + 1))
    near = sources.select("path", F.col("line").alias("source_line")).withColumn("block", F.explode(F.array(block("source_line"), block("source_line") + 1)))
    ends = sinks.select("path", F.col("line").alias("sink_line")).withColumn("block", block("sink_line"))
    gap: Column = F.col("sink_line") - F.col("source_line")
    return near.join(ends, ["path", "block"]).where(gap.between(0, distance)).select("path", "source_line", "sink_line").distinct()

"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks, in DataFrame functions only.

A text's size is its number of words. Sources stand by code point, null last, and take weights that repeat; they share
``share`` of all words by weight, none beyond ``most`` times its own words (the excess is shared again). Every source's
documents are laid out in seeded order and cut into blocks of equally many words; blocks are awarded to the sources by
their highest quotients target / (2 k + 1), no source more than ``most`` times its blocks. Awards in that order fill the
shards one after the other, which gives each shard a whole quota of every source: Sainte-Laguë counts never fall as the
number of seats grows, so each shard holds about the mix. A source's k-th award is the k-th block of its seeded order,
a new order for each time around.

``resolution`` is the number of blocks in the mix, so a source's words differ from its target by about one block, the
``resolution``-th part of all words (a single word where that is less); the tables of blocks and awards have a bounded
number of rows, some 1.4 times ``resolution`` and one or two for each source. Global ranks and running totals are those
of ranges plus those of the ranges before, so that no source and no table passes one task.

Null texts and texts without words have size 0 and are taken 0 times; sources of nothing have target 0. Repeated rows
are documents of their own. Ties are broken by id, size and a hash of the text; what still ties is the same document
twice. An empty table gives no rows. Of the input only id, source and text are read; outputs have the names below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
RESOLUTION = 1 << 20
SHARDS = 64
SEED = 12
#: Rows of one range; more rows make more ranges.
RANGE_ROWS = 500_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """``documents``: doc_id, source, size, source_size, target, taken. ``takes``: place (of the source), block, turn, shard. ``quotas``: shard, source, blocks.

    ``laid``: doc_id, place, begin (first word in its source's order), size. ``block_words``: words of a block.
    """

    documents: DataFrame
    quotas: DataFrame
    takes: DataFrame
    laid: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """(shard, turn, doc_id, first_word, n_words): the stretch of each document that each awarded block holds."""
        b = self.block_words
        whole = self.laid.where("size > 0").select("*", F.explode(F.expr(f"sequence(begin div {b}, (begin + size - 1) div {b})")).alias("block"))
        first = F.greatest(F.lit(0), F.col("block") * b - F.col("begin"))
        end = F.least(F.col("size"), (F.col("block") + 1) * b - F.col("begin"))
        return whole.join(self.takes, ["place", "block"]).select("shard", "turn", "doc_id", first.alias("first_word"), (end - first).alias("n_words"))


def draw(*parts: Column) -> Column:
    """A number of 60 bits that the seed and the parts decide."""
    text = F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, order: list[Column], sums: tuple[str, ...] = (), rows: int = 0) -> DataFrame:
    """``df`` with ``rank`` (from 0, in this order) and, for each column of ``sums``, ``<column>_before``: the total of all rows before.

    Written once, as bounds of ranges are sampled; what the ranges hold together is a row for each range.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS)
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), place.alias("at"))
    dealt = stored(dealt, "ranked")
    inner = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.count("*").alias("rows"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    none = F.lit(0).cast("long")
    totals = totals.select("part", F.coalesce(F.sum("rows").over(earlier), none).alias("rows"), *[F.coalesce(F.sum(f"all_{c}").over(earlier), none).alias(f"all_{c}") for c in sums])
    within = F.col("at").bitwiseAND((1 << 33) - 1)  # rows of a partition are numbered from a multiple of 2 ** 33
    out = dealt.join(F.broadcast(totals), "part").select(
        *df.columns, (F.col("rows") + within).alias("rank"), *[(F.col(f"all_{c}") + F.coalesce(F.sum(c).over(inner), none)).alias(f"{c}_before") for c in sums]
    )
    out.tracewell_path = dealt.tracewell_path
    return out


def targets(sources: DataFrame, total: int, share: float, most: int) -> DataFrame:
    """Add ``target`` to (source_size, weight, place): shares of share * total by weight, up to ``most`` times the size.

    Sources that reach their limit first come first; the level is that of the first source that stays below it.
    """
    limited = sources.withColumn("limit", F.col("source_size") * most)
    line = ranked(limited, [F.col("limit") / F.col("weight"), F.col("place")], ("limit", "weight"))
    left = F.lit(float(share * total)) - F.col("limit_before")
    weights = sources.agg(F.sum("weight")).first()[0] or 0
    level = line.select("rank", "weight", "limit", (left / (F.lit(weights) - F.col("weight_before"))).alias("level"))
    found = level.where(F.col("level") * F.col("weight") <= F.col("limit")).agg(F.min_by("level", "rank")).first()[0]
    forget(line)
    reached = F.col("source_size") * F.lit(float(most))
    return sources.withColumn("target", reached if found is None else F.least(reached, F.lit(found) * F.col("weight")))


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    resolution: int = RESOLUTION,
    shards: int = SHARDS,
) -> Mix:
    """Which words of which documents the mix takes, and for which shard."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.col(text)).alias("text_key")), "sized")
    by_source = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    total, n_docs = by_source.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    words = max(1, int(-(-share * total // resolution)))  # of a block
    seats = int((2 * share * total + words) // (2 * words))

    by_source = by_source.withColumn("n_blocks", F.ceil(F.col("source_size") / words).cast("long"))
    places = ranked(by_source, [F.asc_nulls_last("source")], ("source_size", "n_blocks"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    known = stored(targets(places.withColumn("weight", weight).withColumnRenamed("rank", "place"), total, share, most), "targets")
    forget(by_source, places)

    # awards: a row for each seat that a source may have, the highest quotients first
    chairs = known.where("n_blocks > 0").select("place", "target", F.explode(F.expr(f"sequence(0L, {most}L * n_blocks - 1)")).alias("award"))
    chairs = chairs.select("place", "award", (F.col("target") / (2 * F.col("award") + 1)).alias("quotient"))
    awards = ranked(chairs, [F.desc("quotient"), F.asc("place"), F.asc("award")], rows=4 * resolution)
    # every block once in each turn; turns of a source follow one another, so the rank tells the award
    turns = known.where("n_blocks > 0").select("place", (F.col("n_blocks_before") * most).alias("base"), F.explode(F.expr(f"sequence(0L, {most}L * n_blocks - 1)")).alias("x"), "n_blocks")
    turns = turns.select("place", "base", (F.col("x") % F.col("n_blocks")).alias("block"), F.expr("cast(x div n_blocks AS int)").alias("turn"))
    turns = turns.withColumn("draw", draw(F.col("place"), F.col("turn"), F.col("block")))
    drawn = ranked(turns, [F.asc(c) for c in ("place", "turn", "draw", "block")], rows=4 * resolution)
    won = awards.where(F.col("rank") < seats).select("place", "award", F.expr(f"cast(rank * {shards} div {max(1, seats)} AS int)").alias("shard"))
    takes = drawn.select("place", "block", "turn", (F.col("rank") - F.col("base")).alias("award")).join(won, ["place", "award"])
    takes = stored(takes.select("place", "block", "turn", "shard"), "takes")
    forget(awards, drawn)

    # words taken of a source up to each block
    blocks = known.where("n_blocks > 0").select("place", "source_size", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block"))
    times = takes.groupBy("place", "block").agg(F.count("*").alias("times"))
    blocks = blocks.join(times, ["place", "block"], "left").select("place", "block", F.coalesce("times", F.lit(0)).cast("long").alias("times"), (F.least(F.lit(words).cast("long"), F.col("source_size") - F.col("block") * words)).alias("held"))
    line = ranked(blocks.withColumn("got", F.col("times") * F.col("held")), [F.asc("place"), F.asc("block")], ("got",), rows=2 * resolution)
    taken_to = stored(line.select("place", "block", "times", F.col("got_before").alias("before")), "taken_to")
    forget(line)

    # seeded order of each source's documents
    of_source = known.select("source", "place", "source_size_before")
    laid = sized.join(of_source, sized["source"].eqNullSafe(of_source["source"])).select("doc_id", "place", "size", "text_key", "source_size_before", draw(F.col("doc_id"), F.col("size")).alias("draw"))
    order = [F.asc(c) for c in ("place", "draw", "doc_id", "size", "text_key")]
    line = ranked(laid, order, ("size",), rows=n_docs)
    laid = stored(line.select("doc_id", "place", "size", (F.col("size_before") - F.col("source_size_before")).alias("begin")), "laid")
    forget(line, sized)

    end = F.col("begin") + F.col("size")
    spans = laid.where("size > 0").select("*", F.expr(f"begin div {words}").alias("first"), F.expr(f"(begin + size - 1) div {words}").alias("last"))
    upto = lambda x: taken_to.select("place", F.col("block").alias(x), (F.col("before") - F.col("block") * words * F.col("times")).alias(f"{x}_base"), F.col("times").alias(f"{x}_times"))
    spans = spans.join(upto("first"), ["place", "first"]).join(upto("last"), ["place", "last"])
    taken = F.col("last_base") + end * F.col("last_times") - F.col("first_base") - F.col("begin") * F.col("first_times")
    rows = spans.select("doc_id", "place", "size", taken.alias("taken")).union(laid.where("size = 0").select("doc_id", "place", "size", F.lit(0).cast("long")))
    documents = rows.join(known.select("place", "source", "source_size", "target"), "place").select("doc_id", "source", "size", "source_size", "target", "taken")
    quotas = takes.groupBy("shard", "place").agg(F.count("*").alias("blocks")).join(known.select("place", "source"), "place").select("shard", "source", "blocks")
    return Mix(documents, quotas, takes, laid, words)

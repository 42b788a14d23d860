"""Bounded graph operators, level by level: each level is a join, and what was seen is left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import gone, kept, let_go


#: About so many reached nodes, repeats counted, are told apart in one task.
NODES_A_TASK = 4_000_000
#: Roots that share a copy of the lists they meet; edges of such a copy; bits of a level, bytes of a gathering and rows of a batch.
BLOCK, EDGES_A_BLOCK, BITS, GATHERED, ROWS_A_BATCH = 4096, 8_000_000, 1 << 28, 1 << 25, 100_000
#: Roots that share a row of a node where labels rise.
ROOTS = 32


def _gathered(seen: DataFrame, lists: DataFrame, depth: int, keys: DataFrame | None = None) -> DataFrame:
    """(root, node, depth) for many roots: ``seen`` (root, node, depth) and what follows over ``lists`` (a, to), ``to`` an array of nodes.

    Nodes travel as the arrays that they are kept in, are dealt by root and become rows only where they are told apart, so
    nothing but the arrays is shuffled; the last level, which no other reads, is not stored. ``keys`` (node, a): whose list a node has,
    if not its own.
    """
    spark = lists.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for level in range(1, depth + 1):
        front = seen.where(F.col("depth") == level - 1)
        front = front.select("root", F.col("node").alias("a")) if keys is None else front.join(keys, "node").select("root", "a").distinct()
        sizes = lists.select("a", F.size("to").cast("long").alias("size"))
        many = front.groupBy("a").count().join(sizes, "a").agg(F.sum(F.col("count") * F.col("size"))).first()[0] or 0
        reached = front.join(lists, "a").select("root", F.lit(level).alias("depth"), "to")
        rows = seen.select("root", "depth", F.array("node").alias("to")).unionByName(reached).repartition(max(least, many // NODES_A_TASK), "root")
        every = rows.select("root", "depth", F.explode("to").alias("node")).groupBy("root", "node").agg(F.min("depth").alias("depth"))
        if level < depth:
            before, seen = seen, kept(every, "reached")
            gone(before)
    return every if depth else seen


def _in_blocks(seen: DataFrame, lists: DataFrame, depth: int, keys: DataFrame | None = None) -> DataFrame:
    """As ``_gathered``, for whole numbers: up to BLOCK roots that lie together share one copy of the lists that they can meet.

    The answer is all pairs within some steps, so neither what is reached nor the nodes that lead on can be shuffled for each
    root. Rounds find which lists a block meets, a row for each block and node; these go to the block's task once, and there a bit
    for each root and node is all that a level takes. A block whose lists would be too large goes the other way. Where ``keys``
    has more columns, these take the place of the node.
    """
    roots = seen.select("root").distinct()
    many = roots.count()
    size = max(min(64, many), min(BLOCK, many // (2 * seen.sparkSession.sparkContext.defaultParallelism)), 1)
    blocks = kept(roots.repartitionByRange(max(1, -(-many // size)), "root").select("root", F.spark_partition_id().alias("block")), "blocks")
    kinds = dict(seen.dtypes)
    first = seen.join(blocks, "root").select("block", "root", "node")
    own = lambda rows: rows.select("block", F.col("node").alias("a")) if keys is None else rows.join(keys.select("node", "a"), "node").select("block", "a")
    nodes = first.select("block", "node").distinct()
    met = front = kept(own(nodes).distinct(), "met")
    for level in range(1, depth + (keys is not None)):  # names are asked of the last level too
        led = front.join(lists, "a").select("block", F.explode("to").alias("node")).distinct()
        if keys is not None:
            led = kept(led, "met")
            nodes = nodes.unionByName(led)
        if level < depth:
            front = kept(own(led).distinct().join(met, ["block", "a"], "left_anti"), "met")
            met = met.unionByName(front)
    held = met.join(lists, "a").select("block", "a", "to")
    sizes = held.groupBy("block").agg(F.sum(F.size("to").cast("long")).alias("edges"))
    large = [r.block for r in sizes.where(F.col("edges") > EDGES_A_BLOCK).collect()]  # a number for each block
    few = ~F.col("block").isin(large) if large else F.lit(True)
    # kind 0: a root and where it begins, 1: a node and whose list it has, 2: a list
    names = [] if keys is None else [c for c in keys.columns if c not in ("node", "a")]
    none = [F.lit(None).cast(dict(keys.dtypes)[c]).alias(c) for c in names]
    ints = F.lit(None).cast("array<bigint>")
    rows = first.where(few).select("block", F.lit(0).alias("kind"), F.col("root").cast("long").alias("x"), F.col("node").cast("long").alias("y"), ints.alias("to"), *none)
    rows = rows.union(held.where(few).select("block", F.lit(2), F.col("a").cast("long"), F.lit(None).cast("long"), F.col("to").cast("array<bigint>"), *none))
    if keys is not None:
        rows = rows.union(nodes.where(few).distinct().join(keys, "node").select("block", F.lit(1), F.col("node"), F.col("a"), ints, *names))
    # twice as many tasks as blocks, so that few blocks share one
    dealt = rows.repartition(max(1, 2 * -(-many // size)), "block").sortWithinPartitions("block")
    types = dict(keys.dtypes) if keys is not None else {}
    told = ", ".join(f"`{c}` {types[c]}" for c in names) or "node bigint"
    out = dealt.mapInArrow(_block_reader(depth, names), f"root bigint, {told}, depth int")
    out = out.withColumn("root", F.col("root").cast(kinds["root"]))
    if not names:
        out = out.withColumn("node", F.col("node").cast(kinds["node"]))
    if large:
        rest = kept(first.where(~few).select("root", "node", F.lit(0).alias("depth")), "reached")
        out = out.unionByName(_named(_gathered(rest, lists, depth, None if keys is None else keys.select("node", "a")), keys))
    return out


def _named(found: DataFrame, keys: DataFrame | None) -> DataFrame:
    """``found`` with the names that ``keys`` has for its nodes."""
    names = [] if keys is None else [c for c in keys.columns if c not in ("node", "a")]
    return found.join(keys.select("node", *names), "node").select("root", *names, "depth") if names else found


def _block_reader(depth: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            at = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for i, j in pairwise(edges):
                if j > i and at[i] != block:
                    yield from _reached(held, depth, names)
                    block, held = at[i], []
                if j > i:
                    held.append(_arrays(batch.slice(i, j - i)))
        yield from _reached(held, depth, names)

    return run


def _arrays(rows: pa.RecordBatch) -> tuple:
    """Of some rows of a block: roots and where they begin, nodes and whose list they have, their names, and edges."""
    kind, x = rows.column(1).to_numpy(), rows.column(2).to_numpy()
    y = rows.column(3).fill_null(0).to_numpy()
    to = rows.column(4)
    n = pc.fill_null(pc.list_value_length(to), 0).to_numpy()
    told = rows.slice(0).select(range(5, rows.num_columns)).filter(pa.array(kind == 1))
    return x[kind == 0], y[kind == 0], x[kind == 1], y[kind == 1], np.repeat(x, n), to.flatten().to_numpy(), told


def _reached(held: list[tuple], depth: int, labels: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (root, node or its names, depth) of one block: levels as rows of bits, one bit for each root, as many roots at a time as BITS has room for."""
    if not held:
        return
    *arrays, told = zip(*held, strict=True)
    root, start, node, own, a, b = (np.concatenate(x) for x in arrays)
    held.clear()
    told = pa.Table.from_batches(told).take(pa.array(np.argsort(node, kind="stable"))) if labels else None  # in the order of the nodes
    names = np.unique(node) if labels else np.unique(np.concatenate([start, b]))
    b = np.searchsorted(names, b).astype(np.int32)
    # lists are numbered too; a node without one leads nowhere
    if labels:
        lists = np.unique(np.concatenate([a, own]))
        leads = np.full(len(names), -1, np.int32)
        leads[np.searchsorted(names, node)] = np.searchsorted(lists, own)
        a = np.searchsorted(lists, a).astype(np.int32)
    else:
        lists, leads = names, None
        known = np.searchsorted(names, a).clip(max=len(names) - 1)
        fits = names[known] == a  # a list that no node of the block has is met by none
        a, b = known[fits].astype(np.int32), b[fits]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    ends, last = b[first], np.r_[first[1:], len(b)]
    roots = np.unique(root)
    step = max(8, min(len(roots) + 7, BITS // max(1, len(names))) // 8 * 8)
    for low in range(0, len(roots), step):
        some = roots[low : low + step]
        mine = (root >= some[0]) & (root <= some[-1])
        width = -(-len(some) // 64)
        seen = np.zeros((len(names), width), np.uint64)
        place = np.searchsorted(some, root[mine])
        np.bitwise_or.at(seen, (np.searchsorted(names, start[mine]), place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        levels, front = [seen.copy()], seen
        for _ in range(depth):
            if leads is not None:  # what any node of a list's owner has, the list has
                has = np.flatnonzero((leads >= 0) & front.any(axis=1))
                has = has[np.argsort(leads[has], kind="stable")]
                gathered = np.zeros((len(lists), width), np.uint64)
                if len(has):
                    at = np.flatnonzero(np.r_[True, leads[has][1:] != leads[has][:-1]])
                    gathered[leads[has][at]] = np.bitwise_or.reduceat(front[has], at, axis=0)
                front = gathered
            fresh = np.zeros_like(seen)
            room = max(1, GATHERED // (8 * width))
            i = 0
            while i < len(ends):  # whole targets at a time, at most so many edges unless one target has more
                j = max(i + 1, int(np.searchsorted(last, first[i] + room, side="right")))
                if last[j - 1] - first[i] > room:  # one target of very many edges
                    for k in range(first[i], last[i], room):
                        fresh[ends[i]] |= np.bitwise_or.reduce(front[a[k : min(k + room, last[i])]], axis=0)
                else:
                    fresh[ends[i:j]] = np.bitwise_or.reduceat(front[a[first[i] : last[j - 1]]], first[i:j] - first[i], axis=0)
                i = j
            fresh &= ~seen
            seen |= fresh
            levels.append(fresh)
            front = fresh
        for at in range(0, len(some), 8):  # a byte of each row: eight roots
            depths = np.full((len(names), 8), 255, np.uint8)
            for level, bits in enumerate(levels):
                depths[np.unpackbits(bits.view(np.uint8)[:, at // 8 : at // 8 + 1], axis=1, bitorder="little").view(bool)] = level
            for k in range(min(8, len(some) - at)):
                hit = np.flatnonzero(depths[:, k] < 255)
                for cut in range(0, len(hit), ROWS_A_BATCH):
                    some_hit = hit[cut : cut + ROWS_A_BATCH]
                    what = [pa.array(names[some_hit])] if told is None else [told.column(c).take(pa.array(some_hit)).combine_chunks() for c in labels]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some_hit), some[at + k])), *what, pa.array(depths[some_hit, k].astype(np.int32))], names=["root", *(labels or ["node"]), "depth"])


def _all(seen: DataFrame, lists: DataFrame, depth: int, keys: DataFrame | None = None) -> DataFrame:
    """``_in_blocks`` where roots and nodes are whole numbers, else ``_gathered``."""
    if depth and all(t in ("tinyint", "smallint", "int", "bigint") for c, t in seen.dtypes if c in ("root", "node")):
        return _in_blocks(seen, lists, depth, keys)
    return _named(_gathered(seen, lists, depth, None if keys is None else keys.select("node", "a")), keys)


def reach_all(edges: DataFrame, depth: int, both_ways: bool = False) -> DataFrame:
    """``reach`` from every ``a`` of the edges."""
    edges = kept(edges.select("a", "b"), "edges")
    step = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    lists = kept(step.where("a is not null").groupBy("a").agg(F.collect_set("b").alias("to")), "lists")
    seen = kept(edges.where("a is not null").select(F.col("a").alias("root"), F.col("a").alias("node"), F.lit(0).alias("depth")).distinct(), "reached")
    gone(edges)
    return _all(seen, lists, depth)


def reach(starts: DataFrame, edges: DataFrame, depth: int, both_ways: bool = False) -> DataFrame:
    """(root, node, depth): what is reachable from each root, at its least depth; the root itself at 0.

    ``starts`` has ``node``; ``edges`` has ``a`` and ``b``, and may repeat them: only what is reached is told apart. For all nodes as roots
    see ``reach_all``.
    """
    step = kept(edges.select("a", "b"), "steps")
    ways = [step] + ([step.select(F.col("b").alias("a"), F.col("a").alias("b"))] if both_ways else [])
    seen = kept(starts.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)), "reached")
    front = seen
    for level in range(1, depth + 1):
        fresh = None
        for way in ways:
            found = front.join(way, F.col("node") == F.col("a")).select("root", F.col("b").alias("node"))
            fresh = found if fresh is None else fresh.unionByName(found)
        fresh = kept(fresh.distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(level)), "reached")
        seen, front = seen.unionByName(fresh), fresh
    gone(step)
    return seen


def paths(starts: DataFrame, edges: DataFrame, depth: int, fan_out: int) -> DataFrame:
    """(root, path): simple paths of up to ``depth`` edges, the smallest ``fan_out`` targets of each node."""
    from .rows import first_rows

    step = kept(first_rows(edges.select("a", "b").distinct(), ["a"], [F.col("b")], fan_out).select("a", "b"), "steps")
    front = starts.select(F.col("node").alias("root"), F.array("node").alias("path"))
    out = None
    for _ in range(depth):
        front = front.join(step, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b"))).select("root", F.concat("path", F.array("b")).alias("path"))
        out = front if out is None else out.unionByName(front)
    return out


def longest_paths(starts: DataFrame, edges: DataFrame, depth: int, fan_out: int | None, n: int) -> DataFrame:
    """(root, path): the first ``n`` of ``paths`` of each root, longer ones first, then by the path joined with '>'; ``fan_out`` None: all targets of a node.

    A node with ``depth`` targets that can be followed to the end has one that a path does not hold yet. After the
    n-th such prefix in order no other can be among the first n, so levels stay narrow and nothing is lost.
    A path holds at most ``depth`` of a node's targets, so no path needs a target behind the (n + depth)-th that can be
    followed to the end, and a node of very many targets is met with few.
    The order of prefixes is that of their paths, as no name holds a '>'.
    """
    from .rows import first_rows

    step = edges.where("a is not null and b is not null").select("a", "b").distinct()
    step = kept(step if fan_out is None else first_rows(step, ["a"], [F.col("b")], fan_out).select("a", "b"), "steps")
    front = starts.select(F.col("node").alias("root"), F.array("node").alias("path")).distinct()
    sure, kinds = None, []
    for _ in range(depth - 1):
        on = step if sure is None else step.join(sure.select(F.col("sure").alias("b")), "b", "left_semi")
        sure = kept(on.groupBy(F.col("a").alias("sure")).count().where(F.col("count") >= depth).select("sure"), "sure")
        kinds.insert(0, sure)
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    out = None
    name = F.col("b").cast("string")
    for level in range(1, depth + 1):
        if level < depth:
            on = step.join(kinds[level - 1], F.col("b") == F.col("sure"), "left")
            ahead = Window.partitionBy("a").orderBy(F.concat(name, F.lit(">"))).rowsBetween(Window.unboundedPreceding, -1)
            on = on.withColumn("ahead", F.coalesce(F.count("sure").over(ahead), F.lit(0))).where(F.col("ahead") < n + depth).select("a", "b")
        else:
            on = first_rows(step, ["a"], [name], n + depth)
        front = front.join(on, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b"))).select("root", F.concat("path", F.array("b")).alias("path"))
        if level < depth:
            known = front.join(kinds[level - 1], F.element_at("path", -1) == F.col("sure"), "left")
            before = Window.partitionBy("root").orderBy(F.concat(text, F.lit(">"))).rowsBetween(Window.unboundedPreceding, -1)
            front = kept(known.withColumn("before", F.coalesce(F.count("sure").over(before), F.lit(0))).where(F.col("before") < n).select("root", "path"), "fronts")
        out = front if out is None else out.unionByName(front)
    return first_rows(out, ["root"], [F.desc(F.size("path")), text], n)


def widest(starts: DataFrame, edges: DataFrame, unknown_start: float = 0.65, unknown_edge: float = 0.5) -> DataFrame:
    """(root, node, confidence): how far each node can be trusted that a root leads to: the best path's weakest hop.

    ``starts`` has (node, confidence), ``edges`` (a, b, confidence); a missing confidence counts as the unknown one, the best
    of several edges between two nodes counts. A root's own confidence bounds all of its paths, three digits are kept.
    Labels rise until none does, and each round follows only those that have risen: at most as many rounds as the
    longest best path has hops, cycles or not. Up to ROOTS roots share a row of each node, a column for each, so an edge is met
    once for all of them.
    """
    trusted = lambda c, unknown: F.round(F.coalesce(c, F.lit(unknown)), 3)
    step = kept(edges.where("a is not null and b is not null").groupBy("a", "b").agg(F.max(trusted(F.col("confidence"), unknown_edge)).alias("hop")), "widest-edges")
    own = kept(starts.where("node is not null").groupBy(F.col("node").alias("root")).agg(F.max(trusted(F.col("confidence"), unknown_start)).alias("confidence")), "widest-starts")
    many = own.count()
    width = max(1, min(ROOTS, many))
    numbered = own.repartition(1 + many // 100_000).withColumn("number", F.monotonically_increasing_id())  # numbers stay as they are written
    roots = kept(numbered.select("root", "confidence", F.expr(f"number div {width}").alias("chunk"), F.expr(f"int(number % {width})").alias("place")), "widest-roots")
    names = [f"c{i}" for i in range(width)]
    most = lambda rows: rows.groupBy("chunk", "node").agg(*[F.max(c).alias(c) for c in names])
    first = roots.select("chunk", F.col("root").alias("node"), *[F.when(F.col("place") == i, F.col("confidence")).alias(c) for i, c in enumerate(names)])
    best = kept(most(first), "widest")
    front, risen = best, None
    while True:
        # least would pass over a null
        met = front.join(step, F.col("node") == F.col("a")).select("chunk", F.col("b").alias("node"), *[F.when(F.col(c).isNotNull(), F.least(c, "hop")).alias(c) for c in names])
        known = best.select("chunk", "node", *[F.col(c).alias(f"best_{c}") for c in names])
        offers = most(met).join(known, ["chunk", "node"], "left").select("chunk", "node", *[F.when(F.col(f"best_{c}").isNull() | (F.col(c) > F.col(f"best_{c}")), F.col(c)).alias(c) for c in names])
        risen_now = kept(offers.where(F.coalesce(*names).isNotNull()), "widest-front")
        gone(risen)
        if risen_now.isEmpty():
            gone(risen_now, step, own)
            break
        merged = kept(most(best.unionByName(risen_now)), "widest")
        gone(best)
        best, front, risen = merged, risen_now, risen_now
    each = best.select("chunk", "node", F.posexplode(F.array(*names)).alias("place", "confidence")).where("confidence is not null")
    return each.join(roots.select("root", "chunk", "place"), ["chunk", "place"]).select("root", "node", "confidence")


def path_confidence(paths: DataFrame, starts: DataFrame, edges: DataFrame, unknown_start: float = 0.65, unknown_edge: float = 0.5) -> DataFrame:
    """Add ``confidence`` to (root, path): the weakest of the root's own and of the best edge for each hop, three digits.

    Hops become rows that meet the edges and a minimum; a hop without an edge counts as unknown.
    """
    known = edges.where("a is not null and b is not null").groupBy("a", "b").agg(F.max(F.coalesce("confidence", F.lit(unknown_edge))).alias("hop"))
    own = starts.where("node is not null").groupBy(F.col("node").alias("root")).agg(F.max(F.coalesce("confidence", F.lit(unknown_start))).alias("own"))
    pairs = F.when(F.size("path") > 1, F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b"))))
    hops = paths.select("root", "path", F.explode_outer(pairs).alias("x")).select("root", "path", "x.a", "x.b")
    met = hops.join(known, ["a", "b"], "left").withColumn("hop", F.when(F.col("a").isNotNull(), F.coalesce("hop", F.lit(unknown_edge))))
    weakest = met.groupBy("root", "path").agg(F.min("hop").alias("hop")).join(own, "root", "left")
    return weakest.select("root", "path", F.round(F.least("hop", F.coalesce("own", F.lit(unknown_start))), 3).alias("confidence"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")


def reach_named(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, path, symbol, depth): reachable (path, symbol) nodes; what one symbol of a path leads to, the others lead to as well.

    ``starts`` has (root, path, symbol), ``edges`` has (from_path, to_path, to_symbol). A null symbol stands for the path as a whole.
    Nodes are numbered once, by where they are stored, and numbers travel.
    """
    edges = kept(edges.select("from_path", "to_path", "to_symbol").distinct(), "edges")
    starts = kept(starts.select("root", "path", "symbol").distinct(), "starts")
    named = starts.select("path", "symbol").union(edges.select("to_path", "to_symbol")).distinct()
    numbered = kept(named.withColumn("node", F.monotonically_increasing_id()), "numbered")  # numbers stay as they are written
    # nodes of one path share its list, which has the number of the first of them
    paths = kept(numbered.where("path is not null").groupBy("path").agg(F.min("node").alias("a")), "paths")
    nodes = kept(numbered.join(paths, "path"), "nodes")
    gone(numbered)
    of = lambda rows, path, symbol: rows.join(nodes.select(F.col("path").alias("p"), F.col("symbol").alias("s"), "node"), (F.col(path) == F.col("p")) & F.col(symbol).eqNullSafe(F.col("s")))
    lists = kept(of(edges, "to_path", "to_symbol").join(paths.withColumnRenamed("path", "from_path"), "from_path").groupBy("a").agg(F.collect_set("node").alias("to")), "lists")
    seen = kept(of(starts, "path", "symbol").select("root", "node", F.lit(0).alias("depth")), "reached")
    gone(edges, starts, paths)
    return _all(seen, lists, depth, nodes.select("node", "a", "path", "symbol"))


def reach_capped(starts: DataFrame, edges: DataFrame, depth: int, fan_out: int, limit: int) -> DataFrame:
    """(root, node, depth, pos): the first ``limit`` nodes in breadth-first order, over the ``fan_out`` best edges of each node.

    ``edges`` has (a, b, rank), with distinct ranks for each a. The limit is what is asked for: a root is a row with at most
    limit nodes, and meets at most limit lists of fan_out nodes a level; one that is full meets none.
    """
    from .rows import first_rows

    best = first_rows(edges, ["a"], [F.col("rank")], fan_out)
    lists = kept(best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "b"))).alias("to")).select("a", "to.b"), "lists")
    state = kept(starts.select(F.col("node").alias("root"), F.array("node").alias("held")).distinct().withColumn("depths", F.array(F.lit(0))), "capped")
    for level in range(1, depth + 1):
        front = state.where(F.size("held") < limit).select("root", F.posexplode(F.arrays_zip("held", "depths")).alias("pos", "x")).where(F.col("x.depths") == level - 1)
        met = front.select("root", "pos", F.col("x.held").alias("a")).join(lists, "a").groupBy("root").agg(F.sort_array(F.collect_list(F.struct("pos", "b"))).alias("lists"))
        both = state.join(met.select("root", F.flatten("lists.b").alias("found")), "root", "left")
        fresh = F.coalesce(F.slice(F.array_except("found", "held"), F.lit(1), F.lit(limit) - F.size("held")), F.slice("held", 1, 0))  # in order, each once
        both = both.withColumn("fresh", fresh).select("root", F.concat("held", "fresh").alias("held"), F.concat("depths", F.array_repeat(F.lit(level), F.size("fresh"))).alias("depths"))
        before, state = state, kept(both, "capped") if level < depth else both
        if level < depth:
            gone(before)
    return state.select("root", F.posexplode(F.arrays_zip("held", "depths")).alias("at", "x")).select("root", F.col("x.held").alias("node"), F.col("x.depths").alias("depth"), (F.col("at") + 1).cast("int").alias("pos"))


def ancestors(parents: DataFrame) -> DataFrame:
    """(node, parent, depth): all that each node descends from, at the least depth, over (child, parent) rows; cycles end.

    Rounds double: what is known up to depth n gives all up to 2 n, as the way to an ancestor that is further off leads through
    one at depth n. A line of 1,000 takes ten rounds.
    """
    known = kept(parents.where("child is not null and parent is not null").select(F.col("child").alias("node"), "parent").distinct().withColumn("depth", F.lit(1)), "ancestors")
    reach = 1
    while True:
        half = known.where(F.col("depth") == reach).select("node", F.col("parent").alias("via"))
        rest = known.select(F.col("node").alias("via"), "parent", (F.col("depth") + reach).alias("depth"))
        found = half.join(rest, "via").groupBy("node", "parent").agg(F.min("depth").alias("depth"))
        fresh = kept(found.join(known, ["node", "parent"], "left_anti"), "ancestors-new")
        if fresh.isEmpty():
            gone(fresh)
            return known
        both = kept(known.unionByName(fresh), "ancestors")
        gone(known, fresh)
        known, reach = both, 2 * reach


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of each node with an edge (a, b) to another, either way, the smallest node of its component.

    A round takes the smallest label among neighbours, hooks the trees that meet, and then takes the label's own label, so rounds
    grow with the logarithm of the longest path and no node's neighbours are gathered.
    """
    both = kept(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).where("node <> other").distinct(), "both")
    labels = kept(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("r")), "other").groupBy("node").agg(F.min("r").alias("r"))
        hooked = near.join(labels, "node").select(F.col("root").alias("node"), "r").where("r < node")
        best = labels.select("node", F.col("root").alias("r")).union(near).union(hooked).groupBy("node").agg(F.min("r").alias("low"))
        jumped = best.join(best.select(F.col("node").alias("low"), F.col("low").alias("lower")), "low", "left").select("node", F.coalesce("lower", "low").alias("root"))
        fresh = kept(jumped.join(labels.withColumnRenamed("root", "was"), "node").select("node", "root", (F.col("root") != F.col("was")).alias("moved")), "labels")
        gone(labels)
        let_go(edges.sparkSession)
        labels = fresh.drop("moved")
        labels.tracewell_path = fresh.tracewell_path
        if fresh.where("moved").isEmpty():
            gone(both)
            return labels


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, score): a one-to-one choice, best score first, ties by a and then b.

    A pair waits for the better ones of its two sides. In each round a pair that waits for none is taken, and one that waits
    for a single other is taken if that is not, so chains of such pairs are decided by how far they are from their end, even or
    odd, found by doubling; pairs of sides used up go. Only the two best pairs of each side are looked at in a round, so a side
    with many pairs is no large group. Pairs with a null are left out, of repeated ones the best counts.
    """
    from .rows import first_rows

    left = kept(pairs.dropna(subset=["a", "b", "score"]).groupBy("a", "b").agg(F.max("score").alias("score")), "pairs")
    shape, parts = left.schema, []
    while not left.isEmpty():
        order = [-F.col("score"), F.col("a"), F.col("b")]
        of = {}
        for side in ("a", "b"):
            two = first_rows(left, [side], order, 2)
            best = two.groupBy(side).agg(F.min(F.struct((-F.col("score")).alias("s"), "a", "b")).alias("best"))
            of[side] = two.join(best, side).select("a", "b", "score", F.struct("best.a", "best.b").alias(f"first_{side}"))
        me = F.struct("a", "b")
        both = of["a"].join(of["b"].drop("score"), ["a", "b"]).withColumns({"at_a": F.col("first_a") == me, "at_b": F.col("first_b") == me}).where("at_a or at_b")
        waits = F.when(~F.col("at_a"), F.col("first_a")).when(~F.col("at_b"), F.col("first_b")).otherwise(me)
        line = kept(both.select(me.alias("me"), "score", waits.alias("to"), F.when(F.col("at_a") & F.col("at_b"), 0).otherwise(1).alias("odd")), "line")
        while True:
            on = line.select(F.col("me").alias("to"), F.col("to").alias("further"), F.col("odd").alias("more"))
            # one whose way leads to a pair that waits for two is not decided in this round
            jumped = kept(line.join(on, "to").select("me", "score", F.col("further").alias("to"), ((F.col("odd") + F.col("more")) % 2).alias("odd"), (F.col("further") != F.col("to")).alias("moved")), "line")
            gone(line)
            line, moving = jumped.drop("moved"), not jumped.where("moved").isEmpty()
            line.tracewell_path = jumped.tracewell_path
            if not moving:
                break
        now = kept(line.where("odd = 0").select("me.a", "me.b", "score"), "taken")
        gone(line)
        rest = kept(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select("a", "b", "score"), "pairs")
        gone(left)
        left = rest
        parts.append(now)
    out = pairs.sparkSession.createDataFrame([], shape)
    for part in parts:
        out = out.unionByName(part)
    return out

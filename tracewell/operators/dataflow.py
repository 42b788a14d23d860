"""Flows from inputs to dangerous calls through functions of any files, in semi-naive rounds over call edges.

Two relations feed each other. ``local``: a name in a function holds what came from an origin, which is one of the function's
own parameters or an input somewhere. ``returned``: a function returns what came from an origin. A call passes an
argument's origins on as far as the callee's summary (parameter to result) says, so contexts are not mixed up:
two callers of one function do not hear of one another. Each round joins only what is new with what is known.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import gone, kept
from ..sources.tables import shared_dir
from .graphs import components

#: So many rows of files that call one another are followed within a task; more of them go in rounds.
ROWS_A_GROUP = 200_000


class Pile:
    """A table in the shared folder that only grows: each ``add`` writes what is new, ``all`` reads everything."""

    def __init__(self, first: DataFrame, tag: str) -> None:
        self.spark, self.schema = first.sparkSession, first.schema
        self.path, self.rounds = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}", 0
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Writes rows and returns them as read back."""
        place = f"{self.path}/round={self.rounds}"
        rows.write.parquet(place)
        self.rounds += 1
        return self.spark.read.schema(self.schema).parquet(place)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round={k}" for k in range(self.rounds)])

    def drop(self) -> None:
        holder = self.spark.createDataFrame([], self.schema)
        holder.tracewell_path = self.path
        gone(holder)


def sites(facts: DataFrame) -> DataFrame:
    """(path, fn, site, to_path, to_fn): calls with the one function they can mean.

    A function of that name in the caller's file, else in all files, if there is just one; else null.
    """
    known = facts.where("kind = 'function'").select("path", "fn", "name")
    one = lambda keys: known.groupBy(*keys).agg(F.count("*").alias("n"), F.first("path").alias("to_path"), F.first("fn").alias("to_fn"))
    calls = facts.where("kind = 'call'").select("path", "fn", "site", "name")
    met = kept(calls.join(one(["name"]), "name", "left").select("path", "fn", "site", F.when(F.col("n") > 1, F.col("name")).alias("name"), F.when(F.col("n") == 1, F.col("to_path")).alias("to_path"), F.when(F.col("n") == 1, F.col("to_fn")).alias("to_fn")), "called")
    # a name declared once means that function in any file; only of the others the caller's own file is asked
    near = one(["path", "name"]).where("n = 1").select("path", "name", F.col("to_path").alias("near_path"), F.col("to_fn").alias("near_fn"))
    open_ = met.where("name is not null").drop("to_path", "to_fn").join(near, ["path", "name"], "left").select("path", "fn", "site", F.col("near_path").alias("to_path"), F.col("near_fn").alias("to_fn"))
    return met.where("name is null").drop("name").unionByName(open_)


def flows_apart(facts: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """``flows``, each group of files that call one another on its own: such a group is followed to its end in one task, without rounds.

    ``target`` are the ``sites`` of the facts, if they are known already. Groups with more than ROWS_A_GROUP rows go in rounds.
    """
    spark = facts.sparkSession
    facts = kept(facts, "facts") if getattr(facts, "tracewell_path", None) is None else facts
    target = kept(sites(facts), "sites") if target is None else target
    file = F.xxhash64("path")  # files that share a hash by chance share a group, which changes nothing
    groups = components(target.where("to_fn is not null and to_path <> path").select(file.alias("a"), F.xxhash64("to_path").alias("b")))
    grouped = lambda rows: rows.withColumn("node", file).join(groups, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("node", "root")
    told = facts.where("kind in ('assign', 'arg', 'return', 'sink', 'param', 'input')")
    none = F.lit(None).cast("int")
    goes = target.select("path", "fn", none.alias("line"), F.lit("goes").alias("kind"), F.col("to_path").alias("name"), F.col("to_fn").alias("used"), "site", none.alias("slot"))
    counts = told.groupBy("path").agg(F.count("*").alias("rows"))
    large = kept(grouped(counts).groupBy("group").agg(F.sum("rows").alias("rows")).where(F.col("rows") > ROWS_A_GROUP).select("group"), "large")
    rows, none_large = grouped(told.unionByName(goes)), large.isEmpty()
    few = rows if none_large else rows.join(large, "group", "left_anti")
    dealt = few.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group")
    out = dealt.select("group", "path", "fn", "line", "kind", "name", "used", "site", "slot").mapInArrow(_group_reader, _FLOWS)
    if none_large:
        return out
    of_large = lambda rows: grouped(rows).join(large, "group", "left_semi").drop("group")
    return out.unionByName(flows(of_large(facts), of_large(target)))


_FLOWS = "source_path string, source_line int, sink_path string, sink_line int, category string"


def _group_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, held = None, []
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _FLOWS.split(", ")])

    for batch in batches:
        found: list[tuple] = []
        columns = [c.to_pylist() for c in batch.columns]
        for own, *row in zip(*columns, strict=True):
            if own != group:
                found += _followed(held)
                group, held = own, []
            held.append(row)
        yield batch_of(found)
    yield batch_of(_followed(held))


def _followed(rows: list[list]) -> list[tuple]:
    """The flows within some files, from their facts and from rows of kind ``goes`` (what a call means), by a list of what is new.

    An origin is a parameter's slot or the (path, line) of an input.
    """
    if not {"input", "sink"} <= {row[3] for row in rows}:
        return []
    goes, nexts, given, ends = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list)
    returns, callers, todo = set(), defaultdict(list), []
    for path, fn, _, kind, name, used, site, _ in rows:
        if kind == "goes":
            goes[path, fn, site].append(None if used is None else (name, used))
            if used is not None:
                callers[name, used].append(((path, fn), site))
    for path, fn, line, kind, name, used, site, slot in rows:
        here = path, fn
        if kind == "param":
            todo.append((here, slot, name))
        elif kind == "input":
            todo.append((here, (path, line), name))
        elif kind == "return":
            returns.add((here, used))
        elif used is None:
            continue
        elif kind == "assign":
            nexts[here, used].append(name)
        elif kind == "sink":
            ends[here, used].append((path, line, name))
        elif kind == "arg":
            for callee in goes.get((path, fn, site), ()):
                if callee is None:
                    nexts[here, used].append(f"<call {site}>")
                elif slot >= 0:
                    given[here, used].append((f"<call {site}>", callee, slot))
    local, returned, passed, hits = set(), set(), defaultdict(set), set()
    while todo:
        new = here, origin, name = todo.pop()
        if new in local or name is None:
            continue
        local.add(new)
        at = here, name
        todo += [(here, origin, x) for x in nexts.get(at, ())]
        if at in returns and (here, origin) not in returned:
            returned.add((here, origin))
            todo += [(there, theirs, mark) for there, theirs, mark in passed.get((here, origin), ())]
            if type(origin) is tuple:
                todo += [(there, origin, f"<call {site}>") for there, site in callers.get(here, ())]
        for mark, callee, slot in given.get(at, ()):
            passed[callee, slot].add((here, origin, mark))
            if (callee, slot) in returned:
                todo.append((here, origin, mark))
    todo = [(here, origin, end) for here, origin, name in local for end in ends.get((here, name), ())]
    while todo:
        new = here, origin, end = todo.pop()
        if new not in hits:
            hits.add(new)
            todo += [(there, theirs, end) for there, theirs, _ in passed.get((here, origin), ())]
    return list({(*origin, *end) for _, origin, end in hits if type(origin) is tuple})


def flows(facts: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """(source_path, source_line, sink_path, sink_line, category): inputs that reach a dangerous call, in one function or through any number of them.

    ``facts`` as ``functions.dataflow.facts`` gives them. A call to something unknown hands on whatever it takes. Recursion ends
    as nothing is new; rounds grow with the longest chain of calls. ``target`` are the ``sites`` of the facts, if they are known already.
    """
    here = ["path", "fn"]
    facts = kept(facts, "facts")
    target = kept(sites(facts) if target is None else target, "sites")
    mark = F.concat(F.lit("<call "), F.col("site").cast("string"), F.lit(">"))
    args = facts.where("kind = 'arg'").select(*here, "site", "slot", "used").join(target, [*here, "site"])
    unknown = args.where("to_fn is null").select(*here, "used", mark.alias("name"))
    steps = kept(facts.where("kind = 'assign'").select(*here, "used", "name").unionByName(unknown).where("used <> name").distinct(), "steps")
    slot = F.concat(F.lit("param "), F.col("slot").cast("string"))
    given = kept(args.where("to_fn is not null and slot >= 0").select(*here, "site", "used", "to_path", "to_fn", slot.alias("param")).distinct(), "given")
    results = kept(target.where("to_fn is not null"), "results")
    returns = kept(facts.where("kind = 'return'").select(*here, F.col("used").alias("name")).distinct(), "returns")

    params = facts.where("kind = 'param'").select(*here, slot.alias("origin"), "name")
    inputs = facts.where("kind = 'input'").select(*here, F.concat(F.lit("input "), F.col("path"), F.lit(":"), F.col("line").cast("string")).alias("origin"), "name")
    local = Pile(params.unionByName(inputs).distinct(), "local")
    fresh = local.all()
    passed = Pile(fresh.select(*here, "origin").withColumns({c: F.lit(None).cast(t) for c, t in (("site", "int"), ("to_path", "string"), ("to_fn", "string"), ("param", "string"))}).where("false"), "passed")
    returned = Pile(fresh.select(*here, "origin").where("false"), "returned")
    callee = [F.col("to_path") == F.col("p"), F.col("to_fn") == F.col("f")]
    named = lambda r: r.select(F.col("path").alias("p"), F.col("fn").alias("f"), F.col("origin").alias("from"))
    through = lambda calls, r: calls.join(named(r), [*callee, F.col("param") == F.col("from")]).select(*here, "origin", mark.alias("name"))
    while not fresh.isEmpty():
        new_returned = fresh.join(returns, [*here, "name"]).select(*here, "origin").distinct()
        new_returned = returned.add(new_returned.join(returned.all(), [*here, "origin"], "left_anti"))
        old_passed = passed.all()
        new_passed = passed.add(fresh.withColumnRenamed("name", "used").join(given, [*here, "used"]).select(*here, "origin", "site", "to_path", "to_fn", "param").distinct())
        found = fresh.withColumnRenamed("name", "used").join(steps, [*here, "used"]).select(*here, "origin", "name")
        found = found.unionByName(through(new_passed, returned.all())).unionByName(through(old_passed, new_returned))
        came_in = results.join(named(new_returned.where("startswith(origin, 'input ')")), callee).select(*here, F.col("from").alias("origin"), mark.alias("name"))
        fresh = local.add(found.unionByName(came_in).distinct().join(local.all(), [*here, "origin", "name"], "left_anti"))

    sinks = facts.where("kind = 'sink'").select(*here, F.col("used").alias("name"), F.col("path").alias("sink_path"), F.col("line").alias("sink_line"), F.col("name").alias("category")).distinct()
    what = ["sink_path", "sink_line", "category"]
    hits = Pile(local.all().join(sinks, [*here, "name"]).select(*here, "origin", *what).distinct(), "hits")
    fresh, calls = hits.all(), passed.all()
    while not fresh.isEmpty():
        up = calls.join(fresh.select(F.col("path").alias("p"), F.col("fn").alias("f"), F.col("origin").alias("from"), *what), [*callee, F.col("param") == F.col("from")])
        fresh = hits.add(up.select(*here, "origin", *what).distinct().join(hits.all(), [*here, "origin", *what], "left_anti"))
    place = F.regexp_extract("origin", r"^input (.*):(\d+)$", 1), F.regexp_extract("origin", r"^input (.*):(\d+)$", 2).cast("int")
    out = kept(hits.all().where("startswith(origin, 'input ')").select(place[0].alias("source_path"), place[1].alias("source_line"), *what).distinct(), "flows")
    for pile in (local, passed, returned, hits):
        pile.drop()
    gone(facts, target, steps, given, results, returns)
    return out

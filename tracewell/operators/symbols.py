"""Relations between files, by joins over what the readers of program text found.

``found`` is the table of ``functions.lines.extract``: (path, line, kind, name, detail).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept


def declared(found: DataFrame) -> DataFrame:
    """(name, target, target_kind): names that one file alone declares."""
    by_name = found.where(F.col("kind").isin("class", "function")).groupBy("name")
    return by_name.agg(F.min("path").alias("target"), F.max("path").alias("last"), F.min("kind").alias("target_kind")).where("target = last").drop("last")


def relationships(found: DataFrame) -> DataFrame:
    """(from_path, to_path, relation, name, confidence): calls, bases and shared tables between files.

    A call or base counts if one file alone declares its name. Files meet at a table through the table, so a popular
    one makes a row a file and not all pairs. A repeated relation is one row with its best confidence.
    """
    unique = declared(found)
    use = lambda kind, name: found.where(F.col("kind") == kind).select(F.col("path").alias("from_path"), F.col(name).alias("name"), F.col("detail").isNotNull().alias("scoped"))
    linked = lambda rows, relation, score: rows.join(unique, "name").where("from_path <> target").select("from_path", F.col("target").alias("to_path"), F.lit(relation).alias("relation"), "name", score.alias("confidence"))
    called = linked(use("call", "name"), "calls", F.when(F.col("scoped"), 0.72).otherwise(0.8))
    bases = linked(use("base", "detail"), "inherits", F.lit(0.85))
    data = found.where("kind = 'data'").select(F.col("path").alias("from_path"), F.concat(F.lit("data:"), F.lower("name")).alias("to_path"), F.lit("uses").alias("relation"), F.lower("name").alias("name"), F.lit(0.7).alias("confidence"))
    both = called.unionByName(bases).unionByName(data)
    return both.groupBy("from_path", "to_path", "relation", "name").agg(F.max("confidence").alias("confidence"))


def folded_routes(found: DataFrame) -> DataFrame:
    """``found`` with routes whose paths join strings and constants of other files by + written out.

    A constant counts if it has one value in all files. A route takes the place of what its own file told of it; one
    with a name that no constant has stays as it was. Groups are the parts of one expression. Rows of kind
    ``open-route`` go.
    """
    constants = found.where("kind = 'constant'").groupBy(F.col("name").alias("word")).agg(F.min("detail").alias("value"), F.max("detail").alias("last")).where("value = last")
    parsed = F.from_json("detail", "known string, parts array<struct<name: string, text: string>>")
    place = ["path", "line", "name", "detail"]
    parts = found.where("kind = 'open-route'").select(*place).distinct().withColumn("d", parsed).select(*place, "d.known", F.posexplode("d.parts").alias("at", "part"))
    valued = parts.join(constants, F.col("part.name") == F.col("word"), "left").withColumn("piece", F.coalesce("part.text", "value"))
    whole = valued.groupBy(*place, "known").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.bool_and(F.col("piece").isNotNull()).alias("full"))
    routes = whole.where("full").withColumn("route", F.array_join("pieces.piece", "")).where("startswith(route, '/')")
    routes = routes.select("path", "line", F.concat("name", F.lit(" /"), F.btrim("route", F.lit("/"))).alias("name"), "known")
    known = routes.select("path", "line", F.lit("route").alias("kind"), F.col("known").alias("name")).distinct()
    rest = found.where("kind <> 'open-route'").join(known, ["path", "line", "kind", "name"], "left_anti")
    return rest.unionByName(routes.select("path", "line", F.lit("route").alias("kind"), "name", F.lit("folded").alias("detail")).distinct())


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(from_path, module, to_path): imports that name one file of the table.

    Relative names start from the importing file's folder; dotted ones are matched from the end of a path. Each name
    has candidates in order of priority; those of the best priority that exist must be one file, else it is ambiguous.
    The endings come off the paths, so an import is one row and not one for each ending, and of the files that end alike
    only the first, the last and their number meet the imports: an importing file among two leaves the other.
    """
    asked = found.where("kind = 'import'").select(F.col("path").alias("from_path"), F.col("name").alias("module")).distinct()
    folder = F.regexp_replace("from_path", r"/?[^/]*$", "")
    near = F.col("module").startswith("./")
    plain = F.regexp_replace(F.regexp_replace("module", r"^\./", ""), r"\.|::|\\", "/")
    stem = F.when(near, F.concat_ws("/", F.when(folder != "", folder), F.regexp_replace("module", r"^\./", ""))).otherwise(plain)
    asked = kept(asked.select("from_path", "module", near.alias("near"), stem.alias("stem")), "imports")
    ends = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(e).alias("end")) for i, e in enumerate((".py", ".js", ".ts", ".go", ".rs", ".java", "/__init__.py", "/index.js", "/index.ts"))])
    known = files.select("path").distinct()
    ended = known.select("path", F.explode(F.filter(ends, lambda e: F.endswith("path", e.end))).alias("e"))
    ended = ended.select("path", "e.priority", F.expr("substr(path, 1, length(path) - length(e.end))").alias("stem"), F.length("e.end").alias("cut"))
    whole = ended.select("stem", "priority", F.lit(True).alias("near"), F.col("path").alias("first"), F.col("path").alias("last"), F.lit(1).cast("long").alias("n"))
    # tails of a path, so that a dotted name may leave out the first folders: of the lengths that are asked for
    lengths = sorted(r.n for r in asked.where("not near").select(F.size(F.split("stem", "/")).alias("n")).distinct().collect())
    parts = F.split("stem", "/")
    at = F.filter(F.array([F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.size(parts))
    tail = ended.select("path", "priority", F.explode(F.transform(at, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))).alias("stem"))
    tails = tail.groupBy("stem", "priority").agg(F.min("path").alias("first"), F.max("path").alias("last"), F.count("*").alias("n")).withColumn("near", F.lit(False)).select(*whole.columns)
    hit = asked.join(whole.unionByName(tails), ["stem", "near"])
    own = (F.col("first") == F.col("from_path")) | (F.col("last") == F.col("from_path"))
    other = F.when(F.col("first") == F.col("from_path"), F.col("last")).otherwise(F.col("first"))
    hit = hit.where(~(own & (F.col("n") == 1))).withColumn("to_path", F.when((F.col("n") == 1) | own & (F.col("n") == 2), other))
    best = hit.groupBy("from_path", "module").agg(F.min_by("to_path", "priority").alias("to_path"))
    return best.where("to_path is not null")


def numbered(files: DataFrame) -> DataFrame:
    """(path, line, text) of every line."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


INPUT = r"request\.(?:args|form|params|query|body)|\binput\b|\bargv\b|readline\("
SINK = r"(?:os\.system|\beval|\bexec|subprocess\.\w+|\.query)\s*\(\s*([A-Za-z_]\w*)"


def flow_files(files: DataFrame) -> DataFrame:
    """(path, content): the texts of paths with both an input and a risky call; texts of one path belong together.

    A path of one row is judged by its own text, so only paths of several rows meet one another.
    """
    # what matches within a line matches within the text
    files = files.where("path is not null").select("path", "content")
    marks = {"takes": F.col("content").rlike(INPUT), "risks": F.col("content").rlike(SINK)}
    key = F.xxhash64("path")  # paths that share a hash by chance go the longer way, to the same result
    several = kept(files.groupBy(key.alias("key")).count().where("count > 1").select("key"), "several")
    alone = files.join(several, key == F.col("key"), "left_anti").where(marks["takes"] & marks["risks"])
    shared = files.join(several, key == F.col("key"), "left_semi")
    both = shared.groupBy("path").agg(*[F.bool_or(m).alias(c) for c, m in marks.items()]).where("takes and risks").select("path")
    return alone.unionByName(shared.join(both, "path", "left_semi"))


def flows(files: DataFrame, distance: int = 80) -> DataFrame:
    """(path, source_line, sink_line, variable): inputs that reach a risky call at most ``distance`` lines further on, see ``followed``."""
    return followed(numbered(flow_files(files)), distance)


def followed(lines: DataFrame, distance: int = 80) -> DataFrame:
    """``flows`` of (path, line, text): names set from an input, and from such names, spread assignment by assignment, as far as they go.

    An assignment takes only what lines before it have set, so one pass over a path's lines in order finds all. What a line says
    is read before lines of a path meet, and lines that say nothing stay behind.
    """
    given = r"^\s*(?:const |let |var )?([A-Za-z_]\w*)\s*:?=\s*(.+)$"
    words = F.array_distinct(F.regexp_extract_all(F.regexp_extract("text", given, 2), F.lit(r"[A-Za-z_]\w*"), 0))
    said = lines.select("path", "line", F.col("text").rlike(INPUT).alias("takes"), F.regexp_extract("text", given, 1).alias("name"), words.alias("used"), F.regexp_extract("text", SINK, 1).alias("sink"))
    said = said.where("takes or name <> '' or sink <> ''").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "takes", "name", "used", "sink"))).alias("said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(path, *hit) for path, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in _hits(own, distance)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["path", "source_line", "sink_line", "variable"])

    return said.mapInArrow(run, "path string, source_line int, sink_line int, variable string")


def _hits(said: list[dict], distance: int) -> dict[tuple[int, int, str], None]:
    """(source line, sink line, variable) of one path, whose lines come in order; inputs that are out of reach are forgotten."""
    held: dict[str, set[int]] = {}
    out: dict[tuple[int, int, str], None] = {}
    for line, here in groupby(said, key=lambda x: x["line"]):
        here = list(here)
        near = lambda name: [s for s in held.get(name, ()) if line - s <= distance]  # noqa: B023, E731
        out |= dict.fromkeys((s, line, x["sink"]) for x in here if x["sink"] for s in sorted(near(x["sink"])))
        takes = [line] if any(x["takes"] for x in here) else []
        fresh = [(x["name"], takes + [s for u in x["used"] if u != x["name"] for s in near(u)]) for x in here if x["name"]]
        for name, sources in fresh:
            if sources:
                held[name] = {*near(name), *sources}
    return out

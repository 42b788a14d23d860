"""What is worth an audit: candidates of four kinds with keys and ids that a second run gives again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_id

#: Suffixes of files that a web server runs as they are, and folders that it serves.
WEB_SUFFIXES = ("php", "phtml", "jsp", "jspx", "asp", "aspx", "ashx", "cgi", "pl", "cfm")
WEB_FOLDERS = ("www", "public", "htdocs", "web", "webroot", "wwwroot", "pages")
SEVERITY = {"process_execution": "high", "code_execution": "high", "deserialization": "high", "query": "high", "template_render": "medium", "file_read": "medium"}
COLUMNS = ["candidate_id", "kind", "path", "line", "entry_point", "category", "severity"]


def web_scripts(facts: DataFrame) -> DataFrame:
    """(path): scripts that a web server may run as they are, because something happens when they are loaded.

    The suffix says so, or a folder of the path that is served does; and outside of all functions the text calls something,
    takes an input or reaches a sink.
    """
    acts = facts.where("fn = '' and kind in ('call', 'input', 'sink')").select("path").distinct()
    suffix = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    served = F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*[F.lit(x) for x in WEB_FOLDERS]))
    return acts.where(suffix.isin(*WEB_SUFFIXES) | served & suffix.isin("js", "py", "rb"))


def candidates(routes: DataFrame, scripts: DataFrame, flows: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(candidate_id, kind, path, line, entry_point, category, severity), one row for each key.

    ``routes`` (path, line, name) are entries; ``scripts`` (path) without routes are entries themselves; ``flows`` as operators.dataflow gives
    them, told by sink, category and entry; ``capabilities`` as functions.capabilities judges them, of those the
    risky ones, told by place, category and entry. Of rows with one key the first by line stands. The id is a hash
    of what the key says, so it stays when lines that are not part of it move.
    """
    entry = routes.groupBy("path").agg(F.min_by("name", F.struct("line", "name")).alias("entry_point"))
    none, unknown = F.lit(None).cast("string"), F.lit("unknown")
    ways = routes.select(F.lit("entrypoint").alias("kind"), "path", "line", F.col("name").alias("entry_point"), none.alias("category"), unknown.alias("severity"), F.concat_ws("|", "path", "name").alias("key"))
    pages = scripts.join(entry, "path", "left_anti").select(F.lit("web_entrypoint"), "path", F.lit(1), F.concat(F.lit("/"), "path"), none, unknown, F.col("path"))
    own = entry.unionByName(scripts.join(entry, "path", "left_anti").select("path", F.concat(F.lit("/"), "path").alias("entry_point")))
    severity = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), F.col("category")), unknown)
    told = flows.join(own.withColumnRenamed("path", "source_path"), "source_path", "left")
    streams = told.select(F.lit("data_flow"), F.col("sink_path"), F.col("sink_line"), "entry_point", "category", severity, F.concat_ws("|", "sink_path", F.col("sink_line").cast("string"), "category", F.coalesce("entry_point", F.lit("-"))))
    chains = capabilities.where("risk = 'high'").select(F.lit("capability_chain"), "path", "line", F.col("entry").alias("entry_point"), "category", F.col("risk"), F.concat_ws("|", "path", F.col("line").cast("string"), "category", F.coalesce("entry", F.lit("-"))))
    every = ways.union(pages).union(streams).union(chains)
    place = F.row_number().over(Window.partitionBy("kind", "key").orderBy("line"))
    first = every.withColumn("place", place).where("place = 1")
    return first.withColumn("candidate_id", stable_id("cand", F.col("kind"), F.col("key"))).select(*COLUMNS)


def renewed(known: DataFrame, found: DataFrame) -> DataFrame:
    """``known`` (candidate_id, status, ...) with what a new run found: new ones as 'candidate', known ones keep their status, those gone stay."""
    fresh = found.join(known.select("candidate_id"), "candidate_id", "left_anti").select(*[F.lit("candidate").alias(c) if c == "status" else F.col(c) for c in known.columns])
    return known.unionByName(fresh)

"""Nodes that rest on lines of files: references are checked against the lines, and a change checks again only what it touches.

A node has (id, confidence, evidence, status, review_status, revision); ``evidence`` is an array of references 'path:line' or
'path:line-line'. A file has (path, content, is_binary); null content has no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept

#: How far a node can be trusted that has no, one, two, or more references that hold.
CEILINGS = [0.35, 0.82, 0.9, 0.94]
#: Lines that say nothing as a whole, beginnings of comments, tags of mere layout.
MUTE = r"^[\s\x{FEFF}]*(?:(?:<\?php|\?>|\{|\}|;)?\s*$|(?i:<!doctype|<!--|//|/\*|\* |-- )|(?i:</?(?:html|head|body|meta|title|div|span|font|center|br)[^>]*>)\s*$)"
REFERENCE = r"^(?:\./)*([^\n]+?):([0-9]{1,9})(-[0-9]+)?$"


def ceiling(n: Column) -> Column:
    out = F.lit(CEILINGS[-1])
    for k in range(len(CEILINGS) - 2, -1, -1):
        out = F.when(n == k, CEILINGS[k]).otherwise(out)
    return out


def references(nodes: DataFrame) -> DataFrame:
    """(id, k, path, line, ref) of every reference that names a place; ``ref`` is its normal form, ``k`` its position."""
    at = nodes.select("id", F.posexplode("evidence").alias("k", "text")).where(F.col("text").rlike(REFERENCE))
    part = lambda i: F.regexp_extract("text", REFERENCE, i)
    line = part(2).cast("int")
    return at.select("id", "k", part(1).alias("path"), line.alias("line"), F.concat(part(1), F.lit(":"), line.cast("string"), part(3)).alias("ref"))


def telling_lines(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, line) of every line of the files ``paths`` that says something; numbers begin at 1. Texts stay where they are cut."""
    cited = files.where("not coalesce(is_binary, false)").join(paths, "path", "left_semi")
    lines = cited.select("path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    return lines.where(~F.col("text").rlike(MUTE)).select("path", (F.col("at") + 1).alias("line")).distinct()


def reconcile(nodes: DataFrame, files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """``nodes`` with the references that hold, in order and once each, and what follows from them; ``updated``, ``reopened``, ``dropped`` say what was done.

    Status is source_backed or unverified, the confidence is bounded by the number of references, and a covered node
    that nothing backs any more is investigated again. With ``changed`` (path), references to other paths are known
    to hold and only these are checked, so ``files`` need not have more than the changed ones.
    References meet lines by (path, line) in a semi-join, whose busy side adaptive execution may split; no file's references are gathered.
    """
    at = references(nodes)
    asked = at if changed is None else at.join(changed.select("path"), "path", "left_semi")
    holds = asked.join(telling_lines(files, asked.select("path").distinct()), ["path", "line"], "left_semi").select("id", "k", "ref")
    if changed is not None:
        holds = holds.unionByName(at.join(changed.select("path"), "path", "left_anti").select("id", "k", "ref"))
    found = holds.groupBy(F.col("id").alias("_id")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "ref"))), lambda x: x.ref)).alias("_refs"))
    joined = nodes.join(found, F.col("id") == F.col("_id"), "left").withColumn("_refs", F.coalesce("_refs", F.array().cast("array<string>")))
    n = F.size("_refs")
    new = joined.withColumns({
        "_status": F.when(n > 0, "source_backed").otherwise("unverified"),
        "_confidence": F.least(F.coalesce("confidence", F.lit(0.0)), ceiling(n)),
        "reopened": F.coalesce((F.col("review_status") == "covered") & (n == 0), F.lit(False)),
        "dropped": F.greatest(F.lit(0), F.coalesce(F.size("evidence"), F.lit(0)) - n),
    })
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    new = new.withColumn("updated", ~(same("evidence", "_refs") & same("status", "_status") & same("confidence", "_confidence")) | F.col("reopened"))
    now = {"evidence": F.col("_refs"), "status": F.col("_status"), "confidence": F.col("_confidence"), "review_status": F.when(F.col("reopened"), "investigating").otherwise(F.col("review_status")), "revision": F.coalesce("revision", F.lit(0)) + F.col("updated").cast("int")}
    return new.select(*[(now.get(c, F.col(c))).alias(c) for c in nodes.columns], "updated", "reopened", "dropped")


def reconcile_changes(nodes: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """``nodes``, reconciled before, after the files ``changed`` (path) were written anew or deleted: as ``reconcile`` over all files.

    Only nodes that refer to a changed path are recomputed, by a delta join; the others pass by. ``files`` are the present ones.
    """
    paths = kept(changed.select("path").distinct(), "changed")
    touched = kept(references(nodes).join(paths, "path", "left_semi").select("id").distinct(), "touched")
    redone = reconcile(nodes.join(touched, "id", "left_semi"), files, paths)
    rest = nodes.join(touched, "id", "left_anti").select(*nodes.columns, F.lit(False).alias("updated"), F.lit(False).alias("reopened"), F.lit(0).alias("dropped"))
    return redone.unionByName(rest)


def merge(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with what was ``found`` (id, confidence, evidence) merged in: references united, the known ones first, the higher confidence, one revision more.

    Several finds of one id are united first, in order of their references; the result does not depend on the order of rows. New ids are
    candidates of revision 1, not yet verified. Reviews stay. Rows without an id are no nodes.
    """
    refs = found.where("id is not null").select("id", "confidence", F.explode_outer("evidence").alias("ref")).groupBy("id", "ref").agg(F.max("confidence").alias("confidence"))
    one = refs.groupBy(F.col("id").alias("_id")).agg(F.max("confidence").alias("_confidence"), F.array_sort(F.collect_list("ref")).alias("_refs"))
    both = nodes.join(one, F.col("id") == F.col("_id"), "full_outer")
    none = F.array().cast("array<string>")
    now = {
        "id": F.coalesce("id", "_id"),
        "confidence": F.greatest("confidence", "_confidence"),
        "evidence": F.array_distinct(F.concat(F.coalesce("evidence", none), F.coalesce("_refs", none))),
        "status": F.coalesce("status", F.lit("unverified")),
        "review_status": F.when(F.col("id").isNull(), "candidate").otherwise(F.col("review_status")),
        "revision": F.coalesce("revision", F.lit(0)) + F.col("_id").isNotNull().cast("int"),
    }
    return both.select(*[now.get(c, F.col(c)).alias(c) for c in nodes.columns])

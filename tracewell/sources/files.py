"""Files as tables: folders, archives, scanner reports, manifests, loosely written JSON."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tolerant

#: Languages by suffix.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "php": "php", "rb": "ruby", "sql": "sql", "html": "html", "md": "markdown", "json": "json"}
MOST_BYTES = 100 << 20


def language_of(path: Column, content: Column | None = None) -> Column:
    """The language by suffix; without a known one by how the text begins, else ``unknown``."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    out = F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)))
    if content is not None:
        out = F.coalesce(out, F.when(content.startswith("<?php"), "php").when(F.lower(content).startswith("<!doctype html"), "html"))
    return F.coalesce(out, F.lit("unknown"))


def tree(spark: SparkSession, root: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, size, sha256, language, is_binary) of every file below ``root``, read in parallel; larger files are left out without being read.

    Files with a zero byte are binary. The path is relative to ``root``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most)
    base = root.rstrip("/").rpartition(":")[2].lstrip("/")
    path = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    return files.select(path.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), language_of(path).alias("language"), (F.position(F.lit(b"\0"), F.col("content")) > 0).alias("is_binary"))


def texts(spark: SparkSession, root: str, most: int = 2 << 20) -> DataFrame:
    """(path, content) of files of at most ``most`` bytes as text; bytes that are no UTF-8 become the replacement character."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def manifest_digest(files: DataFrame) -> DataFrame:
    """(digest) of a tree: one hash of 64 bits a file, and a sum of them that no order changes; one row."""
    line = F.concat_ws("\0", "path", F.col("size").cast("string"), "sha256")
    return files.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64(line).cast("decimal(38,0)")).cast("string")), 256).alias("digest"))


def unsafe_member(name: str) -> bool:
    """An archive member that would leave the folder it is put in."""
    return name.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", name) or re.match(r"^[A-Za-z]:", name) is not None


def archives(spark: SparkSession, path: str, most: int = 5 << 30, most_files: int = 200_000) -> DataFrame:
    """(archive, path, size, sha256, content, problem) of the members of ZIP files, each archive in one task.

    A member that is absolute, climbs, is a link or repeats a name, and all beyond the limits of bytes and files of its
    archive, come without content and with the problem named. A broken archive is one row with the problem.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def members(name: str, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                seen: set[str] = set()
                total = 0
                for i, m in enumerate(z.infolist()):
                    if m.is_dir():
                        continue
                    total += m.file_size
                    link = m.external_attr >> 16 & 0o170000 == 0o120000
                    problem = "unsafe" if unsafe_member(m.filename) else "link" if link else "repeated" if m.filename in seen else "too large" if total > most or i >= most_files else None
                    seen.add(m.filename)
                    body = None if problem else z.read(m)
                    yield name, m.filename, m.file_size, body and hashlib.sha256(body).hexdigest(), body, problem
        except zipfile.BadZipFile:
            yield name, None, None, None, None, "broken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        names = ["archive", "path", "size", "sha256", "content", "problem"]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in members(name, content.as_py()):  # a member at a time: none but one is in memory
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    return files.mapInArrow(run, "archive string, path string, size long, sha256 string, content binary, problem string")


#: The reports' public formats: schema, and from its parsed value the list of (rule, path, line, severity, message).
_PLACE = "struct<line:long>"
REPORTS = {
    "semgrep": (f"results array<struct<check_id:string,path:string,start:{_PLACE},extra:struct<severity:string,message:string>>>", lambda r: F.transform(r.results, lambda x: finding(x.check_id, x.path, x.start.line, x.extra.severity, x.extra.message))),
    "bandit": ("results array<struct<test_id:string,filename:string,line_number:long,issue_severity:string,issue_text:string>>", lambda r: F.transform(r.results, lambda x: finding(x.test_id, x.filename, x.line_number, x.issue_severity, x.issue_text))),
    "gitleaks": ("array<struct<RuleID:string,File:string,StartLine:long,Description:string>>", lambda r: F.transform(r, lambda x: finding(x.RuleID, x.File, x.StartLine, F.lit("HIGH"), x.Description))),
    "trivy": (
        "Results array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,Severity:string,Title:string>>>>",
        lambda r: F.flatten(F.transform(r.Results, lambda t: F.transform(F.coalesce(t.Vulnerabilities, F.array().cast("array<struct<VulnerabilityID:string,Severity:string,Title:string>>")), lambda x: finding(x.VulnerabilityID, t.Target, F.lit(None).cast("long"), x.Severity, x.Title)))),
    ),
    "osv": (
        "results array<struct<source:struct<path:string>,packages:array<struct<vulnerabilities:array<struct<id:string,summary:string>>>>>>",
        lambda r: F.flatten(F.flatten(F.transform(r.results, lambda s: F.transform(s.packages, lambda p: F.transform(p.vulnerabilities, lambda x: finding(x.id, s.source.path, F.lit(None).cast("long"), F.lit("UNKNOWN"), x.summary)))))),
    ),
}


def finding(rule: Column, path: Column, line: Column, severity: Column, message: Column) -> Column:
    return F.struct(rule.alias("rule"), path.alias("path"), line.alias("line"), F.lower(severity).alias("severity"), message.alias("message"))


def tool_findings(reports: DataFrame) -> DataFrame:
    """(tool, rule, path, line, severity, message) of scanner reports (tool, report); unknown tools and broken JSON give none."""
    out = None
    for tool, (schema, rows) in REPORTS.items():
        parsed = reports.where(F.col("tool") == tool).select("tool", F.from_json("report", schema).alias("r"))
        one = parsed.select("tool", F.explode(rows(F.col("r"))).alias("f")).select("tool", "f.*")
        out = one if out is None else out.unionByName(one)
    return out


def dependencies(manifests: DataFrame) -> DataFrame:
    """(path, dependency) of manifests (path, content), each once: package and composer JSON, requirements, pyproject and Cargo tables, go.mod, pom, Gemfile, gradle."""
    text, name = F.col("content"), F.regexp_extract("path", r"([^/]+)$", 1)
    keys = lambda *fields: F.flatten(F.array(*[F.coalesce(F.map_keys(F.from_json(text, f"{f} map<string,string>").getField(f)), F.array().cast("array<string>")) for f in fields]))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 1)
    names = (
        F.when(name == "package.json", keys("dependencies", "devDependencies")).when(name == "composer.json", keys("require"))
        .when(name.rlike(r"^requirements.*\.txt$"), found(r"(?m)^([A-Za-z][\w.-]*)")).when(name == "pyproject.toml", found(r"\"([A-Za-z][\w.-]*)\s*[<>=~!\"\[]"))
        .when(name == "Cargo.toml", F.regexp_extract_all(F.regexp_extract(text, r"(?s)\[dependencies\](.*?)(?:\n\[|$)", 1), F.lit(r"(?m)^([\w-]+)\s*="), 1)).when(name == "go.mod", found(r"(?m)^\s*(?:require\s+)?([\w.-]+/[\w./-]+)\s+v"))
        .when(name == "pom.xml", found(r"<artifactId>([^<]+)</artifactId>")).when(name == "Gemfile", found(r"(?m)^\s*gem\s+['\"]([^'\"]+)")).when(name.rlike(r"\.gradle$"), found(r"(?:implementation|api)[ (]+['\"]([^'\"]+?):[^:'\"]*['\"]"))
    )
    return manifests.select("path", F.explode(F.array_distinct(names)).alias("dependency"))


def json_objects(df: DataFrame, text: str, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Add ``object``: the loosely written object in a text as JSON with sorted keys, null without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [tolerant.chosen(x, wanted) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else json.dumps(x, sort_keys=True) for x in got], pa.string())], names=[*batch.schema.names, "object"])

    base = df.drop("object")
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("object", T.StringType())]))

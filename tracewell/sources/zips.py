"""ZIP archives as a Spark data source: one archive is many tasks.

An archive's central directory lists its members with place and size. The driver reads the directories alone, a few kilobytes for each
thousand members, and deals the members into ranges of about ``rangeBytes`` compressed bytes; a task opens its archive, seeks
to its range and gives member after member, so no archive and no range is in memory. Conditions on ``archive``, ``path``, ``size`` and
``problem`` are answered from the directory, if the option ``pushdown`` is true and Spark's own setting for it as well: what they exclude
is never read.

    spark.dataSource.register(ZipMembers)
    spark.read.format("zip_members").option("path", "s3://bucket/archives").load()

Paths are URIs of any file system that pyarrow opens (a folder: its ``*.zip`` files). Limits and problems are those of ``files.archives``.
"""

from __future__ import annotations

import hashlib
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .files import unsafe_member

SCHEMA = "archive string, path string, size long, sha256 string, content binary, problem string"
#: What reading a damaged archive raises; pyarrow does not seek to before the start.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, pa.ArrowInvalid)
RANGE_BYTES, MOST_BYTES, MOST_FILES = 64 << 20, 5 << 30, 200_000


def write(df: DataFrame, name: str, content: str, place: str) -> None:
    """An archive for each partition of ``df`` in the folder ``place``, a member for each row; a task that runs again replaces its archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n = TaskContext.get().partitionId(), 0
        system, path = opened(f"{place}/part-{number:05d}.zip")
        with system.open_output_stream(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for member, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    z.writestr(member, body.as_py() or b"")
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    system, path = opened(place)
    system.create_dir(path)
    df.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


@dataclass
class Members(InputPartition):
    """The members of one archive that one task reads, by their place in the directory, with problems found in it."""

    archive: str
    members: list[tuple[int, str | None]]


class FromEnd:
    """A file whose seeking to before the start is an OSError, as zipfile expects; an archive without members has 22 bytes and is asked for more."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file

    def seek(self, place: int, whence: int = 0) -> int:
        try:
            return self.file.seek(place, whence)
        except pa.ArrowInvalid as e:
            if whence == 2:
                raise OSError(str(e)) from e
            raise

    def __getattr__(self, name: str):  # noqa: ANN204
        return getattr(self.file, name)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def archives_of(uri: str) -> list[str]:
    """The archives that a path names, as URIs in order."""
    system, path = opened(uri)
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [uri]
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(head + x.path for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".zip"))


def directory(archive: zipfile.ZipFile, most: int, most_files: int) -> Iterator[tuple[int, zipfile.ZipInfo, str | None]]:
    """(place, member, problem) of every file in an archive's directory."""
    seen: set[str] = set()
    total = 0
    for i, m in enumerate(archive.infolist()):
        if m.is_dir():
            continue
        total += m.file_size
        link = m.external_attr >> 16 & 0o170000 == 0o120000
        yield i, m, "unsafe" if unsafe_member(m.filename) else "link" if link else "repeated" if m.filename in seen else "too large" if total > most or i >= most_files else None
        seen.add(m.filename)


_TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), In: lambda x, v: x in v,
}


def holds(row: dict, conditions: list[Filter]) -> bool:
    """Whether the directory's part of a row passes all conditions; null passes only a test for null."""
    for c in conditions:
        value = row[c.attribute[0]]
        if isinstance(c, (IsNull, IsNotNull)):
            if (value is None) != isinstance(c, IsNull):
                return False
        elif value is None or not _TESTS[type(c)](value, c.value):
            return False
    return True


class ZipMembers(DataSource):
    """(archive, path, size, sha256, content, problem) of the members of ZIP archives. Options: path, rangeBytes, mostBytes, mostFiles, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (ChoosingReader if options.get("pushdown", "false").lower() == "true" else ZipReader)(schema, options)


class ZipReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.fields, self.path = [f.name for f in schema], options["path"]
        self.range_bytes, self.most, self.most_files = int(options.get("rangebytes", RANGE_BYTES)), int(options.get("mostbytes", MOST_BYTES)), int(options.get("mostfiles", MOST_FILES))
        self.conditions: list[Filter] = []

    def partitions(self) -> list[Members]:
        out: list[Members] = []
        for uri in archives_of(self.path):
            try:
                system, path = opened(uri)
                with system.open_input_file(path) as f, zipfile.ZipFile(FromEnd(f)) as z:
                    members: list[tuple[int, str | None]] = []
                    held = 0
                    for i, m, problem in directory(z, self.most, self.most_files):
                        if not holds({"archive": uri, "path": m.filename, "size": m.file_size, "problem": problem}, self.conditions):
                            continue
                        if members and held + m.compress_size > self.range_bytes:
                            out.append(Members(uri, members))
                            members, held = [], 0
                        members.append((i, problem))
                        held += m.compress_size
                    if members:
                        out.append(Members(uri, members))
            except BROKEN:
                if holds({"archive": uri, "path": None, "size": None, "problem": "broken"}, self.conditions):
                    out.append(Members(uri, [(-1, "broken")]))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        kinds = {"archive": pa.string(), "path": pa.string(), "size": pa.int64(), "sha256": pa.string(), "content": pa.binary(), "problem": pa.string()}

        def row(**values) -> pa.RecordBatch:  # noqa: ANN003
            return pa.RecordBatch.from_arrays([pa.array([values.get(n)], kinds[n]) for n in self.fields], names=self.fields)

        if not partition.members:
            return
        if partition.members[0][0] < 0:
            yield row(archive=partition.archive, problem="broken")
            return
        system, path = opened(partition.archive)
        with system.open_input_file(path) as f, zipfile.ZipFile(FromEnd(f)) as z:
            listed, wanted = z.infolist(), "content" in self.fields or "sha256" in self.fields
            for i, problem in partition.members:
                try:
                    body = z.read(listed[i]) if wanted and problem is None else None  # one member in memory at a time
                except BROKEN:
                    body, problem = None, "broken"
                digest = None if body is None else hashlib.sha256(body).hexdigest()
                yield row(archive=partition.archive, path=listed[i].filename, size=listed[i].file_size, sha256=digest, content=body, problem=problem)


class ChoosingReader(ZipReader):
    """With conditions answered by the directory; Spark asks for them if spark.sql.python.filterPushdown.enabled is true, and refuses this reader if not."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what the directory can answer and gives the rest back to Spark."""
        for f in filters:
            known = getattr(f, "attribute", None) and len(f.attribute) == 1 and f.attribute[0] in ("archive", "path", "size", "problem")
            if known and isinstance(f, (IsNull, IsNotNull, *_TESTS)):
                self.conditions.append(f)
            else:
                yield f

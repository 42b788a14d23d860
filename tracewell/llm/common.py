"""Helpers shared by the operators: scratch tables and Arrow passes over texts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step works on; a single longer text is one step of its own.
SLICE_BYTES = 2 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    A folder of this machine is set only in local mode, where the session names none; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/tracewell-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tracewell_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables made by ``stored`` that nothing reads any more, and let Spark delete the shuffles that made them.

    Spark keeps a shuffle's files until the driver's memory is collected and its plan is found to be gone, which in a loop of
    small plans may be long after the last round.
    """
    jvm = None
    for t in tables:
        path = getattr(t, "tracewell_path", None)
        if path:
            jvm, context = t.sparkSession._jvm, t.sparkSession.sparkContext
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    if jvm is not None:
        gc.collect()
        jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give memory that a finished task no longer needs back to the machine, as its worker may stay idle."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What tells rows apart: two hashes of id and text, as one of 64 bits would not do for very many rows.
KEY = ["row_key", "row_check"]


def row_keys(id: str, text: str) -> list[Column]:
    """The columns of KEY; rows that repeat id and text have the same."""
    return [F.xxhash64(F.col(id), F.col(text)).alias(KEY[0]), F.xxhash64(F.col(text), F.col(id)).alias(KEY[1])]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of ``column`` each."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def append_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    fields: list[T.StructField],
    text: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Add columns computed in Python to each row, in one Arrow pass without a shuffle.

    ``make()`` runs once a task and returns the function of a slice. An input column with the
    name of a new one is replaced.
    """
    names = [f.name for f in fields]
    base = df.drop(*names)
    schema = T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for piece in slices(batch, text, limit):
                yield pa.RecordBatch.from_arrays([*piece.columns, *step(piece)], names=[*piece.schema.names, *names])

    return base.mapInArrow(run, schema)

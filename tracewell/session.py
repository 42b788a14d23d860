"""A session with the settings that the operators expect."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import shared_dir


def session(app: str = "tracewell", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution; anything else as given. On a cluster, master and sizes come from the submission."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, kept in the folder of spark.checkpoint.dir that all machines share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame, tag: str = "kept") -> DataFrame:
    """``df`` written to the folder of spark.checkpoint.dir and read again: no lineage, and a size that joins can go by."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tracewell_path = path
    return out


def gone(*tables: DataFrame | None) -> None:
    """Delete tables made by ``kept`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "tracewell_path", None)
        if path:
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def let_go(spark: SparkSession) -> None:
    """Have the driver's memory collected, so that Spark deletes shuffles that nothing reads any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

"""Tables that streams write batch by batch, each batch once however often it runs.

A batch has a folder of its own, named by its id, and a commit record that is written last. A batch that runs again (its
executors or the driver were lost, or the checkpoint is older than the table) finds its record and does nothing, or replaces
what it left behind without one. Readers see the folders with a record only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import rows


class BatchTable:
    """A Parquet table below ``place`` that grows by batches."""

    def __init__(self, spark: SparkSession, place: str, schema: T.StructType) -> None:
        self.spark, self.place, self.schema = spark, place.rstrip("/"), schema

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}")

    def _files(self):  # noqa: ANN202
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """The ids of batches that are in the table."""
        folder = self._path("commits")
        if not self._files().exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files().listStatus(folder))

    def read(self, without: int | None = None) -> DataFrame:
        paths = [f"{self.place}/batch-{i}" for i in self.committed() if i != without]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def add(self, batch: DataFrame, batch_id: int) -> bool:
        """Writes a batch and its record; False if it is in the table already."""
        if batch_id in self.committed():
            return False
        batch.select(*[batch[f.name].cast(f.dataType) for f in self.schema]).write.mode("overwrite").parquet(f"{self.place}/batch-{batch_id}")
        self._files().create(self._path(f"commits/{batch_id}"), True).close()
        return True

    def append(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: every row of the stream once."""
        return lambda batch, batch_id: self.add(batch, batch_id) and None

    def insert_missing(self, keys: Sequence[str], order: Sequence[Column]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: the first row of each key that the table has not; later ones are ignored."""
        return lambda batch, batch_id: self.add(rows.insert_missing(self.read(batch_id), batch, keys, order), batch_id) and None


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there now goes through ``write``, batch by batch as the source's options bound them."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

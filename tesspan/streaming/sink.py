"""A table to which a stream appends each batch once.

A batch is written to a folder of its own and then committed by an empty file whose name holds the batch's number and that folder.
Readers take one folder for each number (of several the first by name, as a batch that is put again holds the same rows) and
nothing else.  So a batch put again after a restart, or by a second writer at the same time, counts
once, and what a failed attempt wrote is never seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BatchTable:
    """The table at path; batches have its schema, which is that of the stream."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _commits(self) -> dict[int, str]:
        """The number of each committed batch, and its folder."""
        folder = self._path(f"{self.path}/commits")
        if not self._files.exists(folder):
            return {}
        names = [s.getPath().getName().split(".", 1) for s in self._files.listStatus(folder)]
        return {int(n[0]): n[1] for n in sorted(names, reverse=True) if len(n) == 2 and n[0].isdigit()}

    def put(self, batch: DataFrame, batch_id: int) -> None:
        """Append a batch, unless one of this number was committed (for foreachBatch)."""
        if batch_id in self._commits():
            return
        name = uuid.uuid4().hex
        batch.write.parquet(f"{self.path}/data/{name}")
        self._files.create(self._path(f"{self.path}/commits/{batch_id}.{name}"), False).close()

    def read(self) -> DataFrame:
        """All committed rows, with the number of their batch."""
        names = sorted((name, k) for k, name in self._commits().items())
        if not names:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())]))
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{name}" for name, _ in names])
        of = self.spark.createDataFrame(names, "name string, batch long")  # one row for each batch
        at = F.regexp_extract(F.input_file_name(), "/data/([0-9a-f]{32})/", 1)
        return rows.withColumn("name", at).join(F.broadcast(of), "name").drop("name")

    def latest(self, *keys: str) -> DataFrame:
        """Of each key the rows of its last batch (for streams in update mode)."""
        last = F.max("batch").over(Window.partitionBy(*keys))
        return self.read().withColumn("_last", last).where("batch = _last").drop("_last")

"""A folder that driver and executors share, for what a query has to write on its way; sides that are broadcast once measured."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the folder in spark.checkpoint.dir; where that is unset under a temporary one, in local runs alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tesspan-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/tesspan/{label}-{uuid.uuid4().hex}"


def shared(df: DataFrame, label: str) -> DataFrame:
    """df written in the shared folder and read again: computed once, however often it is used."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(side: DataFrame) -> tuple[int, int]:
    """Rows of a table, and about how many bytes they take in memory."""
    width = F.lit(16)
    for field in side.schema:
        plain = isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))
        text = F.col(field.name) if isinstance(field.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(field.name))
        width = width + 16 + (F.lit(0) if plain else F.coalesce(F.octet_length(text), F.lit(0)))
    rows, size = side.agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows, size or 0


def small(side: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """side (written by shared(), as it is measured here), to be broadcast if it has no more rows and bytes than that; else as it is, for a shuffled join."""
    n, held = measured(side)
    return F.broadcast(side) if n <= rows and held <= size else side

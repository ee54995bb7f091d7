"""What several operators share: table access, written intermediates, size-checked joins."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a side up to which it is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset a temporary one, in local runs alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tesspan-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tesspan/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df in the shared folder and read it back: cuts lineage, survives a lost executor, is computed once."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> tuple[int, int]:
    """Rows of a saved table, and about how many bytes they take in memory."""
    bytes_of = F.lit(16)
    for field in df.schema:
        flat = isinstance(field.dataType, (T.StringType, T.BinaryType))
        plain = isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))
        size = F.lit(0) if plain else F.octet_length(field.name if flat else F.to_json(F.struct(field.name)))
        bytes_of = bytes_of + 16 + F.coalesce(size, F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(bytes_of)).first()
    return rows, size or 0


def hinted(side: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """side, to be broadcast if it has at most so many rows and bytes; else as it is, for a shuffled join.

    side should be a saved table: it is measured here.
    """
    n, held = sized(side)
    return F.broadcast(side) if n <= rows and held <= size else side


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def semi(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is (left_semi) or isn't (left_anti) in ids; null equals null here."""
    (own,) = unused(df, "__k")
    right = hinted(ids.select(F.col(key).alias(own)))
    return df.join(right, df[key].eqNullSafe(right[own]), how)


def anti(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return semi(df, ids, key, "left_anti")

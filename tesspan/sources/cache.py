"""Results that are kept under what they were computed from, and found again in any session.

A result's key is a digest of its optimised plan (in canonical form, so names of intermediate columns don't matter), of the path,
size and time of every file that each of its scans reads, in order, and of a version that the caller gives.  When a file
changes or the plan does, the key is another one.  A result is written to a folder of its own and then committed by
an empty file; of several writers the first by name counts, and what a failed one left is never read.

Plans that aren't determined by files and text need a version, which then stands for what the key can't see: Python functions, rows
that came from the driver or from another system.  Without one they are refused, as are plans that aren't deterministic.

A plan over files that are written anew for each call (as `functions/shared.py` does) has another key each time and is never found: keep
what it reads in the cache too, so that the way back to the tables is one of keys.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_SEEN = ("Range", "OneRowRelation")
_FIELDS = "spark.sql.debug.maxToStringFields"


class ResultCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def key(self, df: DataFrame, version: str = "") -> str:
        """The key of df's result; ValueError where it can't be told from another's."""
        before = self.spark.conf.get(_FIELDS, None)
        self.spark.conf.set(_FIELDS, str(2**31 - 1))
        try:
            plan = df._jdf.queryExecution().optimizedPlan()
            if not plan.deterministic():
                raise ValueError("the plan isn't deterministic")
            text = plan.canonicalized().toString()
        finally:
            self.spark.conf.set(_FIELDS, before) if before is not None else self.spark.conf.unset(_FIELDS)
        if not version and re.search(r"Python|Pandas|Arrow|UDF|MapPartitions|MapElements", text):
            raise ValueError("the plan calls functions whose code the key can't see: give a version")
        digest = hashlib.sha256(f"{version}\0{df.schema.simpleString()}\0{text}".encode())
        leaves = plan.collectLeaves()
        for i in range(leaves.size()):
            digest.update(self._leaf(leaves.apply(i), version).encode())
        return digest.hexdigest()

    def _leaf(self, leaf, version: str) -> str:
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            return "".join(sorted(f"\0{f}" for f in self._stated(leaf.relation().location().inputFiles()))) + "\1"
        if kind not in _SEEN and not version:
            raise ValueError(f"rows of {kind} don't come from files: give a version")
        return kind + "\1"

    def _stated(self, files) -> list[str]:
        out = []
        for f in files:
            status = self._files(f).getFileStatus(self._path(f))
            out.append(f"{f} {status.getLen()} {status.getModificationTime()}")
        return out

    def _committed(self, key: str) -> str | None:
        """The folder of the key's result, if there is one."""
        folder = f"{self.root}/{key}"
        files = self._files(folder)
        if not files.exists(self._path(folder)):
            return None
        marks = sorted(s.getPath().getName() for s in files.listStatus(self._path(folder)))
        return next((f"{folder}/{m.removeprefix('done-')}" for m in marks if m.startswith("done-")), None)

    def has(self, df: DataFrame, version: str = "") -> bool:
        return self._committed(self.key(df, version)) is not None

    def get(self, df: DataFrame, version: str = "") -> DataFrame:
        """df's rows from the cache; computed and kept first if they aren't there."""
        key = self.key(df, version)
        found = self._committed(key)
        if found is None:
            name = uuid.uuid4().hex
            df.write.option("compression", "zstd").parquet(f"{self.root}/{key}/{name}")
            mark = f"{self.root}/{key}/done-{name}"
            self._files(mark).create(self._path(mark), False).close()
            found = self._committed(key)
        return self.spark.read.schema(df.schema).parquet(found)

    def forget(self, df: DataFrame, version: str = "") -> None:
        """Drop df's result."""
        folder = f"{self.root}/{self.key(df, version)}"
        self._files(folder).delete(self._path(folder), True)

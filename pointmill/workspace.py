"""Lineage cutting through tables in the shared checkpoint folder.

``Workspace.keep`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back, so
that a lost executor costs a re-read, never a recomputation of an iterative plan.  Numbers gathered
during the write (row counts, changed rows) come from ``observe`` and need no extra job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SESSION_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where none is set and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SESSION_DIRS:
        _SESSION_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="pointmill-")
    return _SESSION_DIRS[app]


class Workspace:
    """Intermediate tables of one operator call; the folder is removed when the JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        self._n = 0

    def keep(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """Write ``df`` and return (the table read back, the observed measures)."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        seen: dict = {}
        if measures:
            watch = Observation()
            df.observe(watch, *[c.alias(k) for k, c in measures.items()]).write.parquet(path)
            seen = watch.get
        else:
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._kept_at = path
        return back, seen

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            self._fs.delete(self._path(t._kept_at), True)

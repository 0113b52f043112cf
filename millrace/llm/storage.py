"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it again, so a lost
executor costs a re-read, never a recomputation of the whole chain. On a cluster that setting is
required; only a local master may fall back to a temporary folder.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_RECORDS: list[list[Work]] = []


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared folder; a temporary one only where the setting is absent and the master local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _LOCAL[app]


@contextmanager
def recorded(into: list[Work]) -> Iterator[None]:
    """Note in ``into`` every folder that operators open meanwhile, so that the caller can delete them later."""
    _RECORDS.append(into)
    try:
        yield
    finally:
        _RECORDS.pop()


class Work:
    """A uniquely named folder for one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self.where: dict[str, str] = {}  # the last folder of each name
        self._open: list[str] = []
        if _RECORDS:
            _RECORDS[-1].append(self)

    def path(self, name: str) -> str:
        self._n += 1
        self.where[name] = f"{self.root}/{self._n:03d}-{name}"
        self._open.append(self.where[name])
        return self.where[name]

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return the table as read back: computed once, with measured sizes for the planner."""
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark remove the shuffle files of steps that are over; else they stay until the driver collects garbage by chance."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def prune(self, *names: str) -> None:
        """Delete all folders so far but the last ones of these names: what is returned reads no others."""
        kept = {self.where[n] for n in names}
        self.drop(*(p for p in self._open if p not in kept))
        self._open = [p for p in self._open if p in kept]

    def drop(self, *frames_paths: str) -> None:
        """Delete folders of this call that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in frames_paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

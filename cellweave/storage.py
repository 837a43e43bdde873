"""Written intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it back, so a lost executor costs
one re-read and never a recomputation of the loop.  The folder is the one named by the session setting
``spark.checkpoint.dir``; where that is unset and all runs on one machine a temporary folder is made and set.  On a
cluster an unset folder is an error, as executors would write to their own disks.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; made and recorded only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cellweave-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting by which the shuffle files of an execution go when it ends; by default they stay until the driver collects garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a write leaves no shuffle files behind.  Each write is planned anew, so no later one could read them."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE)
        else:
            spark.conf.set(FREE, before)


class Scratch:
    """A set of written tables under one fresh path; ``drop`` frees one, ``close`` frees all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._open = True
        OPEN.append(self)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet and return a DataFrame that reads it back."""
        self._n += 1
        path = f"{self.root}/{name}-{self._n}"
        with freed_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._cellweave_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        """Delete the table behind a DataFrame that ``write`` returned."""
        path = getattr(df, "_cellweave_path", None)
        if path:
            delete(self.spark, path)

    def close(self) -> None:
        if self._open:
            self._open = False
            if self in OPEN:
                OPEN.remove(self)
            delete(self.spark, self.root)


#: Scratch sets that results may still read from.
OPEN: list[Scratch] = []


def release(keep: int = 0) -> None:
    """Free the tables of earlier results, but for the newest ``keep`` sets.  Call it once those results are written."""
    while len(OPEN) > keep:
        OPEN.pop(0).close()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

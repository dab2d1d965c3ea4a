"""Derived relations, computed once and kept for as long as someone needs them.

Several results that come from one relation would each derive it again. ``Stored``
owns Parquet tables in the folder that driver and executors share: what it keeps
is written once, survives the loss of any executor, and goes when its owner ends.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset a local session
    takes a temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='inkstone-stored-')}"


class Stored:
    """An owner of stored relations: a context manager that deletes them at its
    end. Without one, ``kept`` leaves them until the JVM ends, for results that
    the caller still has to read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Stored:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            folder = self._path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = []

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def __call__(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again."""
        path = f"{shared_folder(self.spark)}/inkstone/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        folder = self._path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
        return self.spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept until the JVM ends."""
    return Stored(df.sparkSession)(df)

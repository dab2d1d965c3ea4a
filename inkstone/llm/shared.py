"""What the training-data operators share: tables written to the shared
folder, connected components over edges, and small text helpers."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting to remove a query's shuffle files when it has ended: what it
#: computed is in the written table, and nothing reads those files again.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of an Arrow batch while a table is written; Spark bounds a batch's bytes
#: itself (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB unless set).
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000

#: UTF-8 bytes; every byte that is not an ASCII upper-case letter maps to itself.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of a data folder; only the named columns, when any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Where that is unset, a local session takes a temporary folder
    of its own; on a cluster that is an error, as executors do not share one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='inkstone-')}"


@contextlib.contextmanager
def _setting(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings for the time of a write; the caller's come back after it."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` computed once, written as Parquet to the shared folder, and read
    again: cuts the lineage, and any executor can be lost afterwards. Arrow
    batches hold few rows meanwhile, as Python workers and the JVM each hold one
    at a time. The folder goes when the JVM ends; ``forget`` deletes it earlier."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkstone/{uuid.uuid4().hex}"
    rows = int(spark.conf.get(BATCH_SETTING))
    with _setting(spark, **{FREE_SHUFFLES: "true", BATCH_SETTING: str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)}):
        df.write.partitionBy(*partition_by).parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    again = spark.read.schema(df.schema).parquet(path)
    again._inkstone_path = path
    return again


def forget(df: DataFrame | None) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    path = getattr(df, "_inkstone_path", None)
    if path:
        spark = df.sparkSession
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge list of longs; the component
    is the smallest node reachable.

    Alternates large-star and small-star steps until the edge list is stable:
    each step is a min-aggregation and an equi-join, so a hub's rows are
    pre-aggregated on the map side and its join partition can be split by
    adaptive execution. Null ends and self-loops are ignored; repeated edges
    count once; an empty list gives an empty table. The driver sees only how
    many edges a round has changed.
    """
    now = written(
        edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
        .where(f"{u} is not null and {v} is not null and {u} <> {v}")
        .distinct()
    )
    changed = now.count()
    while changed:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = (
            both.join(least, F.col("a") == F.col("k"))
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        large = written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = (
            large.join(least, F.col("a") == F.col("k"))
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        following = written(small)
        # no edge twice on either side: equal sizes and nothing new mean equal lists
        changed = following.join(now, ["a", "b"], "left_anti").count() or now.count() - following.count()
        forget(now)
        forget(large)
        now = following
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def sha_of(items: Column, by: str = ",") -> Column:
    """Lower-case SHA-256 hex of an array of strings joined by ``by``."""
    return F.sha2(F.concat_ws(by, items), 256)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

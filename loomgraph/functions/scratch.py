"""Cutting lineage in loops: intermediate relations are written into the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; a temporary one only where both are unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the application's own part of the shared folder, which is deleted when the driver ends."""
    own = f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


#: Where ``materialize`` notes its paths, inside ``temporary``.
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextlib.contextmanager
def temporary() -> Iterator[list[str]]:
    """The paths that ``materialize`` writes inside, to be deleted by ``delete`` when nothing reads them any more."""
    paths: list[str] = []
    token = _NOTED.set(paths)
    try:
        yield paths
    finally:
        _NOTED.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes these paths and empties the list; Spark deletes shuffle files when the driver's JVM collects what refers to them."""
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()
    spark.sparkContext._jvm.java.lang.System.gc()


#: Bytes of files from which a relation isn't broadcast on the planner's word.
LARGE = 1 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it again. The planner takes files for their size on disk, of which encoded numbers need a
    fraction of what they take in the driver as a broadcast, so joins with more than ``LARGE`` are by a shuffle."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (noted := _NOTED.get()) is not None:
        noted.append(path)
    schema = df.schema
    df.write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return found.hint("merge") if size > LARGE else found

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs locally."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        found = context._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomgraph-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the application's own part of the shared folder, which is deleted when the driver ends."""
    own = f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key.replace("__", "."), value)
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a relation that ``materialize`` returned and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard_path(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done: it does so when the driver's JVM collects what refers to them."""
    spark.sparkContext._jvm.java.lang.System.gc()


def parts_for(rows: int, rows_each: int = 500_000) -> int:
    """How many partitions a small relation of a loop is written in, so that rounds don't write many tiny files."""
    return max(1, -(-rows // rows_each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is read; one that lies in fewer splits than there are cores is dealt out, as texts take long to look at."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    splits = found._jdf.queryExecution().toRdd().getNumPartitions()
    return found.repartition(cores) if splits < cores else found


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; every other column is left behind."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def slices(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of about ``size`` bytes, so that what a task holds at once is bounded."""
    for batch in batches:
        step = max(1, int(size * max(1, batch.num_rows) / max(1, batch.nbytes)))
        for at in range(0, max(1, batch.num_rows), step):
            yield batch.slice(at, step)

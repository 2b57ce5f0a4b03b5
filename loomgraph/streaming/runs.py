"""The run feed as a stream: an extension, no behaviour of batch operators depends on it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scratch import shared_dir

RUNS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def runtime_windows(runs: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Count and mean runtime by status and tumbling window; a stream names how late rows may come."""
    if late:
        runs = runs.withWatermark("ts", late)
    by = runs.groupBy("status", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("runtime_sec").alias("mean_sec"))
    return by.select("status", F.col("w.start").alias("start"), "n", "mean_sec")


def latest_edges(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each (job, dependent_job) inside the watermark."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job", "dependent_job"])


def streamed(spark: SparkSession, sf_dir: str, width: str = "1 day") -> DataFrame:
    """Runs the windows over the events as a stream until all of them are read; the last state of each window is returned."""
    path = f"{shared_dir(spark)}/loomgraph/stream-{uuid.uuid4().hex}"
    feed = spark.readStream.schema(RUNS).parquet(f"{sf_dir}/events.parquet*")
    runs = feed.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"), F.col("value").alias("runtime_sec"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

    writer = runtime_windows(runs, width, late="40 days").writeStream.outputMode("update").option("checkpointLocation", f"{path}/state")
    writer.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    last = out.groupBy("status", "start").agg(F.max_by(F.struct("n", "mean_sec"), "batch").alias("s"))
    return last.select("status", F.col("start").cast("timestamp_ntz").alias("start"), "s.n", "s.mean_sec")

"""Sessions of runs for each pair, by a stateful processor with event-time timers.

A session is a chain of rows of one pair with gaps of at most ``gap``. The processor keeps a pair's open sessions; rows may
come out of order and join sessions that were apart. A timer stands at the earliest end of one; when the watermark has passed it,
the sessions that nothing can extend any more are handed out with their latest row, and leave the state. Rows at or behind the
watermark are dropped, whatever session they would belong to.

State is bounded by the open sessions of a pair: what came within the watermark's delay and the gap.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomgraph.functions.scratch import shared_dir

FIELDS = ("started", "ended", "n", "last_id", "last_value")
SESSION = "started long, ended long, n long, last_id long, last_value double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(spans: list[tuple], gap: int) -> list[tuple]:
    """Spans (started, ended, n, last_id, last_value) put together where the gap allows; the latest row is that with the largest (ended, last_id)."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] - out[-1][1] <= gap:
            a = out[-1]
            latest = max(a, s, key=lambda x: (x[1], x[3]))
            out[-1] = (a[0], max(a[1], s[1]), a[2] + s[2], latest[3], latest[4])
        else:
            out.append(s)
    return out


class Sessions(StatefulProcessor):
    def __init__(self, gap: int, keys: list[str]):
        self.gap, self.keys = gap, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", SESSION)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        fresh = [(r.ms, r.ms, 1, r.id, r.value) for r in rows if r.ms > watermark]
        if fresh:
            self._keep(merged([tuple(s) for s in self.open.get()] + fresh, self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        spans = [tuple(s) for s in self.open.get()]
        done = [s for s in spans if s[1] + self.gap <= watermark]
        self._keep([s for s in spans if s[1] + self.gap > watermark])
        for s in done:
            yield Row(**dict(zip([*self.keys, *FIELDS], [*key, *s])))

    def close(self) -> None:
        pass

    def _keep(self, spans: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if spans:
            self.open.put(spans)
            self.handle.registerTimer(min(s[1] for s in spans) + self.gap)
        else:
            self.open.clear()


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Stateful processors need the store that keeps state off the heap."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def sessions(runs: DataFrame, keys: list[str], gap_ms: int, late: str) -> DataFrame:
    """Closed sessions (keys..., started, ended, n, last_id, last_value; times in ms) of a stream (keys..., ts, id, value)."""
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    rows = runs.withWatermark("ts", late).select(*keys, "ts", F.unix_millis("ts").alias("ms"), F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value"))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), SESSION])
    return rows.groupBy(*keys).transformWithState(statefulProcessor=Sessions(gap_ms, keys), outputStructType=schema, outputMode="append", timeMode="EventTime")


def session_table(runs: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """All sessions of a table, by the same rule."""
    ms = F.unix_millis("ts")
    order = F.struct(ms, F.col("id").cast("long"))
    by = Window.partitionBy(*keys).orderBy(order)
    starts = runs.withColumn("ms", ms).withColumn("new", F.coalesce((F.col("ms") - F.lag("ms").over(by) > gap_ms).cast("int"), F.lit(1)))
    numbered = starts.withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(*keys, "session").agg(F.min("ms").alias("started"), F.max("ms").alias("ended"), F.count(F.lit(1)).alias("n"), F.max_by(F.struct(F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value")), order).alias("last"))
    return found.select(*keys, "started", "ended", "n", F.col("last.id").alias("last_id"), F.col("last.value").alias("last_value"))


def streamed_sessions(spark: SparkSession, feed: DataFrame, keys: list[str], gap_ms: int, late: str) -> DataFrame:
    """Reads a stream to its end and gives the sessions that were closed."""
    path = f"{shared_dir(spark)}/loomgraph/sessions-{uuid.uuid4().hex}"
    with state_store(spark):
        writer = sessions(feed, keys, gap_ms, late).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sessions(feed, keys, gap_ms, late).schema).parquet(f"{path}/out")

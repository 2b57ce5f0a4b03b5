"""Stateful sessions against their batch form, late rows, and rows out of order."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomgraph.streaming import sessions

SCHEMA = "job long, status string, ts timestamp, id long, value double"
MINUTE = 60_000


def rows_of(spark, minutes):
    """(job, status, minute, id) as rows of a run feed."""
    made = spark.createDataFrame([(j, s, m * MINUTE, i, float(i)) for j, s, m, i in minutes], "job long, status string, ms long, id long, value double")
    return made.select("job", "status", F.timestamp_millis("ms").alias("ts"), "id", "value")


def feed_of(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_merged():
    a, b, c = (0, 5, 2, 1, 1.0), (20, 20, 1, 9, 9.0), (12, 12, 1, 3, 3.0)
    assert sessions.merged([b, a], 10) == [a, b]
    assert sessions.merged([b, a, c], 10) == [(0, 20, 4, 9, 9.0)]  # the middle one joins both
    assert sessions.merged([(0, 0, 1, 4, 4.0), (0, 0, 1, 7, 7.0)], 10) == [(0, 0, 2, 7, 7.0)]


def test_batches_late_rows_and_order(spark, tmp_path):
    path = str(tmp_path / "in")
    first = [(1, "a", 100, 1), (1, "a", 108, 2), (1, "a", 130, 3), (2, "b", 90, 4), (1, "b", 200, 5)]
    second = [(1, "a", 121, 6), (1, "a", 119, 7), (2, "b", 150, 8), (9, "z", 400, 9), (1, "a", 50, 10)]  # 50 is late: the watermark is 200 - 90
    third = [(2, "b", 160, 11), (9, "z", 2000, 12), (1, "b", 311, 13)]  # 160 is late now, 311 isn't
    last = [(5, "q", 2000, 14)]
    for n, batch in enumerate((first, second, third, last)):
        rows_of(spark, batch).coalesce(1).write.mode("append").parquet(path)
        import os
        import time

        newest = max((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (time.time() - 1000 + n * 100,) * 2)  # the order in which the stream reads the files
    found = sessions.streamed_sessions(spark, feed_of(spark, path), ["job", "status"], 20 * MINUTE, "90 minutes").collect()
    kept = first + [r for r in second if r[3] != 10] + [r for r in third if r[3] != 11] + last
    expected = sessions.session_table(rows_of(spark, kept), ["job", "status"], 20 * MINUTE).where(F.col("ended") + 20 * MINUTE <= (2000 - 90) * MINUTE).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected))
    assert (1, "a", 100 * MINUTE, 130 * MINUTE, 5, 3, 3.0) in {tuple(r) for r in found}


def test_random_rows_in_one_batch(spark, tmp_path):
    rng = random.Random(4)
    minutes = [(rng.randint(1, 6), rng.choice("ab"), rng.randint(0, 3000), i) for i in range(600)] + [(1, "a", 10_000, 999)]
    rows = rows_of(spark, minutes)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = sessions.streamed_sessions(spark, feed_of(spark, str(tmp_path / "in")), ["job", "status"], 15 * MINUTE, "1 hour").collect()
    expected = sessions.session_table(rows, ["job", "status"], 15 * MINUTE).where(F.col("ended") + 15 * MINUTE <= (10_000 - 60) * MINUTE).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected)) and len(found) > 100

"""The detector registry: one schema, order, isolation of failures; sinks by name."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import detectors
from loomgraph.sources import sinks


def test_failures_stay_alone(spark):
    registry = detectors.Registry()
    rows = spark.createDataFrame([("T", 2)], "target_table string, savings int")
    registry.detector("X", "good")(lambda ctx: ctx["rows"])
    registry.detector("Y", "raises")(lambda ctx: ctx["absent"])
    registry.detector("Z", "breaks late")(lambda ctx: ctx["rows"].withColumn("risk", F.raise_error(F.lit("late"))))
    registry.detector("W", "other columns")(lambda ctx: ctx["rows"].select(F.lit(1).alias("n")))
    registry.detector("V", "good again")(lambda ctx: ctx["rows"].withColumn("risk", F.lit("LOW")))
    found, report = registry.run(spark, {"rows": rows})
    assert [(r.detector, r.target_table, r.savings, r.risk) for r in found.orderBy("place").collect()] == [("X", "T", 2, None), ("V", "T", 2, "LOW")]
    told = {r.detector: r for r in report.collect()}
    assert {k: r.status for k, r in told.items()} == {"X": "OK", "Y": "FAILED", "Z": "FAILED", "W": "FAILED", "V": "OK"}
    assert "absent" in told["Y"].error and told["X"].n == 1 and told["Z"].n == 0
    assert registry.run(spark, {"rows": rows}, ["V"])[0].count() == 1
    with pytest.raises(KeyError):
        registry.run(spark, {}, ["none"])
    with pytest.raises(ValueError):
        registry.detector("X", "twice")(lambda ctx: None)
    nothing, empty = registry.run(spark, {}, [])
    assert nothing.count() == 0 and empty.count() == 0 and set(detectors.SCHEMA) < set(nothing.columns)


def test_all_detectors_on_tables(spark):
    from loomgraph.plans.detection import detector_context
    from loomgraph.sources.fixtures import Fixtures

    found, report = detectors.DETECTORS.run(spark, detector_context(Fixtures(spark, "/root/testdata/sf0.001")))
    assert {r.detector: r.status for r in report.collect()} == {k: "OK" for k in detectors.DETECTORS.known}
    kinds = {r.category for r in found.select("category").distinct().collect()}
    assert {"C. OFFSET / Near-Duplicate Procedures (Parameterized)", "C. OFFSET / Near-Duplicate Procedures", "C. Near-Duplicate Procedures", "F. LLM-Identified Issues", "O. View Naming Convention Violation"} <= kinds
    assert found.where("description is null or risk is null or savings is null or target_table is null").count() == 0


@pytest.mark.parametrize("name", sorted(sinks.SINKS))
def test_sinks(spark, tmp_path, name):
    rows = spark.createDataFrame([("a,\"b", 1), ("é\n", 2), (None, 3)], "x string, n int")
    sinks.write(rows, name, str(tmp_path / "out"))
    read = spark.read.options(header=True, multiLine=name == "csv", escape='"').format(name).load(str(tmp_path / "out"))
    assert sorted((r.x, int(r.n)) for r in read.select("x", "n").collect() if r.x) == [("a,\"b", 1), ("é\n", 2)] and read.count() == 3
    with pytest.raises(KeyError):
        sinks.write(rows, "nowhere", str(tmp_path))

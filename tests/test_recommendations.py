"""Every branch of the recommendation rules, on small relations."""

from __future__ import annotations

import pytest

from loomgraph.operators import recommendations as r


def test_source_systems(spark):
    names = ["x_cv_1", "A-PACS-B", "J_VUE-2", "LOAD_APS_3", "Q_SHINKA_9", "Z-EIS-1", "Z_EIS-1", "plain", "_CV_ _PACS_", "CV"]
    found = [x.s for x in spark.createDataFrame([(n,) for n in names], "job string").select(r.source_system(r.F.col("job")).alias("s")).collect()]
    assert found == ["CV", "PACS", "VUE", "APS", "SHINKA", None, "EIS", None, "CV", None]


def test_loads_branch_by_branch(spark):
    loads = [
        ("SPLIT", "A_CV_1", None), ("SPLIT", "A_PACS_1", "p"),  # one parameterised object, two systems
        ("SETTLED", "S-1", None), ("SETTLED", "S-2", None),  # one parameterised object
        ("HALF", "H-1", None), ("HALF", "H-2", None),  # one object, but only one job gives parameters
        ("FAMILY", "F_CV_1", None), ("FAMILY", "F_PACS_1", None),  # variants of one package, two systems
        ("UNKNOWN", "U_CV_1", None), ("UNKNOWN", "U_EIS_1", None),  # two systems, nothing known
        ("BOTH", "MYCV", None), ("BOTH", "MYPACS", None),  # names without marks, one package
        ("APART", "P_CV_1", None), ("APART", "P_PACS_1", None),  # two systems, two packages
        ("MEANT", "M-1", "multi_src"), ("MEANT", "M-2", "x MULTI_SRC"), ("PARTLY", "M-1", "MULTI_SRC"), ("PARTLY", "M-2", None),
        ("ONE", "O-1", None), ("ONE", "O-1", "again"), ("DAY_JOB_LOG", "L-1", None), ("DAY_JOB_LOG", "L-2", None), ("N/A", "L-1", None), ("N/A", "L-2", None), (None, "L-1", None), (None, "L-2", None),
    ]
    views = [("SEEN", "V-1", None, True), ("SEEN", "V-2", None, False)]
    objects = [
        ("A_CV_1", "K.M", True), ("A_PACS_1", "K.M", True), ("S-1", "K.S", True), ("S-2", "K.S", True), ("H-1", "K.H", True), ("H-2", "K.H", None), ("F_CV_1", "K.A", False), ("F_PACS_1", "K.B", False),
        ("MYCV", "K.A", False), ("MYPACS", "K.B", False), ("P_CV_1", "K.A", False), ("P_PACS_1", "L.A", False), ("M-1", "K.Z", False), ("M-2", "", True),
    ]
    given = spark.createDataFrame([(*x, False) for x in loads] + views, "tbl string, job string, params string, is_view boolean")
    found = {x.target_table: x for x in r.load_recommendations(given, spark.createDataFrame(objects, "job string, object string, is_parameterised boolean")).collect()}
    kinds = {k: (x.category[3:12], x.scope, x.savings, x.risk) for k, x in found.items()}
    design, redundant = ("Source Sy", "SOURCE_SYSTEM_SPLIT", 0, "LOW"), ("Redundant", "DIFF_SQL_OBJECTS", 1, "MEDIUM")
    assert kinds == {
        "SPLIT": design, "FAMILY": design, "UNKNOWN": design, "SETTLED": ("Already P", "ALREADY_PARAMETERIZED", 0, "LOW"), "HALF": redundant, "APART": redundant, "PARTLY": redundant,
        "BOTH": ("Redundant", "SAME_PKG_VARIANT", 1, "MEDIUM"),
    }
    assert "variants" in found["BOTH"].recommendation and "different SQL objects" in found["APART"].recommendation and found["HALF"].recommendation == "Investigate if loads can be consolidated."
    assert "CV, PACS" in found["SPLIT"].description and "'K.S'" in found["SETTLED"].description and found["UNKNOWN"].affected_jobs == "U_CV_1,U_EIS_1"


def test_updates_leave_meant_tables_alone(spark):
    rows = [("j", "TBL_1"), ("j", "TBL_2"), ("j", "T1"), ("j", "X_JOB_LOG"), ("k", "RPT_A"), ("k", "a_gtt"), ("l", "TBL_9")]
    reads = spark.createDataFrame(rows, "job string, tbl string")
    writes = spark.createDataFrame(rows[:-1] + [("l", "TBL_8")], "job string, tbl string")
    assert [(x.affected_jobs, x.target_table, x.savings, x.risk) for x in r.update_recommendations(reads, writes).collect()] == [("j", "TBL_1, TBL_2", 1, "MEDIUM")]


def test_chains_need_depth_and_no_common_columns(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in (1, 2, 3, 11, 12, 21, 31, 41, 42)] + [(42, 44)], "job long, dependent_job long")
    deep = {1: 3, 2: 4, 3: 5, 4: 6, 11: 3, 12: 4, 13: 5, 21: 2, 22: 3, 31: 5, 32: 6, 41: 3, 42: 4, 43: 5, 44: 5}
    jobs = spark.createDataFrame([(j, "MV" if j == 4 else "OTHER", d, j == 32) for j, d in deep.items()], "job long, category string, depth long, has_object boolean")
    writes = spark.createDataFrame([(11, "T", "A"), (12, "T", "A"), (1, "T", "A"), (2, "T", "B"), (3, "T", "A")], "job long, tbl string, col string")
    found = {x.affected_jobs: (x.current_hops, x.savings) for x in r.chain_recommendations(edges, jobs, writes).collect()}
    assert found == {"1,2,3": (3, 2), "41,42": (2, 1)}  # 11-13 share a column, 21 lies too high, 32 calls an object, 42 forks


@pytest.mark.parametrize("n_sources, taken, risk", [(1, 1, "MEDIUM"), (1, 2, "HIGH"), (4, 1, "HIGH"), (1, 0, "HIGH")])
def test_risk_of_views(spark, n_sources, taken, risk):
    columns = ["A", "B", "C"]
    views = spark.createDataFrame([("mv",)], "job string")
    reads = spark.createDataFrame([("mv", f"S{i}") for i in range(n_sources)] + [("c", "V"), ("other", "S0")], "job string, tbl string")
    written = spark.createDataFrame([("mv", "V", c) for c in columns], "job string, tbl string, col string")
    consumed = spark.createDataFrame([("c", "V", c) for c in columns[:taken]] + [("c", "W", "C")], "job string, tbl string, col string")
    writes = spark.createDataFrame([("mv", "V"), ("c", "W")], "job string, tbl string")
    found = r.view_recommendations(views, reads, writes, written, consumed).collect()
    assert [(x.affected_jobs, x.risk) for x in found] == [("mv,c", risk)]
    two = reads.unionByName(spark.createDataFrame([("d", "V")], "job string, tbl string"))
    assert r.view_recommendations(views, two, writes, written, consumed).count() == 0

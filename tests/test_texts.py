"""Text operators against plain Python on texts of several shapes."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import packages, scripts
from loomgraph.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"
AWKWARD = [
    "", "no procedure at all", "/* PROCEDURE a IS\nPROCEDURE b IS\n*/ PROCEDURE c IS\nBEGIN NULL;\nEND;\nEND pkg;",
    "PROCEDURE open_end IS\nBEGIN\n BEGIN\n  x;\n END;\nPROCEDURE next IS\nBEGIN\n y;\n END next;\nEND pkg;", "procedure main is\nbegin\n insert into t select 1 from s;\nend;",
    "PROCEDURE main;\nPROCEDURE p IS\nBEGIN -- BEGIN\n /* BEGIN */ p2;\n/*\nEND;\n*/\nEND;\nPROCEDURE main IS\nBEGIN\n p; p;\nEND;",
]


@pytest.fixture(scope="module")
def bodies(spark):
    fixed = [(r.script, r.name, r.body) for r in Fixtures(spark, SF)["fx_packages"].limit(40).collect()]
    return fixed + [(10_000 + i, f"PKG_{i}", t) for i, t in enumerate(AWKWARD)]


def brute_parts(body):
    lines = body.split("\n")
    inside, marks = False, []  # (in comment, line is looked at)
    for x in lines:
        closing = "*/" in x
        inside = False if closing else inside or "/*" in x
        marks.append((None if closing else inside, inside or x.lstrip().startswith("--")))
    starts = [(i, m[1].upper(), marks[i][1]) for i, x in enumerate(lines) if (m := re.match(r"(?i)^\s*PROCEDURE\s+(\w+)", x))]
    out = []
    for n, (i, name, gone) in enumerate(starts):
        stop = starts[n + 1][0] if n + 1 < len(starts) else len(lines)
        opened = depth = 0
        end = outer = None
        for j in range(i, stop):
            up = lines[j].strip().upper()
            m = re.match(r"END\s+(\w+)\s*;", up)
            outer = j if m else outer
            if marks[j][0] is None or marks[j][1]:
                continue
            opened += bool(re.search(r"\bBEGIN\b", up))
            ends = bool(re.match(r"END\s*;", up))
            depth += bool(re.search(r"\bBEGIN\b", up)) - ends
            if end is None and ((m and m[1] == name) or (ends and opened and depth <= 0)):
                end = j
        if end is None:
            end = outer - 1 if n + 1 == len(starts) and outer is not None and outer > i else stop - 1
        out.append((name, i + 1, None if gone else end + 1, gone, "\n".join(lines[i : end + 1])))
    others = any(not g and n not in ("MAIN", *packages.UTILITY_PROCEDURES) for n, *_, g, _ in out)
    rows = []
    for name, first, last, gone, text in out:
        change = re.search(r"(?i)\b(INSERT\s+(?:/\*[^*]*\*/\s*)?INTO|MERGE\s+INTO|UPDATE\s+\w)", text)
        status = "COMMENTED" if gone else "UTILITY" if name in packages.UTILITY_PROCEDURES else "EXTRACTED" if name != "MAIN" or not others else "HYBRID_MAIN" if change else "ORCHESTRATOR_MAIN"
        rows.append((name, first, last, status))
    return rows


def test_package_parts(spark, bodies):
    df = spark.createDataFrame(bodies, "script long, name string, body string")
    found = Counter((r.script, r.procedure, r.first_line, r.last_line, r.status) for r in packages.package_parts(df).collect())
    assert found == Counter((s, *row) for s, _, b in bodies for row in brute_parts(b))
    assert {"COMMENTED", "UTILITY", "HYBRID_MAIN", "ORCHESTRATOR_MAIN", "EXTRACTED"} <= {k[4] for k in found}


def test_comments_of_any_shape():
    cases = {
        "a /* x /* y */ z */ b": "a  b", "q'[it's; -- no]' -- yes": "q'[it's; -- no]' ", "'a''b--c' /* open": "'a''b--c' ", "x -- '\n'y'": "x \n'y'", "Q'{/*}' */": "Q'{/*}' */", "": "", "'open -- text": "'open -- text",
    }
    assert {k: scripts.without_comments(k) for k in cases} == cases
    assert scripts.statements("a(b;c); q'!d;e!'; 'f;g' ; ;h") == ["a(b;c)", "q'!d;e!'", "'f;g'", "h"]
    assert scripts.union_branches("select (a union b) union all select 'UNION' UNION select reunion") == ["select (a union b)", "select 'UNION'", "select reunion"]


def test_cleaned_procedures(spark):
    body = """PROCEDURE p IS
 CURSOR c1 IS SELECT a FROM src1; -- INSERT INTO no
BEGIN
 INSERT /*+ APPEND */ INTO t1

 SELECT 1 FROM s1 WHERE x = 'a;b';
 FORALL i IN v.FIRST .. v.LAST UPDATE t2 SET a = 1;
 COMMIT; log_time('x');
 EXECUTE IMMEDIATE 'CREATE TABLE t3 AS SELECT * FROM s3';
 EXECUTE IMMEDIATE 'DROP TABLE t3';
 v := 'MERGE INTO t4 USING s4'; EXECUTE IMMEDIATE v;
 FOR r IN c1 LOOP UPDATE t5 SET a = r.a; touch(c1); END LOOP;
 OPEN rc FOR SELECT b FROM s6;
EXCEPTION WHEN OTHERS THEN INSERT INTO err VALUES (1); END;"""
    df = spark.createDataFrame([(1, body), (2, "BEGIN NULL; END;"), (3, "")], "script long, body string")
    rows = sorted((r.script, r.part, r.at, re.sub(r"\s+", " ", r.statement)) for r in scripts.cleaned(df).collect())
    assert [(s, p, t) for s, p, _, t in rows] == [
        (1, 0, "INSERT INTO t1 SELECT 1 FROM s1 WHERE x = 'a;b'"), (1, 0, "UPDATE t2 SET a = 1"), (1, 0, "EXECUTE IMMEDIATE 'CREATE TABLE t3 AS SELECT * FROM s3'"),
        (1, 0, "MERGE INTO t4 USING s4'"), (1, 0, "UPDATE t5 SET a = r.a"), (1, 1, "INSERT INTO T1 SELECT b FROM s6"), (1, 1, "INSERT INTO T5 SELECT a FROM src1"), (1, 2, "MERGE INTO T4"),
    ]


SHELLS = [
    "v_p=$3\nEXECUTE IMMEDIATE 'begin ' || 'own.' || '$v_p' || '.main(1); end;'; EXECUTE IMMEDIATE 'begin '|| 'OWN.' || '$v_p' || ';end;';",
    "EXECUTE IMMEDIATE 'begin '|| 'OTH.' || '$zz' || ';end;';",
    "a=$1\nb=$4\nexecute immediate 'begin own.pkg_x' || '.load(:1); end;' USING a, c, b;\nEXECUTE IMMEDIATE 'BEGIN own.pkg_x.main(2); END;';\nEXECUTE IMMEDIATE 'BEGIN own.pkg_y.main(2); END;';",
    "EXECUTE IMMEDIATE 'begin own.prc_q' || '(${a}); end;'; EXECUTE IMMEDIATE 'begin own.prc_q' || '(1); end;';",
    "",
]


def brute_executed(body):
    forms = [r"\s*'\s*\|\|\s*'(\w+)\.'\s*\|\|\s*'\$(\w+)'\s*\|\|\s*'\.(\w+)", r"\s+(\w+)\.(\w+)'\s*\|\|\s*'\.(\w+)", r"\s+(\w+)\.(\w+)'\s*\|\|\s*'\(()", r"\s+(\w+)\.(\w+)\.(\w+)\s*\([^)]*\)\s*;\s*END\s*;'", r"\s*'\s*\|\|\s*'(\w+)\.'\s*\|\|\s*'\$(\w+)'\s*\|\|(?!\s*'\.\w)()"]
    out = []
    position = lambda v: f"${m[1]}" if (m := re.search(rf"\b{v}\s*=\s*\$(\d+)", body)) else None
    for rank, form in enumerate(forms, 1):
        for m in re.finditer(r"(?i)EXECUTE\s+IMMEDIATE\s+'begin" + form, body):
            schema, obj, sub = m[1].upper(), m[2], m[3]
            behind = body[m.end() : m.end() + 500]
            if rank in (1, 5):
                if rank == 5 and any(o[2] == schema and o[4] for o in out):
                    continue
                out.append((rank, "DYNAMIC", schema, f"${obj}", sub, True, position(obj) or "unknown"))
                continue
            obj = obj.upper()
            if rank in (3, 4) and any(o[3] == obj for o in out):
                continue
            using = re.search(r"(?is)USING\s+(.*?);", behind)
            listed = ",".join(filter(None, map(position, re.findall(r"\w+", using[1])))) if using and rank != 4 else ""
            out.append((rank, "STATIC", schema, obj, sub.upper() if rank == 4 else sub, rank != 4 and bool(re.search(r"\$\{?\w+\}?", behind)), listed))
    return out


def test_executed_calls(spark):
    texts = SHELLS + [r.body for r in Fixtures(spark, SF)["fx_shell"].limit(30).collect()]
    rows = scripts.executed_calls(spark.createDataFrame(list(enumerate(texts)), "script long, body string")).collect()
    assert Counter((r.script, r.rank, r.kind, r.schema, r.object, r.sub_object, r.parameterized, r.position) for r in rows) == Counter((i, *x) for i, t in enumerate(texts) for x in brute_executed(t))


def test_direct_calls(spark):
    block = "own.PKG_A.PRC_X(1);\nown.prc_b;\nPKG_C.main;\nPKG_A.main;\nPKG_D.PRC_Y(2);\nprc_y;\nPRC_Z(1);\nown.$v(n);\nLOG_TIME('PKG_Q.main; own.prc_q;');\ndbms_output.put_line(x);\nown.log_time;\nSQL.SQLCODE;\n19.0.0\nPRC_B;"
    texts = [f"sqlplus <<EOF\n{block}\nEOF\nPRC_OUTSIDE;", "x <<E\nEXECUTE IMMEDIATE 'a'; own.prc_no;\nE", "x <<E\nbegin dbms_mview.refresh('m'); own.prc_no; end;\nE\ny <<F\nown.PRC_B;\nown.prc_b;\nF", ""]
    rows = scripts.direct_calls(spark.createDataFrame(list(enumerate(texts)), "script long, body string")).collect()
    assert {(r.script, r.form, r.object_type, r.schema, r.object, r.sub_object) for r in rows} == {
        (0, "A", "PACKAGE", "OWN", "PKG_A", "PRC_X"), (0, "B", "PROCEDURE", "OWN", "PRC_B", ""), (0, "C", "PACKAGE", "ATOMIC", "PKG_C", "MAIN"), (0, "B", "PACKAGE", "ATOMIC", "PKG_D", "PRC_Y"),
        (0, "D", "PROCEDURE", "ATOMIC", "PRC_Z", ""), (0, "E", "PROCEDURE", "OWN", "$V", ""), (2, "B", "PROCEDURE", "OWN", "PRC_B", ""),
    }


def test_lines_in_comments(spark):
    texts = spark.createDataFrame([(1, "pkg", "-- PROCEDURE a\nPROCEDURE b\n/* PROCEDURE c\nPROCEDURE d */\nPROCEDURE e /* x */\nx.y(1);\nPKG_Z.F(1); -- PKG_Z.F(2);\n--PKG_Y.F(1);")], "script long, name string, body string")
    assert [(r.line, r.procedure, r.commented) for r in packages.listed_procedures(texts).orderBy("line").collect()] == [(1, "A", True) for _ in ()] + [(2, "B", False)]
    assert {(r.called, r.n, r.commented) for r in packages.external_calls(texts).collect()} == {("PKG_Z.F", 2, False), ("PKG_Y.F", 1, True)}


def test_nothing(spark):
    none = spark.createDataFrame([], "script long, name string, body string")
    for f in (packages.package_parts, packages.main_calls, packages.external_calls, packages.concept_branches, scripts.cleaned, scripts.executed_calls, scripts.direct_calls):
        assert f(none).where(F.lit(True)).count() == 0

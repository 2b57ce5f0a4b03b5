"""Substring matches and column traces against brute force."""

from __future__ import annotations

import json
import random
import re

import pytest

from loomgraph.operators import matching, trace


@pytest.mark.parametrize("automaton_chars", [matching.AUTOMATON_CHARS, 0])
def test_substring_pairs(spark, automaton_chars):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abÄ_.") for _ in range(n))
    texts = [word(rng.randint(0, 25)) for _ in range(150)] + [None, "", "ab", "ab"]
    patterns = [word(rng.randint(1, 6)) for _ in range(120)] + [None, "", "zzz", "a", "ab", "ab"]
    found = matching.substring_pairs(spark.createDataFrame([(t, 1) for t in texts], "text string, pattern int"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), automaton_chars).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == {(t, p) for t in texts if t for p in patterns if p and p in t}


def test_script_jobs_ways(spark):
    scripts = spark.createDataFrame([("pkg_a.load.sql",), ("PKG_A.txt",), ("x_pkg_b_y.sql",), ("for_tbl_12.sql",), ("nothing",)], "script string")
    objects = spark.createDataFrame([(1, "PKG_A.LOAD"), (2, "pkg_a.load"), (3, "PKG_A.LOAD_2"), (4, "PKG_B"), (5, None)], "job long, name string")
    targets = spark.createDataFrame([(7, "TBL_12", 5), (8, "tbl_1", 2), (9, "TBL_1", 9)], "job long, tbl string, pos long")
    expected = {("pkg_a.load.sql", "EXACT", 1), ("pkg_a.load.sql", "EXACT", 2), ("PKG_A.txt", "PARTIAL", 1), ("PKG_A.txt", "PARTIAL", 2), ("PKG_A.txt", "PARTIAL", 3), ("x_pkg_b_y.sql", "PARTIAL", 4), ("for_tbl_12.sql", "TARGET", 8), ("for_tbl_12.sql", "TARGET", 9)}
    for chars in (matching.AUTOMATON_CHARS, 0):
        assert {tuple(r) for r in matching.script_jobs(scripts, objects, targets, chars).collect()} == expected


def brute_trace(tables, others, relations):
    """All simple paths, written as a generator over nested calls."""
    entries, called = {}, {}
    for kind, listed in (("column", tables), ("other_col", others)):
        for parent, pid, columns in listed:
            entries[pid] = ("other" if kind == "other_col" else "table", parent, "")
            called["", parent.upper()] = pid
            for cid, name in columns:
                entries[cid] = (kind, name, parent)
                called[parent.upper(), name.upper()] = cid
    into = {}
    for kind, target, sources in relations:
        if kind not in ("call", "fdr"):
            into.setdefault(target, []).extend(sources)
    hidden = re.compile(trace.INTERNAL_NAMES.replace("(?i)", ""), re.I)

    def walk(node, hint, seen, labels):
        for source, column, space in into.get(node, []):
            if column == "*":
                meant = called.get((space.upper(), hint.upper()))
                if meant and meant not in seen:
                    yield from walk(meant, hint, seen | {meant}, labels)
                continue
            kind, name, parent = entries.get(source, (None, column, ""))
            if kind == "column":
                yield parent, name, labels
            elif source not in seen:
                label = {"other": name, "other_col": parent, None: column}.get(kind, "")
                yield from walk(source, column or hint, seen | {source}, labels + [label] if label else labels)

    out, known = [], set()
    for target in sorted({t for _, t, _ in relations if entries.get(t, ("",))[0] == "column"}):
        _, name, table = entries[target]
        unwrapped = re.match(trace.LONE_FUNCTION, name.strip())
        name = unwrapped[1] if unwrapped else name
        if hidden.match(name) or table.upper().endswith("_BKP"):
            continue
        hits = list(walk(target, name, {target}, []))
        if not hits:
            out.append((table, name, "", "", trace.CONSTANT))
        for src_table, src, labels in hits:
            if src not in trace.PSEUDO_SOURCES and (table, name, src_table, src) not in known:
                known.add((table, name, src_table, src))
                shown: list[str] = []
                for x in labels:
                    if not hidden.match(x) and x.upper() not in [y.upper() for y in shown]:
                        shown.append(x)
                out.append((table, name, src_table, src, " -> ".join(shown) or trace.DIRECT))
    return out


def test_column_trace_of_dumps(spark):
    rng = random.Random(7)
    dumps, expected = [], []
    for n in range(25):
        tables = [(f"T{t}" + ("_bkp" if t == 3 else ""), f"t{t}", [(f"t{t}c{c}", rng.choice(["A", "B", "sum( x.C)", "RS-4", "D"]) + (str(c) if c > 1 else "")) for c in range(3)]) for t in range(4)]
        others = [(rng.choice(["NVL", "nvl", "RS-1", "CTE-x", "DECODE", "SUB"]) + ("" if o % 2 else str(o)), f"o{o}", [(f"o{o}c{c}", rng.choice(["A", "B", "D2", "x"])) for c in range(2)]) for o in range(5)]
        ids = [c for _, _, cs in tables + others for c, _ in cs] + ["missing", "o1"]
        spaces = [p for p, _, _ in others]
        relations = []
        for _ in range(rng.randint(6, 26)):
            sources = [(rng.choice(ids), rng.choice(["", "A", "B", "*", "q"]), rng.choice(spaces).lower()) for _ in range(rng.randint(0, 3))]
            relations.append((rng.choice(["fdd", "fdd", "fdd", "fdr", "call", ""]), rng.choice(ids), sources))
        entry = lambda listed: [{"id": pid, "name": parent, "columns": [{"id": c, "name": name} for c, name in cs]} for parent, pid, cs in listed]
        flow = {"dbobjs": {"servers": [{"databases": [{"schemas": [{"tables": entry(tables), "others": entry(others)}]}]}]}, "relationships": [{"type": k, "target": {"id": t}, "sources": [{"id": s, "column": c, "parentName": p} for s, c, p in ss]} for k, t, ss in relations] + [{"type": "call"}]}
        text = json.dumps({"data": {"sqlflow": flow}} if n % 3 == 0 else flow)
        dumps.append((n, text if n % 2 else f"log line\n  {text}\nend"))
        expected += [(n, *r) for r in brute_trace(tables, others, relations)]
    dumps += [(98, None), (99, "no model"), (100, "{}")]
    parsed = trace.models(spark.createDataFrame(dumps, "object int, dump string"))
    found = trace.column_trace(trace.model_objects(parsed), trace.model_relations(parsed)).collect()
    assert sorted(map(tuple, found)) == sorted(expected) and len({r[5] for r in expected}) > 8


def test_column_trace_of_nothing(spark):
    objects = spark.createDataFrame([], "object int, pos int, id string, kind string, name string, parent string")
    relations = spark.createDataFrame([], "object int, rel int, nth int, type string, target string, source string, source_col string, source_parent string")
    assert trace.column_trace(objects, relations).count() == 0


def test_trace_in_slices(spark):
    """Slices of whole objects give the rows of all objects at once, and leave nothing behind but the result (F2)."""
    from pathlib import Path

    from loomgraph.functions.scratch import scratch_path
    from loomgraph.operators.trace import column_trace
    from loomgraph.sources.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    objects, relations = (fx[f"fx_model_{k}"].where("object < 40") for k in ("objects", "relations"))
    own = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    before = set(own.glob("*"))
    whole = sorted(map(str, column_trace(objects, relations).collect()))
    assert len(set(own.glob("*")) - before) == 1
    n = relations.count()
    sliced = column_trace(objects, relations, at_once=n // 3 + 1, counted=1)
    assert sorted(map(str, sliced.collect())) == whole and whole
    assert {p.rsplit("/", 2)[1] for p in sliced.inputFiles()} == {r[0].rsplit("/", 2)[1] for r in sliced.selectExpr("input_file_name()").distinct().collect()}  # each slice has rows
    assert len(set(own.glob("*")) - before) == 4

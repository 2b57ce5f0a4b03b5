"""Greedy clusters against the sequential rule."""

from __future__ import annotations

import random

import pytest

from loomgraph.operators import clusters


def sequential(items, similar):
    """founder of each item, looked at one after the other."""
    found, home = [], {}
    for i in items:
        place = next((c for c in found if all((m, i) in similar for m in c)), None)
        if place is None:
            place = []
            found.append(place)
        place.append(i)
        home[i] = place[0]
    return home


@pytest.mark.parametrize("seed, density", [(1, 0.1), (2, 0.4), (3, 0.8), (4, 0.97)])
def test_any_similarity(spark, seed, density):
    rng = random.Random(seed)
    rows, pairs, expected = [], [], {}
    for grp in "ab":
        items = sorted(rng.sample(range(500), 30))
        similar = {(a, b) for a in items for b in items if a < b and rng.random() < density}
        rows += [(grp, i) for i in items]
        pairs += [(grp, a, b) for a, b in similar]
        expected |= {(grp, i): f for i, f in sequential(items, similar).items()}
    for few in (0, clusters.FEW_PAIRS) if seed < 3 else (clusters.FEW_PAIRS,):
        found = clusters.greedy_clusters(spark.createDataFrame(rows, "grp string, item long"), spark.createDataFrame(pairs, "grp string, a long, b long"), few)
        assert {(r.grp, r.item): r.founder for r in found.collect()} == expected


def test_chain_and_empty(spark):
    items = [("x", i) for i in range(12)]
    pairs = [("x", i, i + 1) for i in range(11)]
    found = clusters.greedy_clusters(spark.createDataFrame(items, "grp string, item long"), spark.createDataFrame(pairs, "grp string, a long, b long"), 0)
    assert {r.item: r.founder for r in found.collect()} == {i: i // 2 * 2 for i in range(12)}
    none = spark.createDataFrame([], "grp string, item long")
    assert clusters.greedy_clusters(none, spark.createDataFrame([], "grp string, a long, b long")).count() == 0


def test_similar_pairs(spark):
    rng = random.Random(5)
    sets = {}
    for i in range(120):
        base = set(range(rng.choice([12, 20, 30])))
        sets[rng.choice("ab"), i] = frozenset(x for x in base if rng.random() < 0.95) | ({100 + i} if i % 9 == 0 else set()) | {0}
    df = spark.createDataFrame([(g, i, [str(x) for x in s]) for (g, i), s in sets.items()], "grp string, item long, members array<string>")
    expected = {(g, a, b) for (g, a), x in sets.items() for (h, b), y in sets.items() if g == h and a < b and len(x & y) / len(x | y) >= 0.85}
    assert {tuple(r) for r in clusters.similar_pairs(df).collect()} == expected and expected


def test_wide_clusters_query(spark):
    """The query on its whole table against the sequential rule over jobs."""
    from loomgraph.plans import registry
    from loomgraph.sources.fixtures import Fixtures

    sf = "/root/testdata/sf0.001"
    columns, first = {}, {}
    for r in Fixtures(spark, sf)["fx_wide_lineage"].collect():
        columns.setdefault((r.tgt_table, r.job), set()).add(r.tgt_col)
        first[r.tgt_table, r.job] = min(r.pos, first.get((r.tgt_table, r.job), r.pos))
    expected = set()
    for table in {t for t, _ in columns}:
        found: list[list[int]] = []
        for job in sorted((j for t, j in columns if t == table), key=lambda j: first[table, j]):
            own = columns[table, job]
            home = next((c for c in found if all(len(own & columns[table, o]) / len(own | columns[table, o]) >= 0.85 for o in c)), None)
            if home is None:
                home = []
                found.append(home)
            home.append(job)
        expected |= {(table, k, j) for k, c in enumerate(found) if len(c) > 1 for j in c}
    assert {tuple(r) for r in registry.queries()["f04_wide_clusters"](spark, sf).collect()} == expected
    assert len({(t, k) for t, k, _ in expected}) > 10

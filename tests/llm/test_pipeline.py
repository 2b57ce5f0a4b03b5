"""The pipeline's stages against brute-force versions on their own inputs."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest
from test_llm_operators import brute_components, brute_leaks, check_packing, rows_of

from loomgraph.llm._common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_columns_stay(inputs):
    assert all(d.columns == inputs[0].columns for d in inputs[:-1])


def test_quality_drops_labelled_bad_rows(spark, inputs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in rows_of(inputs[1])}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.9 * len(labels)


def test_exact_keeps_the_smallest_id(inputs):
    first = {}
    for i, t in sorted(rows_of(inputs[1])):
        first.setdefault(t, i)
    assert sorted(rows_of(inputs[2])) == sorted((i, t) for t, i in first.items())


def test_near_keeps_one_of_each_component(inputs):
    wanted = {c for _, _, c in brute_components(rows_of(inputs[2]))}
    assert {i for i, _ in rows_of(inputs[3])} == wanted


def test_leaks_go(spark, inputs):
    words = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, t in rows_of(inputs[3]) if any(f" {x} " in f" {words(t)} " for x in items if x)}
    kept = {i for i, _ in rows_of(inputs[4])}
    docs = rows_of(inputs[3])
    leaks = {docs[d][0] for d, _ in brute_leaks([t for _, t in docs], [r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    assert not whole & kept and kept == {i for i, _ in docs} - leaks


def test_packing_holds_every_token(inputs):
    check_packing(inputs[5].collect(), rows_of(inputs[4]))


def test_awkward_rows(spark, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), f"awkward-{name}")
        if name == "exact_dedup":
            texts = [t for _, t in rows_of(docs)]
            assert sorted(texts) == sorted({t for _, t in rows_of(before)})
        assert docs.count() >= 1
    docs = awkward.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0


def test_run(spark, inputs):
    assert corpus_pipeline.run(spark, SF).count() == inputs[-1].count()

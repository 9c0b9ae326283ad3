"""The pipeline, stage by stage, against plain versions on a stage's own input."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from kerbflow.llm import mixing, packing, qualityfm
from kerbflow.llm.common import read_documents, stage
from kerbflow.llm.queries import read_labels
from tests.llm import brute
from tests.llm.test_operators import check_packed

FOLDER = os.environ.get("KERBFLOW_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, out = read_documents(spark, FOLDER), []
    for _, stage_of in pipeline.STAGES:
        left = stage(stage_of(spark, docs, FOLDER), "pipeline-test")
        out.append((docs, left))
        docs = left
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_order_and_columns(spark, stages):
    assert [n for n, _ in pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    for docs, left in stages[:-1]:
        assert left.dtypes == docs.dtypes


def test_quality_stage(spark, stages):
    docs, left = stages[0]
    machine = qualityfm.fit(docs, read_labels(spark, FOLDER))
    keep = {r["doc_id"] for r in qualityfm.score(docs, machine).filter("predicted = 1").collect()}
    assert sorted(map(tuple, left.collect())) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] in keep)


def test_exact_stage(stages):
    docs, left = stages[1]
    best = {}
    for i, text in rows(docs):
        key, rank = brute.normal_digest(text), (-len(text or ""), i)
        best[key] = min(best.get(key, rank), rank)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for _, i in best.values())
    whole = {r["doc_id"]: tuple(r) for r in docs.collect()}
    assert all(whole[r["doc_id"]] == tuple(r) for r in left.collect())


def test_near_stage(stages):
    docs, left = stages[2]
    given = rows(docs)
    keep = {i for (i, _), k in zip(given, range(len(given))) if brute_classes(given)[k][0] == i}
    assert {r["doc_id"] for r in left.collect()} == keep


_found = {}


def brute_classes(given):
    key = len(given)
    if key not in _found:
        _found[key] = brute.near_classes(given)
    return _found[key]


def test_mixing_stage(stages):
    docs, left = stages[3]
    got = Counter()
    texts = dict(rows(docs))
    for i, text in rows(left):
        got[i] += len(brute.words(text))
        assert set(brute.words(text)) <= set(brute.words(texts[i]))
    want = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.mix(docs)).collect()}
    assert got == Counter({k: v for k, v in want.items() if v})


def test_packing_stage(stages):
    docs, left = stages[4]
    check_packed(left.collect(), rows(docs), packing.BinSizes())


def test_run_is_the_stages(spark, stages):
    docs, last = stages[4]
    got = Counter((r["doc_id"], r["n_words"]) for r in pipeline.run(spark, FOLDER).collect())
    assert got == Counter((r["doc_id"], r["n_words"]) for r in last.collect())


@pytest.mark.parametrize("empty", [True, False])
def test_stages_take_edge_rows_and_empty_tables(spark, empty):
    """Nulls, repeats and clashing names go through every stage; no rows give no rows."""
    docs = spark.createDataFrame([] if empty else brute.EDGES, brute.SCHEMA)
    docs = docs.withColumns({c: F.lit(7) for c in brute.CLASHES})
    for k, (name, stage_of) in enumerate(pipeline.STAGES):
        left = stage(stage_of(spark, docs, FOLDER), "pipeline-edges")
        if k < len(pipeline.STAGES) - 1:
            assert left.columns == docs.columns
        assert not (empty and left.head(1)), name
        docs = left
    if not empty:
        words = sum(r["n_words"] for r in docs.collect())
        assert words > 0

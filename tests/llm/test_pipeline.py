"""The corpus pipeline, stage by stage, against brute-force versions."""

from __future__ import annotations

import os
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_corpus_ops import ODD, SCHEMA, brute_components, check_pieces

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == columns
    texts = {r.doc_id: r.text for r in seen["toxicity"]}
    clean = {r.doc_id for r in seen["exact_dedup"]}
    assert len(clean) >= 0.7 * len(texts)

    last = {}
    for i in clean:
        last[texts[i]] = max(i, last.get(texts[i], i))
    assert {r.doc_id for r in seen["near_dedup"]} == set(last.values())

    comps = brute_components([(r.doc_id, r.text) for r in seen["near_dedup"]], 5, 80)
    assert {r.doc_id for r in seen["mix"]} == {i for i, n, c in comps if n == 0 or i == c}

    assert max(Counter(r.doc_id for r in seen["pack"]).values()) <= 3
    assert all(r.text == texts[r.doc_id] for r in seen["pack"])
    packed = docs.collect()
    check_pieces(packed, [tuple(r)[:2] for r in seen["pack"]])


def test_run_returns_pieces(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Nulls, empty and long texts, repeats, ties, and columns with names of ours."""
    odd = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "'r' as row", "0 as size", "true as kept", "0 as id")
    left = {"toxicity": len(ODD), "exact_dedup": 8, "near_dedup": 10}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name in left:
            assert out.columns == odd.columns and out.count() == left[name]
        elif name == "mix":
            assert out.columns == odd.columns
    none = odd.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0

"""Registered queries against their SQL, and the pipeline's stages."""

import pytest

import corpus_pipeline
from feedloom.llm import decontam, mixing, quality, simhash
from feedloom.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_definition(spark, duck, name):
    compare(spark, duck, name, QUERIES, ORACLE_SQL)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decisions, recomputed from its own input, take effect, and columns stay those of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = [r["doc_id"] for r in at.collect()], [r["doc_id"] for r in out.collect()]
        if k == 0:
            kept = quality.classify(at, spark.read.parquet(f"{SF}/labels.parquet"), carry=[]).where("predicted = 1")
            assert sorted(after) == sorted(r["doc_id"] for r in kept.collect())
        if k == 1:
            assert sorted(after) == sorted({r["component_id"] for r in simhash.near_duplicates(at).collect()})
        if k == 2:
            bad = decontam.contamination(at, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
            assert sorted(after) == sorted(set(before) - {r["doc_id"] for r in bad.collect()})
        if k == 3:
            want = {r["doc_id"]: r["copies"] for r in mixing.copies(at).collect()}
            assert {i: after.count(i) for i in set(after)} == {i: n for i, n in want.items() if n}
        if k < 4:
            assert out.columns == columns
            at = out
        else:
            assert sorted(after) == sorted(before)

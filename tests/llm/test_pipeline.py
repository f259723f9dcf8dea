"""The pipeline's stages on one small corpus, each against a plain version over its own input."""

import duckdb
import pytest

import corpus_pipeline
from epochlens.llm import decontamination, mixing, quality
from epochlens.llm.common import saved
from test_pairs import plain_classes, plain_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name)
        out.append(docs.toPandas())
    return out


def test_columns_and_order(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard", "benchmark_decontamination", "source_mixing"]
    for frame in results[:5]:
        assert list(frame.columns) == list(results[0].columns)


def test_quality_stage(spark, results):
    scores = quality.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    assert set(results[1].doc_id) == set(scores[scores.accepted].doc_id) and 0 < len(results[1]) < len(results[0])


def test_line_stage(results):
    before, after = results[1].sort_values("doc_id"), results[2].sort_values("doc_id")
    assert list(before.doc_id) == list(after.doc_id)
    assert list(after.text) == plain_lines(list(before.text)) and list(after.n_chars) == list(after.text.str.len())


def test_jaccard_stage(results):
    before = results[2].sort_values("doc_id")
    _, comp = plain_classes(list(before.text))
    ids = list(before.doc_id)
    assert set(results[3].doc_id) == {ids[i] for i, c in comp.items() if i == c}


def test_decontamination_stage(spark, results):
    before = spark.createDataFrame(results[3])
    leaking = {r[0] for r in decontamination.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").collect()}
    assert set(results[4].doc_id) == set(results[3].doc_id) - leaking


def test_mixing_stage(results):
    docs = results[4]
    want = duckdb.sql(mixing.SQL.format(docs="docs")).df()
    key = lambda d: sorted(d[["doc_id", "size", "source_size", "taken"]].itertuples(index=False, name=None))
    assert key(results[5]) == key(want)


def test_run_is_the_same(spark, results):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(results[5].itertuples(index=False, name=None))

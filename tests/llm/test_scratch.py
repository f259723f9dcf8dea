"""What a stage leaves in the shared folder and in Spark's own folders."""

from pathlib import Path

import corpus_pipeline
from epochlens.llm.common import CLEANUP, discard, saved, saved_alone, scratch_root

SF = "/root/testdata/sf0.001"


def names(spark):
    root = Path(scratch_root(spark).removeprefix("file://"))
    return {x.name for x in root.iterdir()} if root.exists() else set()


def test_a_stage_leaves_its_result_alone(spark):
    before = names(spark)
    docs = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    left = names(spark) - before
    assert len(left) == 1 and "quality_classifier" in next(iter(left))
    assert docs.count() > 0
    discard(docs)


def test_tables_of_stages_within_stages(spark):
    before = names(spark)
    one = saved(spark.range(3).toDF("a"), "one")

    def make():
        inner = saved_alone(spark, lambda: saved(spark.range(5).toDF("a"), "two"), "three")
        return inner.filter("a > 2")

    out = saved_alone(spark, make, "four")
    assert sorted(r.a for r in out.collect()) == [3, 4] and one.count() == 3
    assert sorted(n.split("-")[1] for n in names(spark) - before) == ["four", "one"]
    discard(one, out)


def test_shuffle_files_go_with_their_query(spark):
    before = spark.conf.get(CLEANUP, None)
    blocks = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    shuffles = lambda: {x.name for x in blocks.rglob("shuffle_*.data")}
    had = shuffles()
    out = saved(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counted")
    assert not shuffles() - had and spark.conf.get(CLEANUP, None) == before and out.count() == 7
    discard(out)


def test_later_stages_leave_no_copy_of_the_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (corpus_pipeline.line_stage, corpus_pipeline.jaccard_stage, corpus_pipeline.decontamination_stage):
        before = names(spark)
        out = stage(spark, docs, SF)
        left = names(spark) - before
        assert len(left) == 1 and out.count() > 0
        kept = spark.read.parquet(f"{scratch_root(spark)}/{next(iter(left))}")
        assert not {"text", "lang", "source"} & set(kept.columns)


def test_a_run_leaves_its_last_input_and_small_tables(spark):
    before = names(spark)
    out = corpus_pipeline.run(spark, SF)
    left = {n.split("-")[1] for n in names(spark) - before}
    assert "benchmark" in {n.split("_")[0] for n in left} and not left & {"quality_classifier", "line_dedup", "ngram_jaccard", "scored", "gone", "leaking"}
    assert out.count() > 0


def test_a_saved_result_is_not_saved_again(spark):
    before = names(spark)
    out = saved_alone(spark, lambda: saved_alone(spark, lambda: saved(spark.range(5).toDF("a"), "one"), "two"), "three")
    assert {n.split("-")[1] for n in names(spark) - before} == {"one"} and out.count() == 5
    discard(out)

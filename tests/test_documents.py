"""Long documents, reports without a bound, and runs that are published whole."""

import json
import resource

import pytest
from pyspark.sql import functions as F

from epochlens.operators import boundaries as B
from epochlens.operators import matching as M
from epochlens.operators import reports as R
from epochlens.plans import publication as P
from epochlens.plans import scan as S
from epochlens.sources import documents as D
from test_engine import FILES


@pytest.fixture(scope="module")
def run(spark):
    files = spark.createDataFrame(FILES, "path string, content string").unionByName(spark.range(40).select(F.concat(F.lit("gen/f"), "id", F.lit(".c")).alias("path"), F.lit("void f(void) {\n  int x = (int) time(0);\n  long y = time(0) + 5;\n}\n").alias("content")))

    def scorer(batch):
        return batch.assign(summary="yes", confidence=0.95, reason='told "so"')

    options = S.Options(abi=B.Abi("ILP32", 32, True), migrate_to=B.Abi("LP64", 64, False), scorer=scorer, model="m")
    return S.scan_files(files, M.default_rules(spark), options), options


def by_folder(path):
    return F.regexp_extract(path, r"^([^/]*)/", 1)


def test_long_documents_equal_short_ones(spark, run, tmp_path):
    tables, options = run
    short = {r["repo"]: r["document"] for r in S.result_documents(tables, by_folder, options, timestamp="-").collect()}
    assert set(short) == {"src", "gen"} and all(len(json.loads(x)["candidates"]) == json.loads(x)["meta"]["candidate_summary"]["total"] > 0 for x in short.values())
    written = D.write_documents(S.document_pieces(tables, by_folder, options, timestamp="-"), f"file://{tmp_path}/long").collect()
    assert {r["document"]: (tmp_path / "long" / r["file"]).read_text(encoding="utf-8") for r in written} == short
    assert all((tmp_path / "long" / r["file"]).stat().st_size == r["n_bytes"] for r in written) and not (tmp_path / "long" / "fragments").exists()


def test_one_document_over_many_tasks(spark, tmp_path):
    """The pieces of one document are written by many tasks, none of which grows with it."""
    n = 400_000
    rows = spark.range(n).select(*D.piece(F.lit("a/b c"), 1, F.lpad(F.col("id").cast("string"), 12, "0"), F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"é":"'), F.repeat(F.lit("x"), 100), F.lit('"}')), ","))
    ends = spark.createDataFrame([("a/b c", 0, "", "[", None), ("a/b c", 2, "", "]", None), (None, 0, "", "none", None)], "document string, section int, key string, text string, glue string")
    row = [r for r in D.write_documents(rows.repartition(16).unionByName(ends), f"file://{tmp_path}/one").collect() if r["document"]][0]
    assert row["n_fragments"] >= 2 and row["file"] == "a%2Fb%20c.json"
    found = json.loads((tmp_path / "one" / row["file"]).read_text(encoding="utf-8"))
    assert [x["id"] for x in found] == list(range(n)) and (tmp_path / "one" / "_.json").read_text() == "none"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > 0


def test_glue_between_fragments(spark, tmp_path):
    """Section ends and fragment ends may fall anywhere."""
    text = [(0, "", "<", None), *[(1, f"{i:03d}", f"r{i}", "|") for i in range(50)], (2, "", ">", None), *[(3, f"{i:03d}", f"s{i}", "") for i in range(50)], (4, "", "$", None)]
    rows = spark.createDataFrame([(d, *x) for d in ("p", "q") for x in text], "document string, section int, key string, text string, glue string")
    want = "<" + "|".join(f"r{i}" for i in range(50)) + ">" + "".join(f"s{i}" for i in range(50)) + "$"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        written = D.write_documents(rows, f"file://{tmp_path}/g", ".txt").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(tmp_path / "g" / r["file"]).read_text() for r in written} == {want} and all(r["n_fragments"] > 3 for r in written)
    none = D.write_documents(rows.limit(0), f"file://{tmp_path}/none").collect()
    assert none == []


def test_reports_without_a_bound(spark, tmp_path):
    raw = spark.createDataFrame([(f"F{i:03d}", f"a&{i % 7}.c:f", "yes" if i % 3 else "no", f"why <{i}>", float(i % 10) / 10, f"r{i % 4}") for i in range(60)], "finding_id string, file string, y2038_issue string, reason string, confidence double, rule_id string")
    findings = R.normalize_findings(raw).checkpoint()
    for mode in (True, False):
        D.write_documents(R.text_pieces(findings, f"t{mode}", mode), f"file://{tmp_path}/t{mode}", ".txt")
        assert (tmp_path / f"t{mode}" / f"t{mode}.txt").read_text() == R.render_text(findings, list_mode=mode)
    for group in ("none", "file", "rule"):
        D.write_documents(R.html_pieces(findings, "page", "T & t", group), f"file://{tmp_path}/{group}", ".html")
        assert (tmp_path / group / "page.html").read_text() == R.render_html(findings, "T & t", group_by=group)


def test_published_runs(spark, run, tmp_path):
    tables, options = run
    path = f"file://{tmp_path}/runs"
    with pytest.raises(ValueError, match="nothing was published"):
        P.published(spark, path, "candidates")
    first = S.publish_run(tables, path, options, timestamp="-")
    n = tables.candidates.count()
    assert first["number"] == 1 and P.published(spark, path, "candidates").count() == n
    assert P.published(spark, path, "rules").dtypes == tables.rules.dtypes
    folder = tmp_path / "runs" / "versions" / first["id"] / "documents"
    assert json.loads((folder / f"{'.'}.json").read_text())["meta"]["candidate_summary"]["total"] == n
    old = P.published(spark, path, "candidates", first)

    # A run that stops midway leaves the one before, whole.
    @F.udf("string")
    def broken(x):
        raise RuntimeError("stopped")

    half = {"candidates": tables.candidates.limit(1), "findings": tables.findings.withColumn("path", broken("path"))}
    with pytest.raises(Exception, match="stopped"):
        P.publish(spark, path, half)
    assert P.current(spark, path) == first and P.published(spark, path, "candidates").count() == n and len(list((tmp_path / "runs" / "versions").iterdir())) == 2

    second = P.publish(spark, path, {"candidates": tables.candidates.limit(1)})
    assert second["number"] == 2 and P.published(spark, path, "candidates").count() == 1 and old.count() == n
    with pytest.raises(ValueError, match="no table findings"):
        P.published(spark, path, "findings")
    gone = P.expire(spark, path, 2)
    assert len(gone) == 1 and P.published(spark, path, "candidates", first).count() == n
    P.expire(spark, path, 1)
    assert P.published(spark, path, "candidates").count() == 1 and len(list((tmp_path / "runs" / "versions").iterdir())) == 1


def test_two_publishers_do_not_hide_each_other(spark, tmp_path, monkeypatch):
    path, rows = f"file://{tmp_path}/two", spark.range(3)
    put, seen = P._put, []

    def late(session, where, manifest):
        if not seen:
            seen.append(1)
            P.publish(session, where, {"t": rows.limit(1)}, part="b")
        put(session, where, manifest)

    monkeypatch.setattr(P, "_put", late)
    last = P.publish(spark, path, {"t": rows}, part="a")
    assert last["number"] == 2 and sorted(last["parts"]) == ["a", "b"] and P.published(spark, path, "t").count() == 4
    P.publish(spark, path, {"t": rows.limit(2)}, part="a")
    assert P.published(spark, path, "t").count() == 3
    with pytest.raises(P.Taken):
        put(spark, path, {"number": 1})


def test_a_stream_publishes_its_batches(spark, tmp_path):
    from epochlens.streaming.watch import watch_published

    (tmp_path / "in").mkdir()
    rules, path = M.default_rules(spark), f"file://{tmp_path}/out"
    for name in ("a", "b"):
        spark.createDataFrame([(f"{name}.c", "time_t x;\n")], "path string, content string").write.mode("append").parquet(f"{tmp_path}/in")
        watch_published(spark, str(tmp_path / "in"), rules, path, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["path"] for r in P.published(spark, path, "candidates").select("path").distinct().collect()) == ["a.c", "b.c"]
    assert sorted(P.current(spark, path)["parts"]) == ["batch-0", "batch-1"]

"""Result documents: whole for each file, and in parts for repositories of any size."""

import json

from pyspark.sql import functions as F

from epochlens.operators import candidates as C
from epochlens.operators import matching as M
from epochlens.plans import scan as S
from epochlens.sources import documents as D
from test_documents import by_folder, run  # noqa: F401
from test_engine import FILES


def test_document_of_a_file_is_whole(spark):
    texts = ["int f(void) {", "time_t t = time(NULL);", "int x = (int) time(NULL);", "}", "time_t late;"]
    lines = spark.createDataFrame([("a.c", i, x) for i, x in enumerate(texts, 1)] + [("b.c", 1, "time_t t;")], "path string, line int, text string")
    spans = spark.createDataFrame([("a.c", "f", 1, 4)], "path string, name string, start_line int, end_line int")
    found = S.scan(lines, M.default_rules(spark)).candidates
    got = {r["path"]: json.loads(r["document"]) for r in S.result_document(C.join_functions(found, spans), spans, timestamp="-").collect()}
    assert set(got) == {"a.c", "b.c"} and all(list(d) == ["schema_version", "meta", "candidates", "assessments", "findings"] for d in got.values())
    for path, d in got.items():
        assert [x["candidate_id"] for x in d["candidates"]] == sorted(r["candidate_id"] for r in found.collect() if r["path"] == path)
        assert {"col_start", "col_end", "description", "discovery_method", "rule_id"} <= set(d["candidates"][0]) and d["assessments"] == []
        assert d["meta"]["candidate_summary"]["total"] == len(d["candidates"]) and d["meta"]["candidate_summary"]["findings"] == len(d["findings"])
    assert [(x["function_id"], x["y2038_issue"]) for x in got["a.c"]["findings"]] == [("a.c@f:1-4", "abstain")] and got["b.c"]["findings"] == []
    assert got["a.c"]["meta"]["candidate_summary"]["ungrouped"] == 1 == sum(x["function_id"] is None for x in got["a.c"]["candidates"])


def test_parts_are_the_document(spark, run, monkeypatch):  # noqa: F811
    tables, options = run
    whole = {r["repo"]: r["document"] for r in S.result_documents(tables, by_folder, options, timestamp="-").collect()}
    for size, tasks in ((1, "23"), (700, "5"), (1 << 20, "4")):
        monkeypatch.setattr(D, "PART", size)
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            rows = S.document_parts(tables, by_folder, options, timestamp="-").collect()
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert {repo: "".join(r["text"] for r in sorted(rows, key=lambda r: (r["section"], r["key"])) if r["repo"] == repo) for repo in whole} == whole
        assert size != 1 or len(rows) > 100


def test_no_part_grows_with_its_document(spark):
    """Sections without rows, and one of many rows, over a few tasks."""
    n = 30_000
    fixed = spark.createDataFrame([("r", 0, "", "", "{"), ("r", 1, "", "", '"a":['), ("r", 2, "", "000000", '],"b":['), ("r", 3, "", "", "]}"), (None, 0, "", "", "{}")], "document string, section int, key string, bound string, text string")
    key = F.lpad(F.col("id").cast("string"), 6, "0")
    rows = D.pack(fixed.unionByName(spark.range(n).select(F.lit("r").alias("document"), F.lit(2).alias("section"), key.alias("key"), key.alias("bound"), F.concat(F.lit('"'), F.repeat(F.lit("x"), 200), key, F.lit('"')).alias("text"))))
    got = rows.collect()
    text = "".join(r["text"] for r in sorted(got, key=lambda r: (r["section"], r["key"])) if r["document"] == "r")
    assert json.loads(text) == {"a": [], "b": ["x" * 200 + f"{i:06}" for i in range(n)]} and max(len(r["text"]) for r in got) < D.PART + 300 and len(got) > 5
    assert [r["text"] for r in got if r["document"] is None] == ["{}"]


def test_a_scan_leaves_no_shuffle_files(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = shuffles()
    tables = S.scan_files(files, M.default_rules(spark))
    assert not shuffles() - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    # A table of the run may be read again.
    assert tables.metrics.collect() == tables.metrics.collect() and tables.conflicts.count() == tables.conflicts.count()

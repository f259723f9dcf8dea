"""The engine's own operators: every query against its SQL on the smallest tables, and unit cases."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from epochlens.operators import cparse
from epochlens.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    cols = sorted(frame.columns)
    return sorted(tuple(text(v) for v in r) for r in frame[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ([tuple("null" if x == "nan" else x for x in r) for r in rows(f.astype(object))] for f in (got, want))
    norm = lambda r: [tuple(str(float(x)) if x.replace(".", "", 1).replace("-", "", 1).isdigit() else x for x in t) for t in r]
    assert sorted(norm(a)) == sorted(norm(b))


def test_block_comments_carry_over_lines(spark):
    from epochlens.sources.lines import with_clean_text

    text = ["int a; /* open time(NULL)", "still time(NULL)", "end */ time(NULL); // x", 's = "/* no comment";', "time(0); /* a */ b", "'\"' + c /* x", "", "y */"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text, 1)], "path string, line int, text string")
    got = [r["clean"].strip() for r in with_clean_text(lines).orderBy("line").collect()]
    assert got == ["int a;", "", "time(NULL);", "s =  ;", "time(0);   b", "+ c", "", ""]


def test_lines_of_any_ending(spark):
    from epochlens.sources.lines import split_lines

    files = spark.createDataFrame([("a", "x\r\ny\rz\n"), ("b", ""), ("c", None), ("d", "\n\nq")], "path string, content string")
    got = [(r["path"], r["line"], r["text"]) for r in split_lines(files).orderBy("path", "line").collect()]
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("d", 1, ""), ("d", 2, ""), ("d", 3, "q")]


def test_mask_keeps_offsets():
    source = 'a "str\\"x" /* c\nd */ b // e\n\'f\''
    masked = cparse.mask(source)
    assert len(masked) == len(source) and masked.count("\n") == source.count("\n")
    assert masked.split() == ["a", "b"]


def test_tree_scan(spark, tmp_path):
    from epochlens.sources.files import scan_tree

    for name, text in {"a/x.c": "int a;", "a/tests/y.c": "int b;", "a/z.txt": "no", "a/b/big.h": "x" * 50}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    kept, large = scan_tree(spark, f"file://{tmp_path}/a", max_bytes=20)
    assert [(r["path"], r["content"]) for r in kept.collect()] == [("x.c", "int a;")]
    assert [(r["path"], r["size_bytes"]) for r in large.collect()] == [("b/big.h", 50)]


def test_rule_catalogs(spark, tmp_path):
    from epochlens.sources.files import read_rules

    (tmp_path / "a.json").write_text('[{"symbol": "time", "category": "function"}, {"Name": "time_t", "RISK": "LOW", "category": "simple type", "scope_files": ["a.c"], "needs_paren": null}]')
    (tmp_path / "b.json").write_text('{"rules": [{"symbol": "mktime", "category": "function", "rule_id": " "}]}')
    (tmp_path / "c.json").write_text('{"no": 1}')
    with pytest.raises(Exception, match="a catalog is"):
        read_rules(spark, f"file://{tmp_path}/c.json").collect()
    got = {r["symbol"]: (r["risk"], r["call_required"], r["rule_id"]) for f in "ab" for r in read_rules(spark, f"file://{tmp_path}/{f}.json").collect()}
    assert got == {"time": ("high", True, None), "time_t": ("low", False, None), "mktime": ("high", True, None)}


def test_repo_list(spark, tmp_path):
    from epochlens.sources.files import read_repos

    (tmp_path / "r.jsonl").write_text('{"repo_url": "https://github.com/a/b.git", "ref": "main"}\n\n{bad\n{"ref": "x"}\n{"repo_url": "https://u:p@h/a/b"}\n')
    good, warned = read_repos(spark, f"file://{tmp_path}/r.jsonl")
    assert [(r["source_line"], r["repo_url"], r["enabled"]) for r in good.collect()] == [(1, "https://github.com/a/b.git", True)]
    assert [(r["source_line"], r["warning"]) for r in warned.orderBy("source_line").collect()] == [(3, "malformed JSON"), (4, "missing repo_url"), (5, "credentials in repo_url")]


def test_strict_dedupe_raises(spark):
    from epochlens.operators.candidates import as_candidates, dedupe_strict

    rows = lambda d: as_candidates(spark.createDataFrame([("f", 1, "x", "s", "high", d, "migration")], "path string, line int, text string, symbol string, risk string, description string, discovery_method string"))
    assert dedupe_strict(rows("a").unionByName(rows("a")).unionByName(rows(""))).first()["description"] == "a"
    with pytest.raises(ValueError):
        dedupe_strict(rows("a").unionByName(rows("b")))


def test_reports_render(spark):
    from epochlens.operators import reports as R

    raw = spark.createDataFrame([("1", "a.c", "<s>", None, "yes", "0.95", None, [3, 4]), ("2", "b.c", "t", "r-1", "no", "2", "Low", [])], "finding_id string, file string, symbol string, rule_id string, verdict string, confidence string, severity string, lines array<int>")
    found = R.normalize_findings(raw)
    assert "a.c:3" in R.render_text(found) and "no: 1, yes: 1" in R.render_text(found)
    page = R.render_html(found, "T & x")
    assert "T &amp; x" in page and "R_1" in page and page.count("<script>") == 1


def test_streaming_scan(spark, tmp_path):
    from epochlens.operators.matching import default_rules
    from epochlens.streaming.watch import watch_files

    src = f"{tmp_path}/in"
    spark.createDataFrame([("f.c", "time_t t = time(NULL);\n")], "path string, content string").write.parquet(src)
    query = watch_files(spark, src, default_rules(spark), f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["symbol"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"time", "time_t"}


def test_scan_is_written(spark, tmp_path):
    from epochlens.operators.matching import default_rules
    from epochlens.plans.scan import scan, write_scan
    from epochlens.sources.lines import synthetic_lines

    write_scan(scan(synthetic_lines(spark, SF), default_rules(spark)), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s/candidates").count() > 100


def test_redaction(spark):
    from pyspark.sql import functions as F

    from epochlens.operators.prompts import redact

    text = "see (/src/a/b.c:3) now\n" + "x" * 300
    got = spark.createDataFrame([(text,)], "t string").select(redact(F.col("t")).alias("r")).first()["r"].split("\n")
    assert got[0].startswith("see (<HASH:") and got[0].endswith(">:3) now") and "b.c" not in got[0] and got[1] == "x" * 100 + "... [TRUNCATED]"


def test_retries(spark):
    import pandas as pd

    from epochlens.operators.prompts import classify, with_retries

    calls = []

    def flaky(batch):
        calls.append(len(batch))
        if len(calls) < 3:
            raise TimeoutError
        return batch.assign(summary="yes", confidence=0.5, reason="r")

    frame = pd.DataFrame({"function_id": ["a", "b"]})
    assert list(with_retries(flaky, 3, 0.0)(frame).summary) == ["yes", "yes"] and len(calls) == 3
    assert list(with_retries(lambda b: 1 / 0, 3, 0.0)(frame).reason) == ["error: ZeroDivisionError"] * 2
    rows = spark.range(40).selectExpr("cast(id as string) function_id")
    assert classify(rows, lambda b: b.assign(summary="no", confidence=1.0, reason=str(len(b)))).filter("reason > '15'").count() == 0


def test_build_files_are_picked(spark):
    from epochlens.operators.prompts import pick_build_files

    names = ["a/b/Makefile", "Makefile", "x/CMakeLists.txt", "y.mk", "z/z.mk", "q.c", "e.cmake"]
    files = spark.createDataFrame([(n, "" if n == "e.cmake" else "x") for n in names], "path string, content string")
    assert [(r["kind"], r["path"]) for r in pick_build_files(files).orderBy("kind", "rank").collect()] == [("cmake", "x/CMakeLists.txt"), ("make", "Makefile"), ("make", "y.mk"), ("make", "z/z.mk")]

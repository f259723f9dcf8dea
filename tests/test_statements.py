"""Statements over several lines, table functions in SQL, and repositories that run apart."""

import time

import pytest
from pyspark.sql import functions as F

from epochlens.functions.tables import register_table_functions
from epochlens.operators import batches as T
from epochlens.operators import cparse as P
from epochlens.operators import matching as M
from epochlens.operators.statements import place_of, statements
from epochlens.plans.scan import Options, scan_files
from epochlens.sources.lines import split_lines

SOURCE = '''#define LONG_ONE \\
    time_t
#include "a.h"

int f(time_t a,   // a ; note
      int b)
{
    printf("%d ; /* kept */"
           " (%s)",
           a);
    /* begins ;
       goes on */ x = y +
        z; w();
    for (i = 0;
         i < n; i++)
    {
        g(a
    }
    switch (b) {
    case 1:
        q = b ? 1 :
            2;
    again:
        "text \\
         more";
    }
    h(
#undef X
    1);
}
last'''


def texts(spark, source, path="f.c"):
    rows = statements(split_lines(spark.createDataFrame([(path, source)], "path string, content string"))).orderBy("line").collect()
    return [(r["line"], r["last_line"], r["text"]) for r in rows]


def test_statements(spark):
    """Among them a literal that a backslash breaks, which takes the next line with it, as the docstring says."""
    assert texts(spark, SOURCE) == [
        (1, 2, "#define LONG_ONE time_t"), (3, 3, '#include "a.h"'), (5, 7, "int f(time_t a, int b) {"), (8, 10, 'printf("%d ; /* kept */" " (%s)", a);'), (12, 13, "x = y + z; w();"),
        (14, 16, "for (i = 0; i < n; i++) {"), (17, 18, "g(a }"), (19, 19, "switch (b) {"), (20, 20, "case 1:"), (21, 22, "q = b ? 1 : 2;"), (23, 23, "again:"), (24, 26, '"text more"; }'),
        (27, 27, "h("), (28, 28, "#undef X"), (29, 29, "1);"), (30, 30, "}"), (31, 31, "last"),
    ]


@pytest.mark.parametrize("source", ["", "\n\n", "/* only\n a comment", "\\\n\\\n"])
def test_no_statement(spark, source):
    assert texts(spark, source) == []


def test_places_and_files(spark):
    lines = spark.createDataFrame([("a", 1, "x = ("), ("b", 1, "y;"), ("a", 2, "  1);"), ("a", 3, None), ("b", 2, "z")], "path string, line int, text string")
    whole = statements(lines)
    assert sorted((r["path"], r["text"]) for r in whole.collect()) == [("a", "x = ( 1);"), ("b", "y;"), ("b", "z")]
    at = whole.filter("path = 'a'").select(*[place_of(F.col("parts"), F.lit(i)).alias(f"c{i}") for i in (0, 4, 6, 8, 99)]).first()
    assert tuple(at) == (1, 1, 2, 2, None)


def test_scan_of_statements(spark):
    """A cast whose call stands on the next line is found with the option, and only then; what stands on one line is found both ways."""
    source = "void f(void) {\n  int32_t a = (int32_t)\n      time(NULL);\n  int32_t b = (int32_t) time(NULL);\n}\n"
    files = spark.createDataFrame([("f.c", source)], "path string, content string")
    for whole in (False, True):
        run = scan_files(files, M.default_rules(spark), Options(statements=whole))
        assert sorted(r["line"] for r in run.candidates.filter("symbol = 'cast_from_time'").collect()) == ([2, 4] if whole else [4])


def test_table_functions(spark):
    register_table_functions(spark)
    source = "typedef time_t stamp;\nint f(void) {\n  return 1;\n}\nstatic int g(int a) {\n}\n"
    files = spark.createDataFrame([("a.c", source), ("b.c", None), ("c.c", "")], "path string, content string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    sql = lambda name: rows(spark.sql(f"SELECT path, s.* FROM {{f}} AS f, LATERAL {name}(f.content) AS s", f=files))
    assert sql("spans") == rows(P.scan_functions(files)) == [("a.c", "f", 2, 4), ("a.c", "g", 5, 6)]
    assert sql("typedefs") == rows(P.scan_typedefs(files)) != []
    assert sql("bodies") == rows(P.scan_bodies(files)) != []
    lines = split_lines(files).withColumn("line", F.col("line") + 100).withColumn("name", F.lit("clash"))
    assert rows(spark.sql("SELECT * FROM line_spans(TABLE({l}))", l=lines)) == [("a.c", "f", 102, 104), ("a.c", "g", 105, 106)]
    with pytest.raises(Exception, match="string"):
        spark.sql("SELECT * FROM spans(1)").collect()
    with pytest.raises(Exception, match="path, line and text"):
        spark.sql("SELECT * FROM line_spans(TABLE({l}))", l=lines.drop("text")).collect()


def test_repositories_apart(spark, monkeypatch):
    """One slow repository is told, one fails twice, one at its first try only; the others have results."""
    slow = F.udf(lambda i: time.sleep(60) or i, "long")
    published, tries = [], []

    def slow_work(over):
        spark.range(1).select(slow("id")).collect()
        published.append("slow")

    def flaky(over):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("once")
        published.append("flaky")

    work = {"good": lambda over: published.append(("good", spark.range(5).count(), over())), "slow": slow_work, "bad": lambda over: 1 / 0, "flaky": flaky}
    began = time.time()
    found = {r["repo_key"]: r for r in T.run_apart(spark, work, 8, at_once=2).collect()}
    assert {k: (r["status"], r["attempts"]) for k, r in found.items()} == {"good": ("ok", 1), "slow": ("timeout", 1), "bad": ("failed", 2), "flaky": ("ok", 2)}
    assert found["bad"]["error"].startswith("ZeroDivisionError") and sorted(map(str, published)) == ["('good', 5, False)", "flaky"] and time.time() - began < 50

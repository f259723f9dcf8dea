"""A small catalog is an expression over a line: the same rows as by a join, and lines are read once for their candidates."""

from epochlens.operators import detectors as D
from epochlens.operators import matching as M
from epochlens.plans.scan import scan
from epochlens.sources.files import normalize_rules
from epochlens.sources.lines import synthetic_lines, with_clean_text

SF = "/root/testdata/sf0.001"
TEXTS = ["time_t t = time(NULL);", "struct 12 timeval tv;", "struct (timeval)", "timeval struct", "étime(1)", "timeé", "1time(2)", "mytime(3) time (4)", "", None, "#define time 1", "/* time( */ time", 'puts("time(")', "time time(", "struct\ttimeval x; struct timeval y;", "_time(x) time_(y)", "x.time(0)"]
RULES = [
    ("time", "function", None, False), ("time", "function", None, False), ("time", "simple type", None, True), ("time", "macro", None, None), ("time_t", "simple type", False, False), ("struct timeval", "structure", None, False), ("struct timeval x", "structure", None, False),
    ("struct  timeval", "structure", None, False), ("", "structure", None, False), ("#define", "macro", None, False), ("1time", "function", False, False), ("étime", "function", False, False), ("_time", "function", True, False), (" time", "structure", None, False), ("x", "function", True, True),
]


def found(frame):
    return sorted(map(str, frame.collect()))


def test_small_catalogs_match_as_large_ones(spark, monkeypatch):
    lines = with_clean_text(spark.createDataFrame([("a.c", i, t) for i, t in enumerate(TEXTS, 1)], "path string, line int, text string"))
    rows = [(s, "high", c, f"d{i}", None if i % 2 else f"R{i}", p, u, None, False) for i, (s, c, p, u) in enumerate(RULES)]
    rules = normalize_rules(spark.createDataFrame(rows, "symbol string, risk string, category string, description string, rule_id string, needs_paren boolean, type_use_only boolean, scope_files array<string>, discovered boolean"))
    assert M.few_rules(rules) is not None
    few = found(M.match_rules(lines, rules))
    one_pass = [found(f) for f in (lambda s: (s.candidates, s.conflicts))(scan(lines.drop("clean"), rules))]
    monkeypatch.setattr(M, "FEW_RULES", 0)
    assert M.few_rules(rules) is None
    assert few == found(M.match_rules(lines, rules)) and len(few) > 8
    assert one_pass == [found(f) for f in (lambda s: (s.candidates, s.conflicts))(scan(lines.drop("clean"), rules))]


def test_lines_are_read_once_for_candidates_and_once_for_context(spark):
    rules = M.default_rules(spark)
    plan = scan(synthetic_lines(spark, SF), rules).candidates._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_context_is_the_same_without_aliases_as_with_none_seen(spark):
    texts = ["time_t a, b = 1;", "TIME_T c;", "int x = time(0);", "int y = (int) Time(0);", "x = 1", None, "clock_t d[2]; timer_t e();"]
    lines = spark.createDataFrame([("a.c", i, t) for i, t in enumerate(texts, 1)] + [("b.c", 1, "int q;")], "path string, line int, text string")
    none = spark.createDataFrame([], "tu string, alias string")
    own = found(D.file_context(lines))
    assert own == found(D.file_context(lines, none)) and len(own) == 1

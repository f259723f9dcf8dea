"""The line detectors on fixtures of our own, with rows set by hand."""

import re

import pytest
from pyspark.sql import functions as F

from epochlens.operators import boundaries as B
from epochlens.operators import detectors as D
from epochlens.sources.lines import split_lines, with_clean_text


def lines_of(spark, *texts):
    return spark.createDataFrame([("f.c", i, t) for i, t in enumerate(texts, 1)], "path string, line int, text string")


def aliases_of(spark, *names):
    return spark.createDataFrame([("f.c", n, 1) for n in names], "tu string, alias string, hop int")


DEFINES = [
    ("#define OWN_TIME time_t", "time_type_alias"), ("#define TICKS_T clock_t", "time_type_alias"), ("#define NOW() x", None), ("#define NOW time(NULL)", "time_function_alias"), ("#define GET gettimeofday", "time_function_alias"),
    ("#define NAP usleep(5)", "time_function_alias"), ("#define RES timespec_getres", "time_function_alias"), ("#define SPEC struct timespec", "time_struct_alias"), ("#define ITV struct  itimerval", "time_struct_alias"), ("#define SECS_PER_DAY 86400", "time_constant"),
    ("#define WAIT_FOR 3600", "time_constant"), ("#define A_NUMBER 3600", None), ("#define PLAIN_TIME time", None), ("#define TIME_REG 0x60", None), ("#define DELAY 60 /* status of the bus */", None), ("#define HOUR_RATE 3600", "time_constant"), ("#define freq 60", None), ("#define EMPTY_TIME ", None),
    ("#define MINUTE 61", None), ("  #define LATER time_t", "time_type_alias"),
]


def test_defines(spark):
    rows = lines_of(spark, *(t for t, _ in DEFINES))
    got = {r["line"]: r["kind"] for r in D.scan_defines(rows).collect()}
    assert got == {i: k for i, (_, k) in enumerate(DEFINES, 1) if k}
    rules = {r["symbol"]: (r["risk"], r["description"]) for r in D.follow_up_rules(D.scan_defines(rows)).collect()}
    assert rules["OWN_TIME"] == ("high", "Discovered time_type_alias macro: OWN_TIME -> time_t") and rules["GET"][0] == "medium" and "WAIT_FOR" not in rules


ARITHMETIC = """time_t now = time(NULL), later;
clock_t ticks;
stamp_t mark;
int n; long big;
now + 60;
now + 3000000000;
now - 2147483640;
now * 100;
later = later / 7;
ticks += delta;
mark - other->field;
n + 2147483647;
now - -5;
now + (x);
now+1048575; now + 1048576;
puts("now + 3000000000"); // now + 3000000000
now - 3600
useconds_t u) u * 2;
now + 17;
""".splitlines()


def test_arithmetic(spark):
    got = sorted((r["line"], r["var"], r["operator"], r["operand"], r["risk"]) for r in D.scan_arithmetic(lines_of(spark, *ARITHMETIC), aliases_of(spark, "stamp_t")).collect())
    want = [
        (6, "now", "+", "3000000000", "high"), (7, "now", "-", "2147483640", "medium"), (8, "now", "*", "100", "medium"), (10, "ticks", "+", "delta", "medium"), (11, "mark", "-", "other->field", "medium"),
        (13, "now", "-", "-5", "medium"), (14, "now", "+", "", "medium"), (15, "now", "+", "1048576", "high"), (18, "u", "*", "2", "medium"), (19, "now", "+", "17", "high"),
    ]
    assert got == sorted(want)
    compound = {r["line"]: r["is_compound"] for r in D.scan_arithmetic(lines_of(spark, *ARITHMETIC)).collect()}
    assert compound[10] and not compound[8] and 11 not in compound


CASTS = """int a = (int) time(NULL);
int b = (time_t) time(NULL);
x = (unsigned int)timestamp;
y = (unsigned int) counter;
f((long)epoch_now, 3);
time_t t; z = (short) t;
int32_t w = tick_count;
time_t v = tick_count;
int q = time(NULL);
(void) time(NULL);
s = "(int) time(NULL)"; // (int) time(NULL)
stamp_t m; k = (char) m;
time_t p; int r = p;
int u = get_time (x);
""".splitlines()


def test_casts(spark):
    rows = with_clean_text(lines_of(spark, *CASTS))
    got = {r["line"]: (r["symbol"], r["risk"], r["to_type"], r["source"]) for r in D.scan_casts(rows, aliases_of(spark, "stamp_t")).collect()}
    assert got == {
        1: ("cast_from_time", "high", "int", "time"), 3: ("cast_from_time_var", "high", "unsigned int", "timestamp"), 5: ("cast_from_time_var", "high", "long", "epoch_now"), 6: ("cast_from_time_var", "high", "short", "t"),
        7: ("implicit_cast_from_time", "medium", "int32_t", "tick_count"), 12: ("cast_from_time_var", "high", "char", "m"), 13: ("implicit_cast_from_time", "high", "int", "p"),
    }
    assert 12 not in {r["line"] for r in D.scan_casts(rows).collect()}


IO = """time_t now = time(NULL);
int64_t ts = (int64_t) time(0);
printf("%d", now);
printf("%ld %lu", now);
printf("at %s %lld", name, ts);
fprintf(out, "%i", plain);
snprintf(buf, n, fmt, now);
write(fd, (char *) buf, &now, sizeof(time_t));
read(fd, &ts, 8); time_t x;
memcpy((void *) dst, &now, sizeof now);
fwrite(&other, sizeof(time_t), 1, f); (void) time_t x;
// printf("%d", now);
PRINTF("%x", ts);
read(fd, (p) when, &when, sizeof(when_t)); when_t when;
""".splitlines()


def test_io_boundaries(spark):
    lines = lines_of(spark, *IO)
    known = D.with_context(lines, D.file_context(lines, aliases_of(spark, "when_t", "when")))
    got = sorted((r["line"], r["io_function"], r["score"]) for r in B.scan_io(known, threshold=0.0).collect())
    assert got == [(3, "printf", 6.0), (4, "printf", 6.0), (7, "snprintf", 2.0), (8, "write", 6.0), (9, "read", 5.0), (13, "printf", 6.0), (14, "read", 8.0)]
    assert sorted(r["line"] for r in B.scan_io(known).collect()) == [3, 4, 8, 13, 14]
    why = {r["line"]: r["reasoning"] for r in B.scan_io(known, threshold=0.0).collect()}
    assert why[4] == "Format specifier mismatch: Sign mismatch (unsigned specifier vs signed time_t)" and why[9] == "Direct time_t or alias variable; Size argument is 8 bytes (matches time_t width)"
    narrow = B.Abi("ILP32", 32, True)
    assert sorted(r["line"] for r in B.scan_io(known, narrow).collect()) == [4, 5, 8, 13, 14]


def test_io_head_of_a_file(spark):
    files = spark.createDataFrame([("a.c", "x\n" * 5000 + "printf(1);"), ("b.c", "x\n" * 50 + "printf(1);"), ("c.c", "y" * 8190 + "\nread(1);")], "path string, content string")
    assert [r["path"] for r in B.io_files(split_lines(files)).collect()] == ["b.c"]


def test_migration(spark):
    texts = ["x = (int)now_t; time_t a;", "sizeof(long); time(0);", "read(fd, &t, 4); time_t t;", "if (t < 0) mktime(&x);", "time_t z = -1;", "(long) t; localtime(&t);", "(long long) time_t", "int plain = -1;"]
    rows = lines_of(spark, *texts).select("path", "line", F.lit("s").alias("symbol"), F.col("text").alias("snippet"))
    kinds = lambda a, b: sorted((r["line"], r["risk_type"], r["severity"]) for r in B.migration_risks(rows, a, b).collect())
    width, high, sign, arch = ("width_assumption", "blocker"), ("width_assumption", "high_risk"), ("signedness_assumption", "blocker"), ("architecture_assumption", "medium_risk")
    old, new = B.Abi("ILP32", 32, True), B.Abi("LP64", 64, False)
    assert kinds(old, new) == sorted([(1, *width), (2, *width), (2, *high), (2, *arch), (3, "io_size_mismatch", "blocker"), (4, *sign), (5, *sign), (6, *width), (6, *arch)])
    assert kinds(old, old) == [] and {k for _, k, _ in kinds(new, B.Abi("LP64", 64, True))} == set()
    places = spark.createDataFrame([("f.c", 1, "formatted_io_mismatch", "printf"), ("f.c", 2, "raw_representation_risk", "read")], "path string, line int, io_category string, io_function string")
    assert sorted((r["line"], r["risk_type"]) for r in B.io_migration_risks(places, old, new).collect()) == [(1, "io_format_mismatch"), (1, "signedness_assumption"), (2, "io_size_mismatch")]


def test_score_weights(spark):
    t, f = F.lit(True), F.lit(False)
    one = spark.range(1)
    value = lambda **flags: one.select(B.score({"direct_time_t": f} | flags)).first()[0]
    assert value() == -1.0 and value(explicit_cast=t) == -1.0 and value(direct_time_t=t) == 3.0 and value(direct_time_t=t, safe_serialization=t) == 1.0 and value(struct_time_field=t, external_boundary=t) == 8.0
    assert [one.select(B.confidence_band(F.lit(x))).first()[0] for x in (8.0, 5.0, 4.9)] == ["high_confidence", "medium_confidence", "low_confidence"]


def test_one_pass_equals_single_detectors(spark):
    """The combined pass gives what the detectors give one by one."""
    lines = lines_of(spark, *ARITHMETIC, *CASTS, *(t for t, _ in DEFINES))
    aliases = aliases_of(spark, "stamp_t")
    clean = with_clean_text(lines)
    every = sorted((r["line"], r["symbol"], r["discovery_method"]) for r in D.line_candidates(D.with_context(clean, D.file_context(lines, aliases))).collect())
    single = [(r["line"], r["macro"], "define_scanner") for r in D.scan_defines(lines).collect()]
    single += [(r["line"], f"arithmetic_{r['operator']}{'=' if r['is_compound'] else ''}", "arithmetic_scanner") for r in D.scan_arithmetic(lines, aliases).collect()]
    single += [(r["line"], r["symbol"], "time_t_cast") for r in D.scan_casts(clean, aliases).collect()]
    assert every == sorted(single)


@pytest.mark.parametrize("pattern", [D.DECLARED, D.OPERATION, D.CAST_OF_CALL, D.CAST_OF_NAME, D.ASSIGNMENT, D.TIME_ASSIGNMENT, D.LARGE_NUMBERS])
def test_patterns_mean_the_same_to_both_engines(spark, pattern):
    """Java's regular expressions find what Python's do."""
    texts = [*ARITHMETIC, *CASTS, *IO]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["m"] for r in rows.select("i", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("m")).collect()}
    assert got == {i: [m[0] for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}

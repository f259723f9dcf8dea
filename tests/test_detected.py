"""Environments in answers, functions found twice, and logs of ids."""

import json

import pytest

from epochlens.operators import artifacts as Z
from epochlens.operators import candidates as C
from epochlens.operators.detected import detected_environments

GOOD = {"hardware_model": "ILP32", "time_t_size_bits": 32, "time_t_signed": "signed", "time64_functions_available": None, "d_time_bits_supported": True, "d_time_bits_setting": "64", "c_library": "glibc"}

CASES = {
    "good": (GOOD, []),
    "full": ({**GOOD, "toolchain_flags": ["-m32", "-D_TIME_BITS=64", "--std=c11"], "os_or_rtos": "linux", "notes": "", "scenario_hint": "ILP32-32bit-signed-time64_no", "mitigation_path": "upgrade_env"}, []),
    "no flags": ({**GOOD, "toolchain_flags": [], "mitigation_path": None}, []),
    "flags as text": ({**GOOD, "toolchain_flags": "-m32"}, ["toolchain_flags must be a list", "wrong toolchain_flags"]),
    "a bad flag": ({**GOOD, "toolchain_flags": ["-m32", "m32"]}, ["wrong toolchain_flags"]),
    "number as text": ({**GOOD, "time_t_size_bits": "32"}, ["wrong time_t_size_bits"]),
    "capability as text": ({**GOOD, "d_time_bits_supported": "false"}, ["d_time_bits_setting must be not_available where d_time_bits_supported is false", "wrong d_time_bits_supported"]),
    "missing": ({k: v for k, v in GOOD.items() if k not in ("c_library", "time64_functions_available")}, ["missing c_library", "missing time64_functions_available"]),
    "null model": ({**GOOD, "hardware_model": None}, ["wrong hardware_model"]),
    "unsupported and set": ({**GOOD, "d_time_bits_supported": False}, ["d_time_bits_setting must be not_available where d_time_bits_supported is false"]),
    "unsupported": ({**GOOD, "d_time_bits_supported": False, "d_time_bits_setting": "not_available"}, []),
    "unknown and away": ({**GOOD, "d_time_bits_supported": None, "d_time_bits_setting": "not_available"}, ["d_time_bits_setting cannot be not_available where d_time_bits_supported is unknown"]),
    "other": ({**GOOD, "c_library": "other"}, ["c_library_other_text must say which library"]),
    "other named": ({**GOOD, "c_library": "other", "c_library_other_text": "uclibc"}, []),
    "risky": ({**GOOD, "scenario_hint": "ILP32-32bit-signed-time64_no", "mitigation_path": None}, ["mitigation_path must be given for a risky scenario"]),
    "odd hint": ({**GOOD, "scenario_hint": "ILP64"}, ["wrong scenario_hint"]),
    "null system": ({**GOOD, "os_or_rtos": None}, ["wrong os_or_rtos"]),
    "list": ([GOOD], ["not a JSON object"]),
}


def test_answers(spark):
    rows = [(k, json.dumps(v)) for k, (v, _) in CASES.items()] + [("broken", "{"), ("null", None), ("number", "3")]
    got = {r["k"]: r for r in detected_environments(spark.createDataFrame(rows, "k string, text string")).collect()}
    want = {k: e for k, (_, e) in CASES.items()} | dict.fromkeys(("broken", "null", "number"), ["not a JSON object"])
    assert {k: sorted(r["errors"]) for k, r in got.items()} == {k: sorted(e) for k, e in want.items()}
    assert got["number as text"]["time_t_size_bits"] == 32 and got["flags as text"]["toolchain_flags"] == [] and got["good"]["toolchain_flags"] is None
    assert got["capability as text"]["d_time_bits_supported"] is False and got["full"]["toolchain_flags"][1] == "-D_TIME_BITS=64" and got["list"]["hardware_model"] is None
    assert detected_environments(spark.createDataFrame([], "text string")).count() == 0


def test_functions_found_twice(spark):
    rows = [("f", "b.c", 1, 5, [3, 1]), ("f", "a.c", 7, 9, [8, 3]), ("f", "a.c", 7, 9, []), ("g", "a.c", 1, 2, None), ("h", "c.c", 1, 2, [2, 2])]
    kept, moved = C.dedupe_functions(spark.createDataFrame(rows, "function_id string, path string, start_line int, end_line int, candidate_lines array<int>"))
    assert sorted(map(tuple, kept.collect())) == [("f", "a.c", 7, 9, [1, 3, 8]), ("g", "a.c", 1, 2, []), ("h", "c.c", 1, 2, [2])]
    assert [tuple(r) for r in moved.collect()] == [("b.c", 1, 5, "f", "a.c")]


def test_id_mappings(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), (None, "y"), ("c", None)], "id_from string, id_to string")
    found = Z.id_mappings(rows, "2a", "2b")
    Z.append_json(found, str(tmp_path / "ids"), ["pass_from", "pass_to"])
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "ids")).select("pass_from", "pass_to", "id_from", "id_to").collect()) == [("2a", "2b", "a", "x"), ("2a", "2b", "b", "x")]
    with pytest.raises(Exception, match="mapped to two others: a"):
        Z.id_mappings(rows.union(spark.createDataFrame([("a", "z")], rows.schema)), "2a", "2b").collect()

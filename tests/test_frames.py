"""Frames and blocks around lines: only lines are dealt, and by path alone, never the texts made of them."""

import re
from pathlib import Path

import pytest

from epochlens import queries as Q
from epochlens.operators import candidates as C

DATA = Path("/root/testdata/sf0.001")


def dealt_by(frame) -> set[str]:
    """What the exchanges of a plan deal by."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return {re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)}


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["line_frame", "block_contexts"])
def test_frames_and_blocks_are_not_dealt(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert dealt_by(Q.QUERIES[name](spark, str(DATA))) == {"path"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_frames_of_odd_targets(spark):
    lines = spark.createDataFrame([("a.c", 1, "x"), ("a.c", 2, None), ("a.c", 9, "z"), ("b.c", 1, "y")], "path string, line int, text string")
    targets = spark.createDataFrame([("a.c", 1), ("a.c", 1), ("a.c", 3), ("a.c", 9), ("c.c", 1), ("b.c", 1)], "path string, line int")
    got = sorted(map(tuple, C.line_frames(lines, targets, 2).collect()))
    assert got == [("a.c", 1, ">>> 1: x"), ("a.c", 9, ">>> 9: z"), ("b.c", 1, ">>> 1: y")]


def test_blocks_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 4)
    texts = ["int f(void) {", *(f"x{i};  " for i in range(2, 20)), "}", "after;", "int g(void) {", "open"]
    lines = spark.createDataFrame([("f.c", i, t) for i, t in enumerate(texts, 1)], "path string, line int, text string")
    got = {r["target"]: r["context"] for r in C.block_contexts(lines, lines.select("path", "line"), 6).collect()}
    assert set(got) == set(range(1, 21)) and all(x.count("\n") == 6 and x.endswith("[function truncated at 6 lines]") for x in got.values())
    assert [t for t, x in got.items() if ">>>" in x] == [t for t in got if t <= 6] and ">>>    3: x3;\n" in got[3] and ">>>    1: int f(void) {\n" in got[1]

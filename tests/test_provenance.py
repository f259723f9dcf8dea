"""Provenances against a plain version over all rows of an identity."""

import itertools
import random

from epochlens.operators.candidates import METHODS
from epochlens.operators.provenance import FIELDS, merge_provenance

SCHEMA = "path string, line int, col_start int, col_end int, symbol string, risk string, discovery_method string, rule_id string, description string"


def plain(rows):
    out = {}
    clean = lambda v: None if v is None or not v.strip() else v.strip()
    groups = {}
    for r in rows:
        groups.setdefault(r[:6], []).append(tuple(clean(v) for v in r[6:]))
    for key, found in groups.items():
        values = [sorted({p[i] for p in found} - {None}) for i in range(3)]
        bad = [f for f, v in zip(FIELDS, values, strict=True) if len(v) > 1]
        rank = lambda p: (-sum(v is not None for v in p), METHODS.index(p[0]) if p[0] in METHODS else len(METHODS), *[v or "" for v in p])
        best = min(found, key=rank)
        kept = best if bad else tuple(v[0] if v else None for v in values)
        out[key] = (*kept, len(found), found.count(best), bool(bad), bad)
    return out


def test_merge(spark):
    r = random.Random(5)
    rows = [
        ("f.c" if i % 3 else None, r.randrange(12), None, r.choice([None, 1]), r.choice("ab"), "high", r.choice([*METHODS[:3], None, "", "other"]), r.choice(["RULE-1", "RULE-2", None, " "]), r.choice(["x", "y", None, ""]))
        for i in range(600)
    ]
    got = {tuple(x)[:6]: (*[x[c] for c in FIELDS], x["n_rows"], x["n_won"], x["conflict"], x["contradicted"]) for x in merge_provenance(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain(rows)
    assert got == want and any(v[5] for v in want.values()) and any(not v[5] for v in want.values())


def test_no_mixed_row(spark):
    """Any order of the rows gives one result, and in a conflict it is one of the rows; an empty table gives none."""
    key = ("f.c", 1, None, None, "t", "low")
    rows = [(*key, "io_boundary", None, "a"), (*key, "time_t_cast", "RULE-9", "z"), (*key, None, "RULE-1", None)]
    found = {tuple(merge_provenance(spark.createDataFrame(list(p), SCHEMA)).select(*FIELDS, "n_rows", "n_won", "conflict").first()) for p in itertools.permutations(rows)}
    assert found == {("time_t_cast", "RULE-9", "z", 3, 1, True)}
    assert merge_provenance(spark.createDataFrame([], SCHEMA)).isEmpty()

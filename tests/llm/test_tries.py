"""Conversation tries against a plain version that lists all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from epochlens.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_nodes(convs):
    """``convs``: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, tokens = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        tokens[p] = sum(tokens[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], tokens[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], x[3])):
        convs[c].append((role, text))
    return convs


def plain_rebuilt(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + convs[c][h:]
    return out


def some_rows(seed, n=150):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(2 * n), n):
        depth = r.choice([0, 1, 2, 3, 5, 8, 12])
        for t in range(depth):
            # Few choices near the top, so that prefixes are shared.
            rows.append((c, t, r.choice(["user", "assistant"]) if t > 2 else "user", f"té{r.randrange(1 + t // 2)}" if r.random() < 0.9 else None))
    return rows


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("seed", "limit"), [(1, 8192), (2, 40), (3, 8)])
def test_trie(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(tries, "LIMIT", limit)
    rows = some_rows(seed)
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 seq", "2 n", "'q' grp", "'k' digest")
    assert got(tries.conversation_trie(turns)) == plain_nodes(in_order(rows))


def test_rebuilt(spark):
    rows = some_rows(5)
    turns, ids = tries.rebuilt_turns(spark.createDataFrame(rows, SCHEMA))
    assert got(tries.conversation_trie(turns, ids)) == plain_nodes(plain_rebuilt(in_order(rows)))


def test_copies_and_long_conversations(spark, monkeypatch):
    """A conversation that thousands repeat, over several pieces of ids, and one long one beside it."""
    monkeypatch.setattr(tries, "LIMIT", 100)
    rows = [(c, t, "user", f"x{t}") for c in range(0, 6000, 2) for t in range(2)]
    rows += [(9001, t, "user", f"y{t}") for t in range(500)] + [(9002, t, "user", f"x{t}") for t in range(300)] + [(9003, None, None, None), (9004, 1, "", "")]
    assert got(tries.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain_nodes(in_order(rows))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.conversation_trie(empty).count() == 0
    assert tries.conversation_trie(*tries.rebuilt_turns(empty)).count() == 0
    ids = spark.createDataFrame([(4,), (None,), (7,)], "conv_id long")
    assert got(tries.conversation_trie(empty, ids)) == plain_nodes({4: [], 7: []})
    rows = [(None, 1, "user", "lost"), (1, None, "user", "b"), (1, None, "user", "a"), (1, 0, "user", "c"), (2, 3, "user", "a"), (2, 3, "user", "a"), (-3, 1, None, "a"), (-3, 1, "", "a")]
    assert got(tries.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain_nodes(in_order(rows))

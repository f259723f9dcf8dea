"""Periodic runs against a plain version that tries every period."""

import hashlib
import random
import re
import time
import zlib

import pytest

from epochlens.llm.runs import MIN_LENGTH, collapse, find_runs, periodic_runs, run_digests, with_planted_runs


def plain_runs(w, least):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least, 2 * q):
                seg = w[s : s + length]
                if all(seg[: length - p] != seg[p:] for p in range(1, q)):
                    out.append((s, length, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def some_words(r):
    k, n = r.choice([1, 2, 2, 3, 4, 30]), r.randrange(60)
    w = [b"%d" % r.randrange(k) for _ in range(n)]
    if r.random() < 0.6 and n > 4:
        a = r.randrange(n)
        p = r.randrange(1, n - a + 1)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least", [2, 12])
def test_runs(least):
    r = random.Random(least)
    for _ in range(2500):
        w = some_words(r)
        assert find_runs(w, least) == plain_runs(w, least)


def test_runs_take_linear_time():
    a, b = b"a", b"ab"
    while len(b) < 300_000:
        a, b = b, b + a
    fibonacci = [b[i : i + 1] for i in range(300_000)]
    r = random.Random(3)
    unit = [b"%d" % r.randrange(5) for _ in range(1000)]
    for words in (fibonacci, [b"x"] * 300_000, unit * 300, ([b"x"] * 1000 + [b"y"]) * 300, [b"%d" % r.randrange(2) for _ in range(300_000)]):
        began = time.process_time()
        runs = find_runs(words)
        assert runs and time.process_time() - began < 20


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, MIN_LENGTH)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), *sha)


def test_run_digests(spark):
    r = random.Random(8)
    texts = ["  \n".join(x.decode() for x in some_words(r)) for _ in range(300)]
    texts += ["\t".join(x.decode() for x in some_words(r)) for _ in range(300)] + [None, "", " \n", "é é " * 9, "a b c " * 4000, "x y " * 12, "A a " * 20]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 runs", "2 start", "'q' collapsed", "'k' words")
    found = run_digests(periodic_runs(docs.withColumn("text", with_planted_runs(docs["text"], docs["doc_id"]))))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect())) == [plain_row(*x) for x in rows]


def test_runs_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert run_digests(periodic_runs(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, "a " * 20), (1, "a " * 20), (1, None), (None, "a " * 12), (None, "b")]
    docs = spark.createDataFrame(rows, schema)
    found = periodic_runs(docs.withColumn("text", with_planted_runs(docs["text"], docs["doc_id"]))).collect()
    assert sorted((x["doc_id"] or 0, len(x["runs"]), x["collapsed"]) for x in found) == [(0, 0, "b"), (0, 1, "a"), (1, 0, ""), (1, 1, "a"), (1, 1, "a")]


def test_overlapping_runs_are_cut_once():
    words = b"a a a a a a a a a a a a b a a a a a a a a a a a a b c".split()
    runs = find_runs(words)
    assert runs == [(0, 12, 1), (0, 26, 13), (13, 12, 1)]
    assert collapse(words, runs) == b"a b c"

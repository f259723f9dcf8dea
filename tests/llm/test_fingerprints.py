"""SimHash classes against comparing all fingerprints with each other."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from epochlens.llm import components, fingerprints

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(ids, prints):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low.setdefault(find(i), []).append(x)
    return [min((x for x in low[find(i)] if x is not None), default=None) for i in range(len(ids))]


def flip(r, x, n):
    for b in r.sample(range(64), n):
        x ^= 1 << b
    return x


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check(spark, ids, prints):
    rows = spark.createDataFrame([(i, signed(x)) for i, x in zip(ids, prints, strict=True)], "doc_id long, fingerprint long")
    found = fingerprints.fingerprint_classes(rows).collect()
    key = lambda x: (x[0] is None, x)
    want = [(i, signed(x), c) for i, x, c in zip(ids, prints, plain_classes(ids, prints), strict=True)]
    assert sorted([(x[0], x[1], x[2]) for x in found], key=key) == sorted(want, key=key)


def test_fingerprints():
    r = random.Random(1)
    texts = [" ".join(r.choice(["Été", "a", "B", "cc", "ddd"]) for _ in range(r.randrange(40))) for _ in range(300)] + ["", "  ", "One", "one TWO", "a\tb\nc\x0bd\x0ce\rf", "a b c d", "x " * 100_000]
    assert [fingerprints.fingerprint(t.encode()) for t in texts] == [plain_print(t) for t in texts]


def test_linked_fingerprints_share_a_key_and_tokens():
    r = random.Random(2)
    for _ in range(3000):
        a = r.getrandbits(64)
        both = np.array([a, flip(r, a, r.randrange(4))], dtype=np.uint64).view(np.int64)
        for made in (fingerprints.chain_keys(both), fingerprints.block_tokens(both)):
            assert len(np.intersect1d(made[0], made[1]))


def test_chains_leave_no_link_out(spark):
    r = random.Random(3)
    rows = [(signed(flip(r, 0, n)), n) for n in [*range(4)] * 300 + [*range(4, 30)] * 20]
    found = spark.createDataFrame(rows, "differ long, n int").withColumn("viable", fingerprints.on_a_chain(F.col("differ"))).collect()
    assert all(x["viable"] for x in found if x["n"] <= 3) and not all(x["viable"] for x in found if x["n"] > 10)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes(spark, seed):
    r = random.Random(seed)
    prints = [r.getrandbits(64) for _ in range(40)] + [0]
    for _ in range(400):
        prints.append(flip(r, r.choice(prints), r.choice([0, 1, 2, 3, 3, 4, 5, 6])))
    check(spark, r.sample(range(10**6), len(prints)), prints)


def test_classes_of_large_groups(spark, monkeypatch):
    """A centre with hundreds of near fingerprints, some of them linked only through others."""
    monkeypatch.setattr(components, "WIDE", 40)
    monkeypatch.setattr(components, "TILE", 40)
    r = random.Random(7)
    prints = [flip(r, 12345, r.randrange(9)) for _ in range(700)]
    prints += [x ^ (1 << 63) for x in prints[:200]] + [r.getrandbits(64) for _ in range(50)]
    check(spark, list(range(len(prints))), prints)


def test_documents(spark):
    r = random.Random(4)
    texts = []
    for k in range(30):
        words = [f"w{k}x{r.randrange(500)}" for _ in range(120)]
        texts += [" ".join(words), "\n".join(words).upper()]
        words[r.randrange(120)] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", " ", "a", "A", "a b", "x y z"]
    ids = [*range(len(texts) - 1), None]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").selectExpr("*", "1 component_id", "2 low", "'q' node", "'k' fingerprint")
    found = sorted(((x["doc_id"], x["fingerprint"], x["component_id"]) for x in fingerprints.simhash_classes(docs).collect()), key=lambda x: (x[0] is None, x))
    prints = [plain_print(t) for t in texts]
    want = list(zip(ids, [f"{x:016x}" for x in prints], plain_classes(ids, prints), strict=True))
    assert found == want


def test_empty_table_and_repeats(spark):
    schema = "doc_id long, text string"
    assert fingerprints.simhash_classes(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (5, None), (3, "a b c d"), (None, "q r s t"), (None, "q r s t")]
    found = sorted(((x["doc_id"] or -1, x["component_id"]) for x in fingerprints.simhash_classes(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert found == sorted([(5, 3), (5, 3), (5, 5), (3, 3), (-1, None), (-1, None)], key=str)

"""Greedy groups over blocks against one pass over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from epochlens.operators import candidates as C
from epochlens.operators import cuts as K
from epochlens.operators import findings as N


def plain_adaptive(sizes, most, long, huge, top):
    out, group, count, total, is_long = [], 0, 0, 0, False
    for n in sizes:
        over = is_long or n > long
        if count and not (count < (most // 2 if over else most) and n <= huge and total + n <= top):
            group, count, total, is_long = group + 1, 0, 0, False
        count, total, is_long = (most if n > huge else count + 1), total + n, is_long or n > long
        out.append(group)
    return out


def plain_capped(sizes, most, top):
    out, group, count, total = [], 0, 0, 0
    for n in sizes:
        if count and (count >= most or total + n > top):
            group, count, total = group + 1, 0, 0
        count, total = count + 1, total + n
        out.append(group)
    return out


@pytest.mark.parametrize(("seed", "block", "fan"), [(1, 16, 3), (2, 10, 256), (3, 4096, 256)])
def test_groups_over_blocks(spark, monkeypatch, seed, block, fan):
    """A hot key over many blocks and levels, keys of one row, a null key, sizes of nothing and of more than a group may hold."""
    monkeypatch.setattr(K, "FAN", fan)
    r = random.Random(seed)
    lengths = {"hot": 700, "mid": block + 1, "even": 2 * block if block < 100 else 40, "one": 1, None: 3 * 16 + 5}
    data = {k: [r.choice([0, 1, 3, 9, 12, 25, 80]) for _ in range(min(n, 900))] for k, n in lengths.items()}
    rows = [(k, i, None if n == 0 else n) for k, v in data.items() for i, n in enumerate(v)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "key string, at int, n int").repartition(7)
    for cuts, plain in ((K.adaptive_cuts(10, 20, 60, 100), lambda v: plain_adaptive(v, 10, 20, 60, 100)), (K.capped_cuts(10, 70), lambda v: plain_capped(v, 10, 70))):
        got = {(x["key"], x["at"]): x["group"] for x in K.greedy_groups(table, "key", "at", F.col("n"), cuts, 10, block).collect()}
        assert got == {(k, i): g for k, v in data.items() for i, g in enumerate(plain(v))}


def test_limits(spark):
    empty = spark.createDataFrame([], "path string, line int, text string")
    assert C.split_parts(empty).isEmpty() and N.adaptive_batches(empty, "path", "line", "text").isEmpty()
    with pytest.raises(ValueError, match="block"):
        K.greedy_groups(empty, "path", "line", F.lit(1), K.capped_cuts(10, 10), 10, 5)
    rows = [("f", i, "x" * n) for i, n in enumerate((4, 4, 30, 4), 1)]
    parts = C.split_parts(spark.createDataFrame(rows, "path string, line int, text string"), 10, 10).orderBy("part").collect()
    assert [tuple(p) for p in parts] == [("f", 1, 1, 2, 10), ("f", 2, 3, 3, 31), ("f", 3, 4, 4, 5)]


def test_a_hot_key_is_many_tasks(spark):
    """A key of 200,000 rows with blocks of 1,024: the same groups as one pass, from more than one partition."""
    table = spark.range(200_000).selectExpr("'hot' AS key", "id", "cast((id * 7919) % 1300 AS int) AS n")
    found = K.greedy_groups(table, "key", "id", F.col("n"), K.adaptive_cuts(100, 500, 1000, 50_000), 100, 1024).withColumn("p", F.spark_partition_id()).toPandas().sort_values("id")
    assert found["group"].tolist() == plain_adaptive([(i * 7919) % 1300 for i in range(200_000)], 100, 500, 1000, 50_000)
    assert found["p"].nunique() > 1

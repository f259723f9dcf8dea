"""Aliases by reachability against the closure, and on graphs that the closure does not fit."""

import random
import time

import pytest
from pyspark.sql import functions as F

from epochlens.operators import closure as G


def graph(spark, seed, n=40, cycles=True):
    r = random.Random(seed)
    edges = {(f"f{a}", f"f{b}") for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(2 * n)) if a != b and (cycles or a < b)}
    names = [f"t{i}" for i in range(9)]
    rows = [(f"f{r.randrange(n)}", i, r.choice(names), [r.choice([*names[:6], "time_t", "time_t", "int"]) for _ in range(r.choice([1, 1, 2]))], f"typedef {i}") for i in range(30)]
    files = spark.createDataFrame([(f"f{i}",) for i in range(n)], "path string")
    return files, spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame(rows, "path string, line int, alias string, words array<string>, text string")


@pytest.mark.parametrize(("seed", "hops", "most"), [(1, 5, 64), (2, 2, 64), (3, 5, 2)])
def test_same_rows_as_the_closure(spark, seed, hops, most):
    files, edges, typedefs = graph(spark, seed)
    closure = G.include_closure(files, edges)
    want = G.time_aliases(typedefs, closure, hops=hops, most=most)
    got = G.reached_aliases(typedefs, edges, hops=hops, most=most).checkpoint()
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and rows
    asked = lambda df: sorted((x["tu"], x["alias"], tuple(x["definitions"])) for x in df.collect())
    assert asked(G.reached_definitions(got, typedefs, edges)) == asked(G.alias_definitions(want, closure, typedefs))


def test_common_headers_of_many_files(spark):
    """Twenty thousand files include a chain of twenty headers; the closure would have 420,000 rows, of which none is made."""
    n, depth = 20_000, 20
    edges = spark.range(n).select(F.concat(F.lit("f"), "id").alias("src"), F.lit("h0").alias("dst")).unionByName(spark.range(depth - 1).select(F.concat(F.lit("h"), "id").alias("src"), F.concat(F.lit("h"), (F.col("id") + 1).cast("string")).alias("dst")))
    typedefs = spark.createDataFrame([(f"h{depth - 1}", 1, "a_t", ["time_t"]), ("h0", 1, "b_t", ["a_t"]), ("h3", 1, "other", ["int"]), ("f7", 1, "c_t", ["b_t", "x"])], "path string, line int, alias string, words array<string>")
    began = time.time()
    found = G.reached_aliases(typedefs, edges).groupBy("alias", "hop").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(map(tuple, found)) == [("a_t", 1, n + depth), ("b_t", 2, n + 1), ("c_t", 3, 1)] and time.time() - began < 180


def test_facts_of_empty_graphs(spark):
    none = spark.createDataFrame([], "src string, dst string")
    facts = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "path string, x int")
    assert sorted(map(tuple, G.spread(facts, none).collect()), key=str) == [("a", 1), ("b", None)]
    assert G.reached_aliases(spark.createDataFrame([], "path string, line int, alias string, words array<string>"), none).count() == 0


@pytest.mark.parametrize("cycles", [True, False])
def test_closure_reads_its_edges_once(spark, cycles):
    files, edges, _ = graph(spark, 4, n=25, cycles=cycles)
    edges = edges.unionByName(spark.createDataFrame([("f30", "f1"), ("f1", "f31"), ("f2", "f1"), ("f2", "f1")], edges.schema))  # files that are not listed, and an edge twice
    files = files.unionByName(spark.createDataFrame([("alone",)], files.schema))
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    pairs = [tuple(r) for r in edges.collect()]
    got = sorted(map(tuple, G.include_closure(files, edges.mapInPandas(counted, edges.schema)).collect()))
    assert read.value == len(pairs)
    want = {(r["path"], r["path"]) for r in files.collect()}
    while more := {(t, d) for t, v in want for s, d in pairs if s == v} - want:
        want |= more
    assert got == sorted(want)

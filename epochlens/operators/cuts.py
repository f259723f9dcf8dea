"""Greedy groups of ordered rows: a group ends where its next row would pass a limit.

Where a group ends depends on where it began, so a running sum with resets is no window. But the end of a group that would begin at a
row depends on the few rows after it alone. Rows of a key are cut into blocks; each block tells, for every place where a group may reach into it,
where the last group of the block reaches into the next and how many groups begin in between. These small maps are composed, and
then every block numbers its own rows: a key with a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoints

#: (sizes, end of each row's key or block) to the row at which a group that begins at a row ends.
Cuts = Callable[[np.ndarray, np.ndarray], np.ndarray]
BLOCK, FAN = 65_536, 256


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """A join in which null keys meet."""
    other = right.select(*[F.col(c).alias(f"r_{c}" if c in names else c) for c in right.columns])
    on = [left[c].eqNullSafe(other[f"r_{c}"]) for c in names]
    return left.join(other, on, how).drop(*[f"r_{c}" for c in names])


def number_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """``no``, the number of each row (k, o, n) within its key from 0, and the most rows of a key. Counted over range partitions, so that no task reads a whole key."""
    ensure_checkpoints(rows.sparkSession)
    ranged = rows.repartitionByRange("k", "o").withColumn("p", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("k", "p").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("k", "p", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    most = counts.groupBy("k").agg(F.sum("m").alias("m")).agg(F.max("m")).first()[0] or 0
    own = ranged.withColumn("i", F.row_number().over(Window.partitionBy("k", "p").orderBy("o")))
    return _same(own, base, ["k", "p"], "inner").select("k", "o", "n", (F.col("base") + F.col("i") - 1).alias("no")), most


def block_map(sizes: np.ndarray, own: int, cuts: Cuts, reach: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place at which a group may begin first in a block of ``own`` rows, where it leaves the block and how many groups begin in it.

    ``sizes`` goes on with the rows of the next block that a group may hold.
    """
    ends = cuts(sizes, np.full(len(sizes), len(sizes)))
    leaves, begun = np.zeros(max(own, reach), "int64"), np.zeros(max(own, reach), "int64")
    for i in range(own - 1, -1, -1):
        j = ends[i]
        leaves[i], begun[i] = (j - block, 1) if j >= own else (leaves[j], begun[j] + 1)
    return np.maximum(leaves[:reach], 0), begun[:reach]


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """Entry and number of the first group for each map of a group of maps, from those of the first."""
    frame = frame.sort_values("b")
    at, base, found = int(frame["at"].iloc[0]), int(frame["base"].iloc[0]), []
    for leaves, begun in zip(frame["leaves"], frame["begun"], strict=True):
        found.append((at, base))
        at, base = int(leaves[at]), base + int(begun[at])
    return pd.DataFrame({"k": frame["k"], "b": frame["b"], "at": [x for x, _ in found], "base": [x for _, x in found]})


def _compose(frame: pd.DataFrame) -> pd.DataFrame:
    """One map for a group of maps in order."""
    frame = frame.sort_values("b")
    leaves, begun = (np.asarray(frame[c].iloc[0]) for c in ("leaves", "begun"))
    for more, count in zip(frame["leaves"].iloc[1:], frame["begun"].iloc[1:], strict=True):
        leaves, begun = np.asarray(more)[leaves], begun + np.asarray(count)[leaves]
    return pd.DataFrame({"k": [frame["k"].iloc[0]], "b": [frame["g"].iloc[0]], "leaves": [leaves], "begun": [begun]})


def entries(maps: DataFrame, most: int) -> DataFrame:
    """Where the first group of each block begins and its number (k, b, at, base). Maps are composed ``FAN`` at a time, so a task holds no more of them."""
    kind = maps.schema["k"].dataType.simpleString()
    if most < FAN:
        begun = maps.withColumn("g", F.lit(0).cast("long")).withColumn("at", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long"))
    else:
        grouped = maps.withColumn("g", F.floor(F.col("b") / FAN))
        upper = grouped.groupBy("k", "g").applyInPandas(_compose, f"k {kind}, b long, leaves array<long>, begun array<long>").checkpoint()
        begun = _same(grouped, entries(upper, most // FAN).withColumnRenamed("b", "g"), ["k", "g"], "inner")
    return begun.groupBy("k", "g").applyInPandas(_walk, f"k {kind}, b long, at long, base long")


def greedy_groups(rows: DataFrame, key: str, order: str, size: Column, cuts: Cuts, reach: int, block: int = BLOCK) -> DataFrame:
    """The number of the group of each row within its key, from 0: key, order, n (its size, null: 0), group.

    ``cuts`` looks at no more than ``reach`` rows. ``order`` must be unique within a key; null keys are one key; an empty table has no groups.
    """
    if block < reach:
        raise ValueError("a block must hold the rows that a group may have")
    names = rows.schema[key].dataType.simpleString(), rows.schema[order].dataType.simpleString()
    placed, most = number_rows(rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(size, F.lit(0)).cast("long").alias("n")))
    placed = placed.withColumn("b", F.floor(F.col("no") / block))
    if most > block:
        ahead = (F.col("no") % block < reach) & (F.col("b") > 0)
        shared = placed.withColumn("b", F.explode(F.when(ahead, F.array("b", F.col("b") - 1)).otherwise(F.array("b"))))

        def describe(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("no")
            b = int(frame["b"].iloc[0])
            leaves, begun = block_map(frame["n"].to_numpy(), int((frame["no"] // block == b).sum()), cuts, reach, block)
            return pd.DataFrame({"k": [frame["k"].iloc[0]], "b": [b], "leaves": [leaves], "begun": [begun]})

        maps = shared.groupBy("k", "b").applyInPandas(describe, f"k {names[0]}, b long, leaves array<long>, begun array<long>").checkpoint()
        placed = _same(placed, entries(maps, (most - 1) // block), ["k", "b"], "left")
    else:
        placed = placed.withColumn("at", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long"))

    def number(done: pd.DataFrame) -> pd.DataFrame:
        begin = np.flatnonzero(done["no"].to_numpy() % block == 0)
        end = np.append(begin[1:], len(done))
        sizes, marks = done["n"].to_numpy(), np.zeros(len(done), "int64")
        ends = cuts(sizes, np.repeat(end, end - begin))
        for i, stop, at in zip(begin, end, done["at"].to_numpy()[begin], strict=True):
            i += at
            while i < stop:
                marks[i], i = 1, ends[i]
        upto = np.cumsum(marks)
        before = np.repeat(upto[begin] - marks[begin], end - begin)
        return done[["k", "o", "n"]].assign(group=done["base"].to_numpy() + upto - before - 1)

    def assign(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            begin = np.flatnonzero(held["no"].to_numpy() % block == 0)
            if len(begin) > 1:
                yield number(held.iloc[: begin[-1]])
                held = held.iloc[begin[-1] :]
        if held is not None and len(held):
            yield number(held)

    ready = placed.select("k", "o", "n", "no", "b", "at", "base").repartition("k", "b").sortWithinPartitions("k", "b", "no")
    found = ready.mapInPandas(assign, f"k {names[0]}, o {names[1]}, n long, group long")
    return found.select(F.col("k").alias(key), F.col("o").alias(order), "n", "group")


def capped_cuts(most_rows: int, most_size: int) -> Cuts:
    """Groups of at most so many rows and so large a sum; a row that is larger alone stands alone."""

    def cuts(sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at, total = np.arange(len(sizes)), np.concatenate([[0], np.cumsum(sizes)])
        fits = np.searchsorted(total, total[:-1] + most_size, "right") - 1
        return np.minimum(np.minimum(np.maximum(fits, at + 1), at + most_rows), ends)

    return cuts


def adaptive_cuts(most: int, long: int, huge: int, most_size: int) -> Cuts:
    """Groups of at most ``most`` rows, half as many with a row over ``long`` in them; a row over ``huge`` stands alone; no sum over ``most_size``."""

    def cuts(sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        start = np.arange(len(sizes))
        count, total, is_long, end = np.where(sizes > huge, most, 1), sizes.copy(), sizes > long, start + 1
        for step in range(1, most):
            start = start[start + step < ends[start]]
            new = sizes[start + step]
            over = is_long[start] | (new > long)
            fits = (count[start] < np.where(over, most // 2, most)) & (new <= huge) & (total[start] + new <= most_size)
            start, new, over = start[fits], new[fits], over[fits]
            if not len(start):
                break
            count[start] += 1
            total[start] += new
            is_long[start] = over
            end[start] += 1
        return end

    return cuts

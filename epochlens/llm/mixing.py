"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

Sources in code point order, null last, get the weights in turn. Targets share ``SHARE`` times all sizes by weight; a target
stops at ``MOST`` times its source's size and the excess is shared anew. That is a level: all sources get min(cap, level * weight),
found from sums over the sources sorted by cap / weight.

Blocks hold ``BLOCK`` words. A source whose target is under ``LEAST_BLOCKS`` of them has blocks of half the words, or a quarter, and so
on down to one word, so that none is lost to rounding. Over all sources with one size of block, the blocks go to those with the
highest quotients target / (j - 1/2). Only quotients near the divisor are ranked: with T the targets' sum, B the blocks and S the sources,
all quotients from T / (B - S/2) are among the highest B, and all of those are at least T / (B + S/2).

A source's documents are dealt by a seeded digest to shards of about ``SHARD_WORDS`` words. The source's quota is divided over its shards by
rounding its running share, so nothing is lost between them. Within a shard, documents lie end to end in seeded order, and the
quota's blocks are taken from a seeded start, around the end as often as needed; no document is passed more than twice.

Running sums over sources, quotients and shards are made in two steps, within the parts of a range partitioning and over the parts, so
no task sees all of them.

Defined cases: null text has size 0; null ids are dealt by the digest of an empty string; a source of size 0 has target 0;
repeated rows are taken as rows of their own; equal ratios and quotients go by source, null last; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, running_sums, saved

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK, LEAST_BLOCKS, SHARD_WORDS, SEED = 128, 32, 250_000, "mix-1"
KEYS = ["s_null", "s_key"]


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts, F.lit(SEED)).cast("binary"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """``sources``: s_null, s_key, source_size. Adds weight and target."""
    one = F.lit(1).cast("long")
    order = [F.col("s_null"), F.col("s_key")]
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = running_sums(sources, order, {"rank": one}).withColumn("weight", weight).drop("rank").withColumn("cap", MOST * F.col("source_size"))
    upto = saved(running_sums(ranked, [F.col("cap") / F.col("weight"), *order], {"caps": F.col("cap"), "weights": F.col("weight")}), "levels")
    words, weights = upto.agg(F.sum("source_size"), F.sum("weight")).first()
    # The first source that stays below its cap sets the level; those before it are at their caps.
    level = (F.lit(SHARE * (words or 0)) - (F.col("caps") - F.col("cap"))) / (F.lit(weights or 0) - F.col("weights") + F.col("weight"))
    first = upto.withColumn("level", level).filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct((F.col("caps") - F.col("cap")).alias("c"), "level"))).first()[0]
    cap = F.col("cap").cast("double")
    return upto.select(*KEYS, "source_size", "weight", cap.alias("target") if first is None else F.least(cap, F.lit(first["level"]) * F.col("weight")).alias("target"))


def source_quotas(targets: DataFrame) -> DataFrame:
    """``targets``: s_null, s_key, target and more. Adds the size of the source's blocks, ``unit``, and how many it gets, ``quota``."""
    unit = F.lit(1)
    for halvings in reversed(range((BLOCK - 1).bit_length())):
        unit = F.when(F.col("target") >= LEAST_BLOCKS * (BLOCK >> halvings), BLOCK >> halvings).otherwise(unit)
    units = targets.withColumn("unit", unit.cast("long"))
    # One row per size of block.
    sums = units.filter("target > 0").groupBy("unit").agg(F.sum("target").alias("t_sum"), F.count(F.lit(1)).alias("s_sum")).withColumn("blocks", F.round(F.col("t_sum") / F.col("unit")).cast("long"))
    upto = lambda blocks: F.when((blocks > 0) & (F.col("target") > 0), F.floor(F.col("target") * blocks / F.col("t_sum") + 0.5)).otherwise(0).cast("long")
    bounds = units.join(F.broadcast(sums), "unit", "left").withColumn("sure", upto(F.col("blocks") - F.col("s_sum") / 2))
    bounds = saved(bounds.withColumn("most", F.greatest(upto(F.col("blocks") + F.col("s_sum") / 2), F.col("sure"))), "bounds")
    near = bounds.filter("most > sure").select("unit", *KEYS, "target", F.explode(F.expr("sequence(sure + 1, most)")).alias("j"))
    order = [F.col("unit"), (F.col("target") / (F.col("j") - 0.5)).desc(), F.col("s_null"), F.col("s_key"), F.col("j")]
    ranked = running_sums(near, order, {"rank": F.lit(1).cast("long")})
    starts = ranked.groupBy("unit").agg((F.min("rank") - 1).alias("start"))
    left = bounds.groupBy("unit").agg((F.max("blocks") - F.sum("sure")).alias("left"))
    last = left.join(starts, "unit").select("unit", (F.col("start") + F.col("left")).alias("last"))
    won = ranked.join(F.broadcast(last), "unit").filter("rank <= last").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("won"))
    return bounds.join(won, KEYS, "left").select(*targets.columns, "unit", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def shard_quotas(cells: DataFrame) -> DataFrame:
    """``cells``: s_null, s_key, shard, words, source_size, quota and more. Replaces the source's quota by that of each of its shards."""
    order = [F.col("s_null"), F.col("s_key"), F.col("shard")]
    summed = saved(running_sums(cells, order, {"upto": F.col("words")}), "cells")
    begins = summed.groupBy(*KEYS).agg(F.min(F.col("upto") - F.col("words")).alias("begin"))
    share = lambda words: F.floor(F.col("quota").cast("double") * words.cast("double") / F.col("source_size").cast("double") + 0.5)
    upto = F.col("upto") - F.col("begin")
    own = F.when(F.col("source_size") > 0, share(upto) - share(upto - F.col("words"))).otherwise(0).cast("long")
    return summed.join(begins, KEYS).withColumn("quota", own).select(*cells.columns)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document with the words that the mix takes from it."""
    source = docs[source_col].cast("string")
    sized = saved(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            source.isNull().alias("s_null"),
            F.coalesce(source, F.lit("")).alias("s_key"),
            F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    sources = sized.groupBy(*KEYS).agg(F.sum("size").alias("source_size"))
    targets = saved(source_quotas(source_targets(sources)).withColumnRenamed("target", "source_target").withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long")), "targets")
    # One row per source: broadcast only while that is small.
    per_source = F.broadcast(targets) if targets.count() * 256 <= BROADCAST_BYTES else targets
    order = _digest(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    dealt = sized.withColumn("order", order).join(per_source.select(*KEYS, "shards"), KEYS).withColumn("shard", _number(F.col("order")) % F.col("shards"))
    keys = [*KEYS, "shard"]
    cells = dealt.groupBy(*keys).agg(F.sum("size").alias("words")).join(per_source.drop("weight", "shards"), KEYS)
    joined = dealt.drop("shards").join(shard_quotas(cells), keys)
    end = F.sum("size").over(Window.partitionBy(*keys).orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = (
        joined.withColumn("end", end)
        .withColumn("begin", F.col("end") - F.col("size"))
        .withColumn("wanted", F.least(F.col("quota") * F.col("unit"), MOST * F.col("words")))
        .withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("wanted") / F.col("words"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("wanted") - F.col("passes") * F.col("words"))
        .withColumn("start", F.when(F.col("words") > 0, (_number(_digest(F.col("shard").cast("string"), F.col("s_key"))) % F.ceil(F.col("words") / F.col("unit"))) * F.col("unit")).otherwise(0).cast("long"))
    )
    overlap = lambda a, b: F.greatest(F.least(F.col("end"), b) - F.greatest(F.col("begin"), a), F.lit(0))
    stop = F.col("start") + F.col("rest")
    taken = F.col("passes") * F.col("size") + overlap(F.col("start"), F.least(stop, F.col("words"))) + overlap(F.lit(0), stop - F.col("words"))
    return laid.select("doc_id", "size", "source_size", F.col("source_target").alias("target"), taken.cast("long").alias("taken"))


#: DuckDB SQL for ``mix_sources`` over ``{docs}``: all quotients of all sources, ranked whole.
SQL = r"""
WITH sized AS (SELECT doc_id, source IS NULL AS s_null, coalesce(source, '') AS s_key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
      md5(coalesce(doc_id::VARCHAR, '') || ':mix-1') AS ord FROM {docs}),
s AS (SELECT s_null, s_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY s_null, s_key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - (sum(cap) OVER r - cap)::DOUBLE) / ((sum(weight) OVER ()) - sum(weight) OVER r + weight)::DOUBLE AS level,
      sum(cap) OVER r - cap AS caps_before FROM w WINDOW r AS (ORDER BY cap::DOUBLE / weight, s_null, s_key ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT arg_min(level, caps_before) AS lam FROM l WHERE level * weight <= cap),
t AS (SELECT s_null, s_key, source_size, greatest(1, ceil(source_size / 250000.0))::BIGINT AS shards, least(cap::DOUBLE, coalesce((SELECT lam FROM lv) * weight, cap::DOUBLE)) AS source_target FROM l),
u AS (SELECT *, CASE WHEN source_target >= 4096 THEN 128 WHEN source_target >= 2048 THEN 64 WHEN source_target >= 1024 THEN 32 WHEN source_target >= 512 THEN 16
      WHEN source_target >= 256 THEN 8 WHEN source_target >= 128 THEN 4 WHEN source_target >= 64 THEN 2 ELSE 1 END AS unit FROM t),
b AS (SELECT unit, round(sum(source_target) / unit)::BIGINT AS blocks FROM u WHERE source_target > 0 GROUP BY unit),
q AS (SELECT unit, s_null, s_key, row_number() OVER (PARTITION BY unit ORDER BY source_target / (j - 0.5::DOUBLE) DESC, s_null, s_key, j) AS rank
      FROM (SELECT *, unnest(generate_series(1, (source_target / unit)::BIGINT + 8)) AS j FROM u WHERE source_target > 0)),
won AS (SELECT s_null, s_key, count(*) AS quota FROM q JOIN b USING (unit) WHERE rank <= blocks GROUP BY ALL),
d AS (SELECT sized.*, ('0x' || substr(ord, 1, 8))::BIGINT % shards AS shard FROM sized JOIN t ON sized.s_null = t.s_null AND sized.s_key = t.s_key),
c AS (SELECT *, (sum(words) OVER (PARTITION BY s_null, s_key ORDER BY shard ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM (SELECT s_null, s_key, shard, sum(size)::BIGINT AS words FROM d GROUP BY ALL)),
cq AS (SELECT c.*, unit, source_size, source_target, CASE WHEN source_size > 0 THEN (floor(coalesce(quota, 0)::DOUBLE * upto::DOUBLE / source_size::DOUBLE + 0.5::DOUBLE)
      - floor(coalesce(quota, 0)::DOUBLE * (upto - words)::DOUBLE / source_size::DOUBLE + 0.5::DOUBLE))::BIGINT ELSE 0 END AS quota
      FROM c JOIN u ON c.s_null = u.s_null AND c.s_key = u.s_key LEFT JOIN won ON c.s_null = won.s_null AND c.s_key = won.s_key),
laid AS (SELECT d.doc_id, d.size, source_size, source_target, words,
      (sum(d.size) OVER (PARTITION BY d.s_null, d.s_key, d.shard ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS e,
      least(quota * unit, 2 * words) AS wanted,
      CASE WHEN words > 0 THEN ('0x' || substr(md5(d.shard::VARCHAR || ':' || d.s_key || ':mix-1'), 1, 8))::BIGINT % ceil(words / unit::DOUBLE)::BIGINT * unit ELSE 0 END AS start
      FROM d JOIN cq ON d.s_null = cq.s_null AND d.s_key = cq.s_key AND d.shard = cq.shard),
p AS (SELECT *, CASE WHEN words > 0 THEN wanted // words ELSE 0 END AS passes FROM laid),
o AS (SELECT *, wanted - passes * words AS rest FROM p)
SELECT doc_id, size, source_size, source_target AS target,
  (passes * size + greatest(least(e, least(start + rest, words)) - greatest(e - size, start), 0) + greatest(least(e, start + rest - words) - greatest(e - size, 0), 0))::BIGINT AS taken
FROM o
"""

"""Prefix tries of conversations.

A node is a sequence of turns with which at least one conversation begins; its members are the conversations that begin with it, and the root is the empty sequence. Turns are
known by a digest of role and text, so no text travels further than one numbering of the turns.

Equal conversations are one sequence with a weight, however many there are. Sequences are dealt out by the digest of their first turn: each first turn is a subtrie, and as many subtries
as make ``LIMIT`` turns are built by one task of ``applyInPandas`` as dictionaries that point from a turn's digest to the child. Nodes are made after their parents, so walking them
backwards is a postorder, without recursion. A subtrie of more than ``LIMIT`` turns is not built: its top node is made by a grouped aggregation, its children become
subtries of their own, by their next turn, and so on; afterwards the top nodes get the sums of their children, from the lowest up. A subtrie that is one single long
conversation has no branches and is made by a window over its turns. So no task holds more than some ``LIMIT`` turns in memory, whatever the conversations share.

Digests of the members that end in a node are made over ascending pieces of ids, read in order as a stream.

Defined cases: turns of a conversation are ordered by turn (null first), then role, then text, and repeated rows are turns of their own; null roles and texts are empty; rows without a conversation
id are left out; conversations without turns end in the root; without conversations there are no nodes, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_sized, saved

#: Turns of a subtrie that is built in one piece.
LIMIT = 8192
#: A piece of the ids that end in a node spans 2 ** PIECE numbers.
PIECE = 10
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end", "end_n"]
_LINK = "parent binary, top boolean"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long, end_n long"
SHA = 256


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), role, text: the turns in order, null roles and texts empty."""
    named = turns.select(turns[conv_col].cast("long").alias("conv"), turns[turn_col].alias("turn"), *[F.coalesce(turns[c].cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return named.filter("conv is not null").select("conv", F.row_number().over(order).cast("long").alias("pos"), "role", "text")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations with borrowed beginnings, and all their ids: c begins with the first h turns of c - c % 5 and goes on with its own after its first h, h = crc32(c) % 9."""
    own = saved(numbered_turns(conversations), "turns")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).filter("conv_id is not null").distinct()
    h = lambda c: F.crc32(c.cast("string")) % 9
    borrows = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("conv"), h(F.col("conv_id")).alias("h"))
    # At most five conversations borrow from one, eight turns each.
    heads = own.filter("pos <= 8").join(borrows, "conv").filter("pos <= h").select("conv_id", F.col("pos").alias("turn"), "role", "text")
    tails = own.filter(F.col("pos") > h(F.col("conv"))).select(F.col("conv").alias("conv_id"), F.col("pos").alias("turn"), "role", "text")
    return heads.unionByName(tails), ids


def _key(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """Subtries of whole first (or next) turns -> their nodes."""
    pdf = pdf.sort_values(["grp", "seq", "pos"])
    children, up, conv, n_convs, size, depth, end, end_n, parent, parent_conv = ([] for _ in range(10))
    tops: dict[bytes, int] = {}

    def node(above: int, pos: int, n_bytes: int, key, conv_above) -> int:
        children.append({})
        for values, x in zip((up, conv, n_convs, size, depth, end, end_n, parent, parent_conv), (above, None, 0, n_bytes, pos, None, None, key, conv_above), strict=True):
            values.append(x)
        return len(up) - 1

    last, at = None, -1
    columns = (pdf[c].tolist() for c in ("grp", "parent", "parent_conv", "seq", "n", "len", "pos", "digest", "n_bytes"))
    for grp, key, conv_above, seq, n, length, pos, digest, n_bytes in zip(*columns, strict=True):
        if (grp, seq) != last:
            last = (grp, seq)
            if grp not in tops:
                tops[grp] = node(-1, pos, n_bytes, key, conv_above)
            at = tops[grp]
        else:
            below = children[at].get(digest)
            if below is None:
                below = children[at][digest] = node(at, pos, n_bytes, None, None)
            at = below
        n_convs[at] += n
        conv[at] = seq if conv[at] is None else min(conv[at], seq)
        if pos == length:
            end[at], end_n[at] = seq, n
    leaves, tokens = [0 if c else 1 for c in children], [(n - 1) * s for n, s in zip(n_convs, size, strict=True)]
    for i in range(len(up) - 1, -1, -1):
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            tokens[up[i]] += tokens[i]
            parent_conv[i] = conv[up[i]]
    found = pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": parent_conv, "n_convs": n_convs, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": tokens})
    found["end"], found["end_n"] = pd.array(end, dtype="Int64"), pd.array(end_n, dtype="Int64")
    found["parent"], found["top"] = parent, [x < 0 for x in up]
    return found


def _chain(rows: DataFrame, level: int) -> DataFrame:
    """Nodes of subtries that are one sequence each."""
    below = Window.partitionBy("seq").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top, last = F.col("pos") == level, F.col("pos") == F.col("len")
    return rows.select(
        F.col("seq").alias("conv_id"), F.col("pos").alias("depth"), F.when(top, F.col("parent_conv")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.sum("n_bytes").over(below)).alias("saved_tokens"),
        F.when(last, F.col("seq")).alias("end"), F.when(last, F.col("n")).alias("end_n"), F.when(top, F.col("parent")).alias("parent"), top.alias("top"),
    )


def _ids_digest(pieces: DataFrame) -> DataFrame:
    """``pieces``: seq, piece, ids (ascending, comma-joined) -> seq, sha of all ids in order. Each task reads its pieces as a stream."""

    def run(batches):
        seq, digest = None, None
        for batch in batches:
            done = []
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != seq:
                    if digest is not None:
                        done.append((seq, digest.hexdigest()))
                    seq, digest = s, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pa.record_batch([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], ["seq", "sha"])
        if digest is not None:
            yield pa.record_batch([pa.array([seq], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["seq", "sha"])

    return pieces.repartition("seq").sortWithinPartitions("seq", "piece").select("seq", "ids").mapInArrow(run, "seq long, sha string")


def conversation_trie(turns: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``ids`` (a column conv_id) names conversations besides those that have turns. saved_tokens is the number of bytes, over the subtree, that members after a node's first need not
    hold again; ends_sha256 is the digest of the comma-joined ascending ids of the members that end in the node.
    """
    numbered = numbered_turns(turns, conv_col, turn_col, role_col, text_col)
    digest = _key(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = numbered.select("conv", "pos", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = saved(rows, "turn-digests")

    # Equal conversations are one sequence, named by its smallest conversation.
    sums = {f"s{k}": F.sum(F.xxhash64(F.lit(k), "pos", "digest").cast("decimal(20,0)")) for k in (1, 2)}
    own = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("len"), *[v.alias(k) for k, v in sums.items()])
    if ids is not None:
        every = ids.select(F.col("conv_id").cast("long").alias("conv")).filter("conv is not null").distinct()
        own = every.join(own, "conv", "full").select("conv", F.coalesce("len", F.lit(0)).alias("len"), *[F.coalesce(k, F.lit(0)).alias(k) for k in sums])
    own = saved(own, "sequences")
    identity = ["len", *sums]
    seqs = saved(own.groupBy(*identity).agg(F.min("conv").alias("seq"), F.count(F.lit(1)).alias("n")), "distinct")
    total = seqs.agg(F.min("seq"), F.sum("n"), F.max(F.when(F.col("len") == 0, F.col("seq"))), F.max(F.when(F.col("len") == 0, F.col("n"))), F.count(F.lit(1)), F.sum("len")).first()
    spark = turns.sparkSession
    n_seqs, n_rows = total[4], total[5] or 0
    if not n_seqs:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    firsts = seqs.filter("len > 0").select(F.col("seq").alias("conv"), "n", "len")
    kept = saved(join_sized(rows, firsts, ["conv"], "inner", 48, n_seqs).withColumnRenamed("conv", "seq"), "rows")
    heads = kept.filter("pos = 1").select("seq", F.col("digest").alias("grp"))
    active = saved(join_sized(kept, heads, ["seq"], "inner", 64, n_seqs).select("*", F.lit(None).cast("binary").alias("parent"), F.lit(total[0]).cast("long").alias("parent_conv")), "active")
    discard(kept)

    built, tops, level = [], [], 1
    while True:
        sizes = active.groupBy("grp").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.when(F.col("pos") == level, 1).otherwise(0)).alias("seqs"))
        large = saved(sizes.filter(F.col("turns") > LIMIT).select("grp", (F.col("seqs") == 1).alias("single")), "large")
        n_large = large.count()  # at most one for each LIMIT rows
        ready = join_sized(active, large, ["grp"], "left_anti", 48, n_large) if n_large else active
        buckets = max(1, n_rows // LIMIT + 1)
        dealt = ready.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)))
        built.append(saved(dealt.groupBy("bucket").applyInPandas(_build, f"{NODE}, {_LINK}"), "nodes"))
        if not n_large:
            break
        marked = join_sized(active, large, ["grp"], "inner", 48, n_large)
        built.append(saved(_chain(marked.filter("single"), level), "chains"))
        over = saved(marked.filter("not single").drop("single"), "over")
        last = F.col("len") == level
        top = over.filter(F.col("pos") == level).groupBy("grp").agg(
            F.first("parent").alias("parent"), F.min("parent_conv").alias("parent_conv_id"), F.min("seq").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
            F.max(F.when(last, F.col("seq"))).alias("end"), F.max(F.when(last, F.col("n"))).alias("end_n"),
        )
        tops.append(saved(top.withColumn("depth", F.lit(level).cast("long")), "tops"))
        following = over.filter(F.col("pos") == level + 1).select("seq", F.col("digest").alias("next"))
        below = join_sized(over.filter(F.col("pos") > level).drop("parent", "parent_conv"), following, ["seq"], "inner", 64, n_seqs)
        above = tops[-1].select("grp", F.col("conv_id").alias("parent_conv"))
        below = join_sized(below, above, ["grp"], "inner", 64, n_large).withColumn("parent", F.col("grp")).withColumn("grp", _key("grp", "next")).drop("next")
        before, active = active, saved(below.select(*active.columns), "active")
        discard(before, over)
        level += 1

    # Sums of the nodes that were not built, from the lowest level up.
    for top in reversed(tops):
        kids = _sums(built)
        done = top.withColumnRenamed("parent", "above").join(kids.withColumnRenamed("parent", "grp"), "grp")
        done = done.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes"))
        built.append(saved(done.select(*_NODE, F.col("above").alias("parent"), F.lit(True).alias("top")), "top-nodes"))
    under = _union(built).filter("top and parent is null").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = under.select(
        F.lit(total[0]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total[1]).cast("long").alias("n_convs"), "n_children",
        F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.lit(total[2]).cast("long").alias("end"), F.lit(total[3]).cast("long").alias("end_n"),
    )
    nodes = _union(built).select(*_NODE).unionByName(root)

    shared = seqs.filter("n > 1").select(*identity, "seq")
    members = join_sized(own, shared, identity, "inner", 64, n_seqs).select("seq", "conv", F.shiftright("conv", PIECE).alias("piece"))
    pieces = members.groupBy("seq", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    digests = saved(_ids_digest(pieces), "digests")
    ended = join_sized(nodes, digests.select(F.col("seq").alias("end"), "sha"), ["end"], "left", 96)
    sha = F.when(F.col("end").isNull(), F.sha2(F.lit(""), SHA)).when(F.col("end_n") == 1, F.sha2(F.col("end").cast("string"), SHA)).otherwise(F.col("sha"))
    return ended.select(*_NODE[:7], sha.alias("ends_sha256"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _sums(built: list[DataFrame]) -> DataFrame:
    """Of the top nodes under each parent: how many, their leaves and saved bytes."""
    tops = _union(built).filter("top and parent is not null")
    return tops.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

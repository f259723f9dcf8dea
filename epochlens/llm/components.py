"""Classes from candidate groups: star pairs first, then only what they leave apart, then connected components.

A candidate group holds nodes that may be linked to each other. All pairs of a group are never emitted. First each node is
paired with its group's smallest node and the pairs are verified. Groups whose nodes then lie in more than one component are looked at
again. Small ones are compared in one task: pairs across components by a parity sketch whose distance never exceeds the true
difference, and only pairs that pass are verified. The nodes of groups of more than ``WIDE`` nodes are first grouped anew, by their own tokens:
linked nodes share one of their rarest few, rarest among these nodes, so each node joins a group for each of these, and what is merely
common links nothing. The rows are as many as the nodes' tokens. Only a group that is wide again is compared in blocks of ``TILE`` nodes. No
link is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_sized, mix64, saved

TILE = WIDE = 2048
#: Nodes of one slice that share a key, beyond which they travel apart from the key's bucket.
MANY = 16


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component), the smallest node reachable, by alternating large and small stars."""
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        before, edges = edges, saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before, large)
        n, sources, now = edges.agg(F.count(F.lit(1)), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        # Done where each node hangs on one centre that hangs on none.
        if n == sources and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() or (n, now) == state:
            break
        state = (n, now)
    centers = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(centers)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """Xor a sketch matrix down to ``words`` words; parity sketches of power-of-two sizes allow that."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def residual_pairs(members: DataFrame, limit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``members``: gid, node, component, size, sketch -> pairs (a, b) across components that may be linked.

    ``limit(size, sizes)`` is the largest difference that still makes a link, negative where sizes rule it out. Sketch lengths are
    powers of two, of 8 bytes at least.
    """
    counts = members.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    placed = members.join(counts, "gid").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))

    def compare(table: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for (_, lo, hi), (block, nodes, comps, sizes), sketches in _groups(table, ("gid", "lo", "hi"), ("i", "node", "component", "size")):
            n, rows = len(nodes), _Rows(sketches)
            step = max(1, PAIRS // n)
            for begin in range(0, n - 1, step):
                x, y = np.nonzero(np.arange(begin, min(begin + step, n))[:, None] < np.arange(n)[None, :])
                x += begin
                most = limit(sizes[x], sizes[y])
                ok = (most >= 0) & (comps[x] != comps[y]) & (nodes[x] != nodes[y])
                if lo != hi:
                    ok &= block[x] != block[y]
                x, y, most = x[ok], y[ok], most[ok]
                near = rows.distances(x, y) <= most
                a.append(np.minimum(nodes[x[near]], nodes[y[near]]))
                b.append(np.maximum(nodes[x[near]], nodes[y[near]]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    picked = dealt.select("gid", "lo", "hi", "i", "node", "component", "size", "sketch")
    return _bundled(picked, members, ("gid", "lo", "hi")).applyInArrow(compare, "a long, b long").distinct()


#: Rows of the groups that one call of a Python function takes, about, and pairs that are looked at, and words of sketches compared, at once.
BUNDLE, PAIRS, WORDS_AT_ONCE = 2048, 1 << 16, 1 << 20


def _bundled(rows: DataFrame, members: DataFrame, keys: tuple[str, ...]):
    """Whole groups, many small ones to a call: a call has a price of its own, which most groups are not worth."""
    bundles = max(1, members.count() // BUNDLE)
    return rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(bundles)).alias("bundle"))


def _groups(table: pa.Table, keys: tuple[str, ...], columns: tuple[str, ...]):
    """Per group its keys, its columns as arrays, in order of size, and its sketches."""
    table = table.combine_chunks()
    values = {c: np.asarray(table.column(c).to_numpy(), dtype=np.int64) for c in (*keys, *columns)}
    sketches = table.column("sketch").to_pylist()
    order = np.lexsort((values["node"], values["size"], *(values[k] for k in reversed(keys))))
    changed = np.zeros(len(order), dtype=bool)
    for k in keys:
        changed[1:] |= values[k][order][1:] != values[k][order][:-1]
    begins = np.flatnonzero(changed).tolist()
    for begin, end in itertools.pairwise([0, *begins, len(order)]):
        mine = order[begin:end]
        if len(mine) > 1:
            yield tuple(int(values[k][mine[0]]) for k in keys), tuple(values[c][mine] for c in columns), [sketches[i] for i in mine.tolist()]


class _Rows:
    """Sketches of a group by length, so that many pairs are compared at once."""

    def __init__(self, sketches: list[bytes]) -> None:
        self.words = np.array([len(s) // 8 for s in sketches])
        self.place = np.zeros(len(sketches), dtype=np.int64)
        self.matrix = {}
        for n in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == n)
            self.place[at] = np.arange(len(at))
            self.matrix[n] = _stack([sketches[i] for i in at.tolist()])

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for n in self.matrix:
            for m in self.matrix:
                mine = np.flatnonzero((self.words[x] == n) & (self.words[y] == m)) if len(self.matrix) > 1 else np.arange(len(x))
                least = min(n, m)
                for k in range(0, len(mine), max(1, WORDS_AT_ONCE // max(n, m))):
                    at = mine[k : k + max(1, WORDS_AT_ONCE // max(n, m))]
                    out[at] = np.bitwise_count(fold(self.matrix[n][self.place[x[at]]], least) ^ fold(self.matrix[m][self.place[y[at]]], least)).sum(axis=1)
        return out


def _stack(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(len(sketches), -1)


def _apart(members: DataFrame) -> DataFrame:
    """gid and n of the groups (gid, node, component) whose nodes lie in several components; of groups of the same nodes one."""
    groups = members.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return groups.filter("lo <> hi").groupBy("n", "least", "sum").agg(F.min("gid").alias("gid")).select("gid", "n")


def split_wide(wide: DataFrame, tokens: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``wide``: distinct node and component of the members of all wide groups -> gid, node, component of groups by rare tokens.

    ``tokens(nodes)`` gives node, tokens (array of long) and take: linked nodes share one of the first ``take`` in any common order. The order here is by
    how many of these nodes hold a token. Each node is taken once, in however many wide groups it is.
    """
    held = saved(wide.join(tokens(wide.select("node")), "node").select("node", "component", "take", F.explode("tokens").alias("token")), "tokens")
    counts = saved(held.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "token-counts")
    # Tokens that many nodes hold are few, so they join by broadcast, and the rest has no hot key.
    common, scarce = counts.filter(F.col("c") > WIDE), counts.filter(F.col("c") <= WIDE)
    known = join_sized(held, common, ["token"], "left", 64)
    rest = known.filter("c is null").drop("c").join(scarce, ["token"], "left")
    every = known.filter("c is not null").unionByName(rest)
    order = Window.partitionBy("node").orderBy(F.coalesce("c", F.lit(1)), "token")
    first = every.withColumn("rank", F.row_number().over(order)).filter("rank <= take and c is not null")
    parts = saved(first.select(F.xxhash64("token").alias("gid"), "node", "component"), "subgroups")
    discard(held, counts)
    return parts.join(_apart(parts).select("gid"), "gid")


def link_classes(groups: DataFrame, verify: Callable[[DataFrame], DataFrame], sketches: Callable[[DataFrame], DataFrame], limit, tokens, inline: bool = False) -> tuple[DataFrame, DataFrame]:
    """``groups``: gid, first, node, saved. ``verify`` keeps the pairs (a, b) that are links; ``sketches(nodes)`` gives node, size, sketch;
    ``tokens`` as in ``split_wide``. ``inline``: a sketch follows from the node alone, so ``sketches`` adds size and sketch to any rows, and nothing is joined.

    Returns the verified links that connect all classes and (node, component).
    """
    with_sketches = sketches if inline else lambda rows: _with_node_values(rows, saved(sketches(rows.select("node").distinct()), "sketches"))
    pieces = groups.filter(F.col("gid") >= HOT_GID)
    centers = saved(pieces.groupBy("gid").agg(F.min("node").alias("first")), "centers")
    whole = join_sized(pieces.select("gid", "node").distinct(), centers, ["gid"], "inner", 32).select("gid", "first", "node")
    star = groups.filter(F.col("gid") < HOT_GID).select("gid", "first", "node").unionByName(whole)
    star = saved(star.select(F.col("first").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct(), "star")
    links = saved(verify(star), "links")
    comps = saved(components(links), "components")
    every = groups.filter("gid >= 0").select("gid", "node").distinct()
    left = _left_apart(every, comps, tokens)
    if left is None:
        return links, comps
    # Groups that are copies of one text hang together by the node nearest to all, whichever that is.
    sketched = with_sketches(left)
    near = saved(middle_pairs(sketched, limit).join(star, ["a", "b"], "left_anti"), "middles")
    if not near.isEmpty():
        links = saved(links.unionByName(verify(near)), "links")
        comps = saved(components(links), "components")
        left = _left_apart(every, comps, tokens)
        if left is None:
            return links, comps
        sketched = with_sketches(left)
    more = saved(residual_pairs(sketched, limit).join(star.unionByName(near), ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return links, comps
    links = saved(links.unionByName(verify(more)), "links")
    return links, saved(components(links), "components")


def _with_node_values(members: DataFrame, values: DataFrame) -> DataFrame:
    """``members`` (gid, node, component) with the values of their nodes. A node meets its values once, with the list of its groups, which is as long as its keys or tokens."""
    held = members.groupBy("node").agg(F.min("component").alias("component"), F.collect_list("gid").alias("gids"))
    return held.join(values, "node").withColumn("gid", F.explode("gids")).drop("gids")


def _left_apart(groups: DataFrame, comps: DataFrame, tokens) -> DataFrame | None:
    """gid, node, component of the groups (gid, node) whose nodes lie in several components, wide ones as their groups by rare tokens; none if there are none."""
    many = saved(groups.join(comps, "node", "left").select("gid", "node", F.coalesce("component", "node").alias("component")), "members")
    split = saved(_apart(many).withColumn("wide", F.col("n") > WIDE).select("gid", "wide"), "split")
    apart = [r[0] for r in split.select("wide").distinct().collect()]
    if not apart:
        return None
    left = many.join(split, "gid")
    if True in apart:
        wide = saved(left.filter("wide").select("node", "component").distinct(), "wide")
        left = left.filter("not wide").drop("wide").unionByName(split_wide(wide, tokens))
    residual = saved(left.select("gid", "node", "component"), "residual")
    discard(many, split)
    return residual


def middle_pairs(members: DataFrame, limit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``members``: gid, node, component, size, sketch -> pairs of each node with the middle of its group, where they may be linked.

    The middle is the node whose sketch is nearest to what most sketches of its length have in common. Groups are read in pieces of ``TILE`` nodes.
    """

    def run(table: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for _, (nodes, comps, sizes), sketches in _groups(table, ("gid", "piece"), ("node", "component", "size")):
            rows = _Rows(sketches)
            for n, matrix in rows.matrix.items():
                at = np.flatnonzero(rows.words == n)
                if len(at) < 2 or (comps[at] == comps[at[0]]).all():
                    continue
                bits = np.unpackbits(matrix.view(np.uint8), axis=1, bitorder="little")
                usual = np.packbits((2 * bits.sum(axis=0) > len(at)).astype(np.uint8), bitorder="little").view(np.uint64)
                middle = int(np.argmin(np.bitwise_count(matrix ^ usual[None, :]).sum(axis=1)))
                far = np.bitwise_count(matrix ^ matrix[middle][None, :]).sum(axis=1)
                m = at[middle]
                ok = (far <= limit(sizes[m], sizes[at])) & (comps[at] != comps[m]) & (nodes[at] != nodes[m])
                a.append(np.minimum(nodes[at[ok]], nodes[m]))
                b.append(np.maximum(nodes[at[ok]], nodes[m]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    counts = members.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    placed = members.join(counts, "gid").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return _bundled(placed.select("gid", "piece", "node", "component", "size", "sketch"), members, ("gid", "piece")).applyInArrow(run, "a long, b long").distinct()


PACKED = "bucket int, keys binary, at binary, hot binary, nodes binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("at", pa.binary()), ("hot", pa.binary()), ("nodes", pa.binary())])
GROUPS = "gid long, first long, node long"


def pack_keys(keys: np.ndarray, at: np.ndarray, nodes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of ``PACKED`` for one slice: pairs of a 64-bit key and a node, ``nodes[at]``, by bucket.

    Of more than ``MANY`` nodes with one key only the smallest goes to the key's bucket, marked as hot; they all go to bucket -1, with
    their key, so no bucket gathers all the nodes of a hot key.
    """
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    whole = (bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
    order = np.argsort(whole, kind="stable")
    whole, at = whole[order], at[order]
    begins = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]]) if len(at) else np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.r_[begins, len(at)])
    many = lengths > MANY
    hot, drop = np.zeros(len(at), dtype=np.uint8), np.zeros(len(at), dtype=bool)
    rows = []
    for b, n in zip(begins[many].tolist(), lengths[many].tolist(), strict=True):
        mine = at[b : b + n]
        own, firsts = np.unique(nodes[mine], return_index=True)
        at[b], hot[b] = mine[firsts[0]], 1
        drop[b + 1 : b + n] = True
        rows.append((-1, whole[b : b + 1].tobytes(), b"", b"", own.tobytes()))
    whole, at, hot = whole[~drop], at[~drop], hot[~drop]
    bucket, low = (whole >> np.uint64(32)).astype(np.int64), (whole & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    ends = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() if len(at) else []
    for a, b in itertools.pairwise([*ends, len(at)]):
        used, local = np.unique(at[a:b], return_inverse=True)
        rows.append((int(bucket[a]), low[a:b].tobytes(), local.astype(np.uint32).tobytes(), hot[a:b].tobytes(), nodes[used].tobytes()))
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)] if rows else [pa.array([], f.type) for f in _PACKED], schema=_PACKED)


def key_groups(packed: DataFrame) -> DataFrame:
    """Rows of ``PACKED`` -> distinct nodes that share a key: gid (-1 for pairs), first, node."""
    spread = packed.withColumn("spread", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("nodes"), F.lit(1 << 20))).otherwise(0))
    return spread.groupBy("bucket", "spread").applyInArrow(_bucket_groups, GROUPS)


#: Groups of hot keys, which come in pieces, have numbers from here on.
HOT_GID = 1 << 62


def _gid(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys) >> np.uint64(2)).astype(np.int64) + HOT_GID


def _bucket_groups(table: pa.Table) -> pa.Table:
    nodes = [np.frombuffer(x, dtype=np.int64) for x in table.column("nodes").to_pylist()]
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        gids = _gid(np.array([int.from_bytes(x, "little") for x in table.column("keys").to_pylist()], dtype=np.uint64))
        lengths = [len(x) for x in nodes]
        return pa.table({"gid": np.repeat(gids, lengths), "first": np.repeat(np.array([x[0] for x in nodes], dtype=np.int64), lengths), "node": np.concatenate(nodes)})
    keys = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("keys").to_pylist()])
    hot = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in table.column("hot").to_pylist()])
    node = np.concatenate([x[np.frombuffer(a, dtype=np.uint32)] for x, a in zip(nodes, table.column("at").to_pylist(), strict=True)])
    gid, first, node = grouped_runs(keys, node, hot, bucket)
    return pa.table({"gid": gid, "first": first, "node": node})


def grouped_runs(keys: np.ndarray, nodes: np.ndarray, hot: np.ndarray, bucket: int):
    """Distinct nodes that share a key, as arrays (gid or -1 for pairs, first, node). Equal sets of nodes come once; a hot key's set always."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    # Most keys stand alone; the rest is put in order of nodes, marked ones first.
    order = order[(np.r_[False, same] | np.r_[same, False] if len(order) else np.zeros(0, dtype=bool)) | (hot[order] > 0)]
    keys, nodes, hot = keys[order], nodes[order], hot[order]
    order = np.lexsort((1 - hot, nodes, keys))
    keys, nodes, hot = keys[order], nodes[order], hot[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, hot = keys[fresh], nodes[fresh], hot[fresh]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.r_[begins, len(keys)])
    marked = np.maximum.reduceat(hot, begins) > 0 if len(keys) else np.zeros(0, dtype=bool)
    two = begins[(lengths == 2) & ~marked]
    pairs = np.unique(np.column_stack([nodes[two], nodes[two + 1]]), axis=0) if len(two) else np.zeros((0, 2), dtype=np.int64)
    big = (lengths > 2) | marked
    gids, firsts, members, seen = [np.full(len(pairs), -1, dtype=np.int64)], [pairs[:, 0]], [pairs[:, 1]], set()
    own = _gid((np.int64(bucket).astype(np.uint64) << np.uint64(32)) | keys[begins].astype(np.uint64)).tolist()
    for at, n, is_hot, key in zip(begins[big].tolist(), lengths[big].tolist(), marked[big].tolist(), [own[i] for i in np.flatnonzero(big)], strict=True):
        run = nodes[at : at + n]
        gid = key if is_hot else int.from_bytes(blake2b(run.tobytes(), digest_size=8).digest(), "little") >> 2
        if gid not in seen:
            seen.add(gid)
            gids.append(np.full(n, gid, dtype=np.int64))
            firsts.append(np.full(n, run[0]))
            members.append(run)
    return np.concatenate(gids), np.concatenate(firsts), np.concatenate(members)

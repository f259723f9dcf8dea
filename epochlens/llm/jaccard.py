"""N-gram Jaccard self-join by PartEnum signatures.

Sets of 5-word shingles link where the Jaccard similarity is at least 0.75, so sets of sizes a and b differ in at most
(a + b) / 7 elements. Sizes fall into bands; an instance joins a band with itself and the one below, since linked sizes are within 4/3 of each
other. Each instance partitions the feature domain by hash. Two linked sets differ in at most k parts, so when each gives its first
k + 1 non-empty parts in a common order, they share one: that part's content is the signature. Any common order is right; parts made
only of very frequent shingles come last, so that shared passages make few candidates. A set with too few parts for
k + 1 signatures also gives single elements in the same manner, which are always enough.

Equal sets are joined first and one stands for all. Signatures travel packed, by bucket; equal signatures give candidate groups, which
``components.link_classes`` verifies by the exact sets.

Defined cases: null or empty text has the empty set and links with nothing; a text of fewer than five words has one element; rows
equal in id and text count as one node, rows with the same id and other texts as nodes of their own; a null id is its own class, null; an empty table gives no rows; other columns are
ignored. Texts are taken whole.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, gathered, join_sized, mix64, saved, saved_alone, slices, small_batches, trim
from .components import PACKED, fold, key_groups, link_classes, pack_keys
from .shingles import shingle_sets

NUM, DEN = 3, 4  # similarity 0.75
#: At most so many of the most frequent shingles are known to all tasks; they only change the order of parts.
HEAVY = 65_536
#: Signatures of one bucket, about.
BUCKET = 1 << 19
PARTS_PER_SIZE = 0.42


def _bands() -> np.ndarray:
    """Smallest size of each band; a band reaches to double its smallest size."""
    return np.array([1 << i for i in range(41)], dtype=np.int64)


BANDS = _bands()


def most_different(a, b):
    """Largest symmetric difference of linked sets of sizes a and b; negative if none can link."""
    a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
    return np.where(DEN * np.minimum(a, b) >= NUM * np.maximum(a, b), (a + b) // 7, -1)


def signatures(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """All signatures of one non-empty set, 64-bit, over its instances."""
    n = len(s)
    band = int(np.searchsorted(BANDS, n, side="right")) - 1
    rare = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] != s if len(heavy) else np.ones(n, dtype=bool)
    out = []
    for instance in (band, band + 1):
        top = int(BANDS[instance + 1]) - 1
        if instance > band and n * DEN < int(BANDS[instance]) * NUM:
            continue  # nothing in the band above is close enough in size
        k = (n + min(top, n * DEN // NUM)) // 7
        parts = max(1, int(PARTS_PER_SIZE * top))
        salt = np.uint64(instance + 1) * np.uint64(0xD6E8FEB86659FD93 & 0xFFFFFFFF)
        h = mix64(s ^ salt)
        # Small numbers sort faster.
        part = (h % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        # Content of a part: the sum of its elements' hashes, with its number.
        order = np.argsort(part, kind="stable")
        ordered = part[order]
        begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        content = np.add.reduceat(mix64(h)[order], begins)
        some_rare = np.logical_or.reduceat(rare[order], begins)
        sig = mix64(content ^ mix64(ordered[begins].astype(np.uint64) + salt))
        if len(sig) > k:
            out.append(_first(sig, some_rare, k + 1))
        else:
            out.append(sig)
            out.append(_first(mix64(h + np.uint64(7)), rare, k + 1))
    return np.concatenate(out)


def _first(sig: np.ndarray, rare: np.ndarray, k: int) -> np.ndarray:
    """The first k in the common order: rare ones by hash, then the others by hash."""
    front = sig[rare]
    if len(front) > k:
        return np.partition(front, k - 1)[:k]
    back = sig[~rare]
    need = k - len(front)
    return np.concatenate([front, np.sort(back)[:need]]) if need else front


def sketch(s: np.ndarray) -> bytes:
    """Parity of the elements' counts in about two bits an element; its distance never exceeds the sets' difference."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    flat = np.bincount((mix64(s + np.uint64(99)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flat.astype(np.uint8), bitorder="little").tobytes()


def _describe(batches):
    """Per document the size and digest of its set; per slice the shingles that are frequent in it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("shingle", pa.int64()), ("sketch", pa.binary()), ("text_hash", pa.int64())])
    for batch in slices(batches, rows=2048, max_bytes=8 << 20):
        sets = shingle_sets(byte_values(batch.column(1)))
        digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        ids = batch.column(0).to_pylist()
        rows = [(i, len(s), d, None, sketch(s), t) for i, s, d, t in zip(ids, sets, digests, batch.column(2).to_pylist(), strict=True)]
        distinct = list({d: s for d, s in zip(digests, sets, strict=True)}.values())
        least = max(4, len(distinct) // 128)
        # Each shingle that a slice holds often is told once per slice, with its count.
        every = np.sort(np.concatenate([*distinct, np.zeros(0, dtype=np.uint64)]))
        begins = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.r_[begins, len(every)])
        often = counts >= least
        rows += [(None, int(c), None, int(v), None, None) for v, c in zip(every[begins[often]].view(np.int64), counts[often], strict=True)]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _pack(heavy: np.ndarray, buckets: int):
    """Documents -> packed signatures."""

    def run(batches):
        for batch in gathered(batches, rows=4096, max_bytes=16 << 20):
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            texts = byte_values(batch.column(1))
            sigs, at = [], []
            for begin in range(0, len(texts), 256):
                for i, s in enumerate(shingle_sets(texts[begin : begin + 256]), begin):
                    if len(s):
                        sigs.append(signatures(s, heavy))
                        at.append(np.full(len(sigs[-1]), i, dtype=np.int64))
            if sigs:
                yield pack_keys(np.concatenate(sigs), np.concatenate(at), ids, buckets)

    return run


def _with_sets(texts: DataFrame, nodes: DataFrame, schema: str, make) -> DataFrame:
    """``make(set)`` for each node, from its text."""

    def run(batches):
        names = ["node", *(x.split()[0] for x in schema.split(", ")[1:])]
        for batch in slices(batches):
            rows = [make(s) for s in shingle_sets(byte_values(batch.column(1)))]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    types = [{"binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")[1:]]
    picked = join_sized(texts, nodes, ["node"], "left_semi", 32)
    return picked.mapInArrow(run, schema)


def _check_sketches(batches):
    """Pairs whose sketches differ in no more than linked sets may."""
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        most = most_different(batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()).tolist()
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)):
            if most[i] >= 0:
                x, y = np.frombuffer(x, dtype=np.uint64)[None, :], np.frombuffer(y, dtype=np.uint64)[None, :]
                words = min(x.shape[1], y.shape[1])
                if int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum()) <= most[i]:
                    keep.append(i)
        yield pa.record_batch([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])


def _check_pairs(batches):
    for batch in batches:
        a, b, keep_a, keep_b = batch.column("a").to_pylist(), batch.column("b").to_pylist(), [], []
        for i, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            if DEN * min(len(x), len(y)) >= NUM * max(len(x), len(y)):
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if DEN * common >= NUM * (len(x) + len(y) - common):
                    keep_a.append(a[i])
                    keep_b.append(b[i])
        yield pa.record_batch([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], ["a", "b"])
    trim()


def _nodes_of_repeated_ids(described: DataFrame) -> DataFrame | None:
    """doc_id, text_hash, node for texts that share an id with another; the first text of an id has the id as its node."""
    own = described.filter("digest is not null and doc_id is not null")
    again = saved(own.groupBy("doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).filter("low <> high"), "repeated-ids")
    n = again.count()
    if not n:
        return None
    others = join_sized(own.select("doc_id", "text_hash"), again, ["doc_id"], "inner", 48, n).filter("text_hash <> low").select("doc_id", "text_hash").distinct()
    return saved(others.withColumn("node", F.xxhash64("doc_id", "text_hash")), "repeated-nodes")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """doc_id, text_hash, node, n_shingles, component (a node), n_links per document, and whether ids have several texts."""
    small_batches(docs)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.xxhash64(docs[text_col].cast("string")).alias("text_hash"))
    described = saved(texts.mapInArrow(_describe, "doc_id long, n_shingles long, digest binary, shingle long, sketch binary, text_hash long"), "described")
    others = _nodes_of_repeated_ids(described)
    if others is None:
        described, texts = (df.withColumn("node", F.col("doc_id")) for df in (described, texts))
    else:
        n = others.count()
        described, texts = (join_sized(df, others, ["doc_id", "text_hash"], "left", 48, n).withColumn("node", F.coalesce("node", "doc_id")) for df in (described, texts))
    texts = texts.select("node", "text")
    members = described.filter("digest is not null").drop("shingle", "sketch")
    # Bounded by HEAVY numbers of eight bytes.
    heavy = np.sort(np.array([r[0] for r in described.filter("shingle is not null").groupBy("shingle").agg(F.sum("n_shingles").alias("n")).orderBy(F.desc("n"), "shingle").limit(HEAVY).select("shingle").collect()], dtype=np.int64).view(np.uint64))
    # Equal sets: the smallest node stands for all. Only digests seen twice need a join.
    sets = members.filter("node is not null and n_shingles > 0").groupBy("digest").agg(F.min("node").alias("rep"), F.max("node").alias("top"), F.first("n_shingles").alias("n"))
    sets = saved(sets, "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    twice = saved(sets.filter("rep <> top").select("digest", "rep"), "twice")
    placed = saved(join_sized(members, twice, ["digest"], "left", 96).select("doc_id", "text_hash", "node", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "node")).otherwise(F.col("node")).alias("rep")), "placed")
    copies = saved(placed.filter("rep <> node").select("node").distinct(), "copies")
    firsts = join_sized(texts.filter("node is not null"), copies, ["node"], "left_anti", 32)
    buckets = max(1, int(0.5 * total) // BUCKET + 1)
    groups = saved(key_groups(firsts.mapInArrow(_pack(heavy, buckets), PACKED)), "groups")

    sketched = described.filter("digest is not null and node is not null").select("node", F.col("n_shingles").alias("size"), "sketch")

    def verify(pairs: DataFrame) -> DataFrame:
        # Sketches are a small part of the sets, so only pairs that pass them are held against the sets.
        with_a = pairs.join(sketched.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a")), "a")
        with_b = with_a.join(sketched.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b")), "b")
        near = saved(with_b.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_check_sketches, "a long, b long").distinct(), "near")
        nodes = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        sets_of = _with_sets(texts, saved(nodes, "nodes"), "node long, set binary", lambda s: (s.tobytes(),))
        with_a = near.join(sets_of.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        with_b = with_a.join(sets_of.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        return with_b.select("a", "b", "set_a", "set_b").mapInArrow(_check_pairs, "a long, b long").distinct()

    def sketches(nodes: DataFrame) -> DataFrame:
        return sketched.join(nodes, "node").dropDuplicates(["node"])

    def tokens(nodes: DataFrame) -> DataFrame:
        # Linked sets share at least NUM / DEN of each.
        return _with_sets(texts, nodes, "node long, tokens array<long>, take int", lambda s: (s.view(np.int64).tolist(), len(s) - -(-NUM * len(s) // DEN) + 1)).dropDuplicates(["node"])

    links, comps = link_classes(groups, verify, sketches, most_different, tokens)
    n_links = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    found = saved(comps.withColumnRenamed("node", "rep").join(n_links, "rep", "left"), "found")
    out = join_sized(placed, found, ["rep"], "left", 64)
    return out.select("doc_id", "text_hash", "node", "n_shingles", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), others is not None


def _first_of_each(classes: DataFrame) -> DataFrame:
    """The smallest id of each component and its node."""
    return classes.filter("node is not null").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (verified links found for its set)."""
    classes, several = _classes(docs, id_col, text_col)
    if several:
        classes = saved(classes, "classes")
        classes = classes.join(_first_of_each(classes), "component", "left").withColumn("component", F.col("first.doc_id"))
    return classes.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "n_links")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the first of their class; of rows equal in id and text one stays; null ids stay."""
    on, repeated = [id_col], False

    def gone() -> DataFrame:
        nonlocal on, repeated
        classes, several = _classes(docs, id_col, text_col)
        classes = saved(classes, "classes")
        ids = classes.filter("doc_id is not null")
        repeated = not ids.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
        if not several:
            return classes.filter("component <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
        on = [id_col, "__text_hash"]
        left = classes.join(_first_of_each(classes), "component").filter("node <> first.node")
        return left.select(F.col("doc_id").alias(id_col), F.col("text_hash").alias("__text_hash")).distinct()

    # Only what goes is kept on disk, not the tables that it was found with.
    found = saved_alone(docs.sparkSession, gone, "gone")
    named = docs.withColumn("__text_hash", F.xxhash64(docs[text_col].cast("string")))
    kept = join_sized(named, found, on, "left_anti", 48).select(*docs.columns, "__text_hash")
    if not repeated:
        return kept.select(*docs.columns)
    again = kept[id_col].isNotNull()
    return kept.filter(~again).unionByName(kept.filter(again).dropDuplicates([id_col, "__text_hash"])).select(*docs.columns)


#: DuckDB SQL for the classes over ``{docs}``, by counting common shingles of all pairs.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || '  ' || len(w)] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN m ON m.a = w.doc_id
"""

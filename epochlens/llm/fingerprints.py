"""Near-duplicate classes of SimHash fingerprints, by pigeonring filtering.

A fingerprint has 64 bits: each is 1 if more than half of the text's 3-word shingles, repeats included, have it set in their 64-bit hash. Two texts link where their
fingerprints differ in at most ``DISTANCE`` bits.

The bits lie on a ring of ``SEGMENTS`` segments. If two fingerprints differ in t bits, then the segments from some place on keep within their share throughout: the first differs in at
most t / m bits, the first two together in at most 2 t / m, and so on around the ring (pigeonring: Qin and Xiao, VLDB 2018). With three bits and four segments such a chain begins
with an equal segment, followed by one that differs in at most one bit. So each fingerprint enters, for each of the four places, the pair of its segments as it is and the sixteen pairs whose second segment
differs in one bit: linked fingerprints share a key. Keys have 32 bits of the fingerprint. Candidates must then have a chain of three segments that keeps within its budgets, and only those
that do are compared over all 64 bits.

Equal fingerprints are one node, so copies make no pairs. Keys travel packed, and what shares a key is a candidate group, never expanded into all its pairs (``components.link_classes``): members are first
compared with the group's smallest, then only across the classes that this leaves. Links are exact: no fingerprint is left out.

Defined cases: a text of one or two words is one shingle; null, empty and blank texts have the fingerprint zero and link like any other; rows with equal ids are rows
of their own; a row with a null id belongs to its class and gets its smallest id, which is null only if the class has none; an empty table gives no rows; other columns are
ignored. Texts are taken whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, join_sized, mix64, saved, slices, small_batches
from .components import PACKED, key_groups, link_classes, pack_keys

WORDS, SEED, BITS = 3, 42, 64
DISTANCE, SEGMENTS, CHAIN = 3, 4, 3
WIDTH = BITS // SEGMENTS
#: Bits that the first l segments of a chain may differ in together.
BUDGETS = [length * DISTANCE // SEGMENTS for length in range(1, SEGMENTS + 1)]
#: Hashes that are counted at once, and keys of one bucket, about.
BLOCK, BUCKET = 1 << 15, 1 << 19
KEYS = SEGMENTS * (1 + WIDTH)


def fingerprint(text: bytes) -> int:
    """The text's fingerprint, unsigned."""
    words = text.lower().split()  # of bytes: A-Z only, and split at the six ASCII blanks
    if not words:
        return 0
    joined, take = b" ".join(words), min(WORDS, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    counts, total = np.zeros(BITS, dtype=np.int64), len(words) - take + 1
    starts, ends = starts[:total].tolist(), ends[take - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, total, BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and its fingerprint as a long (the same 64 bits)."""
    small_batches(docs)

    def run(batches):
        for batch in slices(batches):
            prints = np.array([fingerprint(t) for t in byte_values(batch.column(1))], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def chain_keys(prints: np.ndarray) -> np.ndarray:
    """(n, KEYS) keys of fingerprints: at each place a segment and the next, as it is and with one bit changed."""
    x, out = prints.view(np.uint64), []
    for place in range(SEGMENTS):
        turned = x if place == 0 else (x >> np.uint64(WIDTH * place)) | (x << np.uint64(BITS - WIDTH * place))
        pair = turned & np.uint64((1 << 2 * WIDTH) - 1)
        own = np.uint64(place << 2 * WIDTH)
        out.append(pair | own)
        out += [(pair ^ np.uint64(1 << bit)) | own for bit in range(WIDTH, 2 * WIDTH)]
    return mix64(np.stack(out, axis=1))


def block_tokens(prints: np.ndarray) -> np.ndarray:
    """(n, 20) tokens: of six blocks of bits any three. Fingerprints that differ in three bits have three blocks in common."""
    x, edges = prints.view(np.uint64), np.linspace(0, BITS, 7).round().astype(int)
    out = []
    for k, chosen in enumerate(combinations(range(6), 6 - DISTANCE)):
        mask = sum(((1 << int(edges[b + 1] - edges[b])) - 1) << int(edges[b]) for b in chosen)
        out.append(mix64(mix64(x & np.uint64(mask)) + np.uint64(k + 1)))
    return np.stack(out, axis=1).view(np.int64)


def on_a_chain(differ: Column) -> Column:
    """Whether from some segment on the bits set in ``differ`` stay within the budget of each chain of up to ``CHAIN`` segments."""
    segments = [F.bit_count(differ.bitwiseAND(F.lit(_signed(((1 << WIDTH) - 1) << WIDTH * s)))) for s in range(SEGMENTS)]
    viable = F.lit(False)
    for first in range(SEGMENTS):
        total, within = segments[first], segments[first] <= BUDGETS[0]
        for length in range(2, CHAIN + 1):
            total = total + segments[(first + length - 1) % SEGMENTS]
            within = within & (total <= BUDGETS[length - 1])
        viable = viable | within
    return viable


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pack(buckets: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 14):
                nodes = np.asarray(batch.column(0).slice(k, 1 << 14).to_numpy(zero_copy_only=False), dtype=np.int64)
                keys = chain_keys(nodes)
                yield pack_keys(keys.reshape(-1), np.repeat(np.arange(len(nodes)), KEYS), nodes, buckets)

    return run


def _tokens(batches):
    for batch in batches:
        tokens = block_tokens(np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64))
        yield pa.record_batch([batch.column(0), pa.array(list(tokens), pa.list_(pa.int64())), pa.array(np.full(len(tokens), tokens.shape[1], dtype=np.int32))], ["node", "tokens", "take"])


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """``prints``: doc_id, fingerprint -> the rows with component_id, the smallest doc_id of their class, and n_links, the links of the fingerprint that were verified."""
    prints = saved(prints, "prints")
    nodes = saved(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "nodes")
    n = nodes.count()
    packed = nodes.select("fingerprint").repartition("fingerprint").mapInArrow(_pack(max(1, n * KEYS // BUCKET + 1)), PACKED)
    groups = saved(key_groups(packed), "groups")

    def verify(pairs: DataFrame) -> DataFrame:
        differ = F.col("a").bitwiseXOR(F.col("b"))
        return pairs.select("a", "b").distinct().filter(on_a_chain(differ)).filter(F.bit_count(differ) <= DISTANCE)

    def sketches(of: DataFrame) -> DataFrame:
        return of.withColumns({"size": F.lit(BITS).cast("long"), "sketch": F.unhex(F.lpad(F.hex("node"), 16, "0"))})

    def tokens(of: DataFrame) -> DataFrame:
        return of.select("node").mapInArrow(_tokens, "node long, tokens array<long>, take int")

    links, comps = link_classes(groups, verify, sketches, lambda size, sizes: np.full(np.shape(sizes), DISTANCE), tokens, inline=True)
    n_links = links.select(F.col("a").alias("fingerprint")).unionByName(links.select(F.col("b").alias("fingerprint"))).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_links"))
    # Fingerprints without links are classes of their own.
    placed = saved(comps.withColumnRenamed("node", "fingerprint").join(nodes, "fingerprint"), "placed")
    lows = placed.groupBy("component").agg(F.min("low").alias("class_low"))
    linked = placed.join(lows, "component").join(n_links, "fingerprint", "left").select("fingerprint", "class_low", "n_links")
    every = saved(nodes.join(linked, "fingerprint", "left").select("fingerprint", F.when(F.col("n_links").isNull(), F.col("low")).otherwise(F.col("class_low")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return join_sized(prints, every, ["fingerprint"], "inner", 48, n).select("doc_id", "fingerprint", "component_id", "n_links")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id, n_links."""
    classes = fingerprint_classes(fingerprints(docs, id_col, text_col))
    return classes.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))

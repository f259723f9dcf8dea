"""Line dedup by a segment-partition edit join.

Lines are compared without the blanks around them. Equal lines form classes, and so do lines within a number of edits of each
other: one for each ``STEP`` code points of the shorter line, ``EDITS`` at most (none for the shortest lines, which are only joined when
equal). The first line of a class, by document id and line number, stays and the others go. Blank lines stay.

A line that allows k edits is cut into k + 1 segments, so a line within the threshold holds one of them unchanged. Each line gives, for its own
length and the shorter ones in reach, the substrings that can match a segment of that length's partition (the multi-match-aware
positions), hashed with length and segment number. Lines that share one are a candidate group. Groups go through
``components.link_classes`` with a parity sketch of their trigrams (an edit changes at most three on either side), and pairs that pass are verified by banded bit-parallel edit distance, many pairs at a time.

Defined cases: null text has one blank line; lines of any length are compared whole; a row is known by its id and a digest of its
text, so rows equal in both count as one document and others with the same id, or without one, are documents of their own; null ids come last; an empty table gives no rows; other columns are kept by ``drop_repeated_lines`` and ignored otherwise.
Lines are equal where 127 bits of their BLAKE2 digest are; 63 of these name a line in the near join, which compares the texts themselves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, join_sized, mix64, saved, saved_alone, slices, small_batches, trim
from .components import PACKED, key_groups, link_classes, pack_keys

EDITS, STEP, SKETCH_BITS, GRAM = 2, 20, 256, 3
BUCKET = 1 << 19
NO_ID = (1 << 63) - 1
_P = 0x9E6C63D0876A9A9D | 1
_PINV = pow(_P, -1, 1 << 64)
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = n + n // 8 + 1
        with np.errstate(over="ignore"):
            _tables[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(p), dtype=np.uint64)], dtype=np.uint64) for p in (_P, _PINV)]
    return _tables[0], _tables[1]


@dataclass(frozen=True)
class Reach:
    """How many edits may part two lines: one for each ``step`` code points of the shorter, ``most`` (3 at most) in all."""

    most: int = EDITS
    step: int = STEP

    def __post_init__(self) -> None:
        if not 0 <= self.most <= 3 or self.step < 4:
            raise ValueError("up to three edits, one in four code points at most")

    def edits(self, length):
        return np.minimum(self.most, np.asarray(length, dtype=np.int64) // self.step)

    def most_different(self, a, b):
        """Largest difference of the sketches of lines of lengths a and b; negative if the lengths rule a link out."""
        a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
        k = self.edits(np.minimum(a, b))
        return np.where((np.abs(a - b) <= k) & (k > 0), 2 * GRAM * k, -1)


def line_ids(lines: list[str]) -> np.ndarray:
    """Two non-negative longs for each line, from its digest."""
    digests = b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines)
    return (np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2) >> np.uint64(1)).astype(np.int64)


class Lines:
    """Lines of some documents, trimmed, with fingerprints of their substrings by code point."""

    def __init__(self, lines: list[str]) -> None:
        self.lengths = np.array([len(x) for x in lines], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)
        self.codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.sums = self.inverse = None

    def prints(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of substrings; they only make candidates."""
        with np.errstate(over="ignore"):
            if self.sums is None:
                powers, self.inverse = _powers(len(self.codes) + 1)
                self.sums = np.zeros(len(self.codes) + 1, dtype=np.uint64)
                np.cumsum((self.codes.astype(np.uint64) + np.uint64(0x51ED27)) * powers[: len(self.codes)], out=self.sums[1:])
            return mix64((self.sums[end] - self.sums[begin]) * self.inverse[begin])

    def grams(self) -> np.ndarray:
        m = max(0, len(self.codes) - GRAM + 1)
        gram = np.zeros(m, dtype=np.uint32)
        with np.errstate(over="ignore"):
            for k, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                gram += self.codes[k : k + m] * np.uint32(factor)
            gram ^= gram >> np.uint32(15)
            return gram * np.uint32(0x27D4EB2F)

    def sketches(self) -> list[bytes]:
        """The parity of the counts of each line's hashed trigrams."""
        gram = self.grams()
        sizes = np.maximum(self.lengths - GRAM + 1, 0)
        begins = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(of)) + (self.starts - begins)[of]
        counts = np.bincount(of * SKETCH_BITS + (gram[at] >> np.uint32(24)), minlength=len(sizes) * SKETCH_BITS)
        packed, size = np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes(), SKETCH_BITS // 8
        return [packed[i * size : i * size + size] for i in range(len(sizes))]


def gram_tokens(line: str) -> list[int]:
    """The line's trigrams, repeated ones told apart by their count."""
    seen: dict[int, int] = {}
    gram = Lines([line]).grams().tolist()
    for i, g in enumerate(gram):
        seen[g] = n = seen.get(g, 0) + 1
        gram[i] = g << 24 | min(n, (1 << 24) - 1)
    return gram


REACH = Reach()


def split_lines(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Trimmed lines of all texts and how many each text has."""
    lines, counts = [], []
    for t in texts:
        own = (t or "").split("\n")
        counts.append(len(own))
        lines += [x.strip() for x in own]
    return lines, np.array(counts, dtype=np.int64)


def segments(length: np.ndarray, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` of the k + 1 of lines of ``length``; later segments are the longer ones."""
    base, more = length // (k + 1), length % (k + 1)
    short = k + 1 - more
    return i * base + np.maximum(0, i - short), base + (i >= short)


def signatures(text: Lines, picked: np.ndarray, reach: Reach) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the picked lines, and the index of the line of each."""
    sigs, of = [np.zeros(0, dtype=np.uint64)], [picked[:0]]
    with np.errstate(over="ignore"):
        for delta in range(reach.most + 1):
            # Lines that are longer by ``delta`` than one that allows ``k`` edits.
            allowed = reach.edits(text.lengths[picked] - delta)
            for k in range(max(1, delta), reach.most + 1):
                mine = picked[(allowed == k) & (text.lengths[picked] > delta)]
                start, n = text.starts[mine], text.lengths[mine]
                length = n - delta
                for i in range(k + 1):
                    at, size = segments(length, i, k)
                    # Edits before the segment number at most i, and those after it at most k - i.
                    for shift in range(max(-i, delta - (k - i)), min(i, delta + k - i) + 1):
                        begin = at + shift
                        ok = (begin >= 0) & (begin + size <= n)
                        b = (start + begin)[ok]
                        tag = mix64(length[ok].astype(np.uint64) * np.uint64(8) + np.uint64(i))
                        sigs.append(mix64(text.prints(b, b + size[ok]) + tag))
                        of.append(mine[ok])
    return np.concatenate(sigs), np.concatenate(of)


def edit_within(a: list[np.ndarray], b: list[np.ndarray], k: int) -> np.ndarray:
    """Whether each pair of code point arrays is within ``k`` edits, for k up to 3: banded bit-parallel columns, all pairs at once.

    The highest of eight bits is the lowest row of the band. The value on the band's lowest diagonal is followed to the last row, and along that row to the end.
    """
    m, n = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
    out = np.abs(m - n) <= k
    short = np.minimum(m, n) <= 2 * k
    for i in np.flatnonzero(out & short):
        out[i] = _edit(a[i].tolist(), b[i].tolist()) <= k
    live = np.flatnonzero(out & ~short)
    if not len(live):
        return out
    m, n = m[live], n[live]
    width = int(n.max())
    pattern = np.full((len(live), int(max(m.max(), n.max())) + 2 * k + 2), 0xFFFFFFFE, dtype=np.uint32)
    subject = np.full((len(live), width), 0xFFFFFFFF, dtype=np.uint32)
    for row, i in enumerate(live):
        pattern[row, k : k + len(a[i])] = a[i]
        subject[row, : len(b[i])] = b[i]
    u8 = np.uint8
    vp = np.full(len(live), (0xFF << (7 - k)) & 0xFF, dtype=u8)
    vn = np.zeros(len(live), dtype=u8)
    value = np.full(len(live), k, dtype=np.int64)
    row_bit = np.full(len(live), 6, dtype=np.int64)
    for j in range(width):
        match = np.zeros(len(live), dtype=u8)
        for d in range(2 * k + 1):
            match |= (pattern[:, j + d] == subject[:, j]).astype(u8) << u8(7 - 2 * k + d)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn).astype(u8)
        hp = (vn | ~(d0 | vp)).astype(u8)
        hn = d0 & vp
        diagonal = j < m - k
        going = (~diagonal) & (j < n)
        value += diagonal & ((d0 >> u8(7)) == 0)
        bit = np.maximum(row_bit, 0).astype(u8)
        value += going * (((hp >> bit) & u8(1)).astype(np.int64) - ((hn >> bit) & u8(1)).astype(np.int64))
        row_bit -= going
        vp = (hn | ~((d0 >> u8(1)) | hp)).astype(u8)
        vn = (d0 >> u8(1)) & hp
    out[live] = value <= k
    return out


def _edit(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _describe(batches):
    """A row for each line that is not blank: document (id and digest), number, its two ids and its length."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("line_no", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), ("n", pa.int32())])
    for batch in slices(batches, rows=2048, max_bytes=4 << 20):
        docs, digests, numbers, lines, counts = *(np.asarray(c.to_numpy(), dtype=np.int64) for c in (batch.column(0), batch.column(2))), [], [], []
        for text in batch.column(1).to_pylist():
            before = len(lines)
            for i, line in enumerate((text or "").split("\n")):
                if line := line.strip():
                    numbers.append(i)
                    lines.append(line)
            counts.append(len(lines) - before)
        ids = line_ids(lines)
        columns = np.repeat(docs, counts), np.repeat(digests, counts), np.array(numbers, dtype=np.int32), ids[:, 0], ids[:, 1], np.fromiter(map(len, lines), dtype=np.int32, count=len(lines))
        yield pa.record_batch([*map(pa.array, columns)], schema=schema)


def _pack(buckets: int, reach: Reach):
    """Documents -> packed signatures of their distinct lines."""

    def run(batches):
        for batch in gathered(batches, rows=4096, max_bytes=4 << 20):
            lines, _ = split_lines(batch.column(1).to_pylist())
            lines = list(dict.fromkeys(x for x in lines if len(x) >= reach.step))
            if lines:
                text = Lines(lines)
                sig, of = signatures(text, np.arange(len(lines)), reach)
                yield pack_keys(sig, of, line_ids(lines)[:, 0], buckets)

    return run


def _check_sketches(reach: Reach):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            ok = np.bitwise_count(a ^ b).sum(axis=1) <= reach.most_different(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _check_pairs(reach: Reach):
    def run(batches):
        for batch in batches:
            for piece in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                a, b = ([np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in piece.column(c).to_pylist()] for c in ("line_a", "line_b"))
                allowed = reach.edits([min(len(x), len(y)) for x, y in zip(a, b, strict=True)])
                ok = np.zeros(len(a), dtype=bool)
                for k in range(1, reach.most + 1):
                    own = np.flatnonzero(allowed == k)
                    if len(own):
                        ok[own] = edit_within([a[i] for i in own], [b[i] for i in own], k)
                yield piece.select(["a", "b"]).filter(pa.array(ok))
        trim()

    return run


def _line_texts(batches):
    """Lines by their numbers, with length and sketch."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary()), ("line", pa.string())])
    for batch in slices(batches, rows=2048):
        nodes, lines = [], []
        for t, numbers, hs in zip(*(batch.column(c).to_pylist() for c in ("text", "numbers", "hs")), strict=True):
            own = (t or "").split("\n")
            lines += [own[i].strip() for i in numbers]
            nodes += hs
        text = Lines(lines)
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(text.lengths), pa.array(text.sketches(), pa.binary()), pa.array(lines, pa.string())], schema=schema)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: Reach = REACH) -> DataFrame:
    """doc_id (``NO_ID`` for null) and digest of each row, and the numbers of its lines that go, with those that only resemble the line that stays."""
    small_batches(docs)
    row_id, digest = _row_key(docs, id_col, text_col)
    texts = docs.select(row_id.alias("doc_id"), docs[text_col].cast("string").alias("text"), digest.alias("digest"))
    lines = saved(texts.mapInArrow(_describe, "doc_id long, digest long, line_no int, h long, g long, n int"), "lines")
    first = F.struct("doc_id", "digest", "line_no", "n")
    firsts = saved(lines.groupBy("h", "g").agg(F.min(first).alias("f"), F.count(F.lit(1)).alias("c")).select("h", "g", "c", "f.*"), "first-lines")
    total = firsts.filter(F.col("n") >= reach.step).count()
    buckets = max(1, 12 * total // BUCKET + 1)
    groups = saved(key_groups(texts.mapInArrow(_pack(buckets, reach), PACKED)), "line-groups")
    # Of the lines that share a signature: length, sketch and text, from the first document that holds each.
    nodes = saved(groups.select(F.col("node").alias("h")).unionByName(groups.select(F.col("first").alias("h"))).distinct(), "nodes")
    n_nodes = nodes.count()
    places = join_sized(firsts.select("h", "doc_id", "digest", "line_no"), nodes, ["h"], "left_semi", 32, n_nodes)
    by_doc = saved(places.groupBy("doc_id", "digest").agg(F.collect_list("line_no").alias("numbers"), F.collect_list("h").alias("hs")), "places")
    picked = join_sized(texts, by_doc, ["doc_id", "digest"], "inner", 32, n_nodes).select("doc_id", "text", "digest", "numbers", "hs")
    own = picked.dropDuplicates(["doc_id", "digest"]) if _repeats(texts) else picked
    known = saved(own.mapInArrow(_line_texts, "node long, size long, sketch binary, line string"), "candidate-lines")

    def verify(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(known.select(F.col("node").alias("a"), F.col("size").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
        with_b = with_a.join(known.select(F.col("node").alias("b"), F.col("size").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
        near = saved(with_b.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_check_sketches(reach), "a long, b long"), "near-lines")
        with_a = near.join(known.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a")
        with_b = with_a.join(known.select(F.col("node").alias("b"), F.col("line").alias("line_b")), "b")
        return with_b.select("a", "b", "line_a", "line_b").mapInArrow(_check_pairs(reach), "a long, b long").distinct()

    def sketches(nodes: DataFrame) -> DataFrame:
        return known.join(nodes, "node").select("node", "size", "sketch")

    def tokens(nodes: DataFrame) -> DataFrame:
        schema = pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64())), ("take", pa.int32())])

        def run(batches):
            for batch in slices(batches):
                found = batch.column(1).to_pylist()
                yield pa.record_batch([batch.column(0), pa.array([gram_tokens(x) for x in found], pa.list_(pa.int64())), pa.array([GRAM * int(reach.edits(len(x))) + 1 for x in found], pa.int32())], schema=schema)

        return known.join(nodes, "node").select("node", "line").mapInArrow(run, "node long, tokens array<long>, take int").dropDuplicates(["node"])

    _, comps = link_classes(groups, verify, sketches, reach.most_different, tokens)
    place = F.struct("doc_id", "digest", "line_no")
    own = firsts.select("h", "g", "c", place.alias("at")).join(comps.withColumnRenamed("node", "h"), "h", "left")
    near = own.filter("component is not null")
    best = near.groupBy("component").agg(F.min("at").alias("keep"))
    classed = near.join(best, "component").select("h", "g", "keep", (F.col("keep") != F.col("at")).alias("is_near"))
    alone = own.filter("component is null and c > 1").select("h", "g", F.col("at").alias("keep"), F.lit(False).alias("is_near"))
    keep = saved(classed.unionByName(alone), "keep-lines")
    hit = join_sized(lines.select("doc_id", "digest", "line_no", "h", "g"), keep, ["h", "g"], "inner", 64)
    gone = hit.filter(place != F.col("keep"))
    return gone.groupBy("doc_id", "digest").agg(F.collect_set("line_no").alias("gone"), F.collect_set(F.when(F.col("is_near"), F.col("line_no"))).alias("near"))


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What a row is known by: its id, ``NO_ID`` for null, and a digest of its text."""
    return F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), F.xxhash64(docs[text_col].cast("string"))


def _repeats(texts: DataFrame) -> bool:
    """Whether rows repeat; then one of them stands for all."""
    return not texts.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()


def _with_gone(docs: DataFrame, id_col: str, text_col: str, reach: Reach) -> DataFrame:
    gone = saved_alone(docs.sparkSession, lambda: removed_lines(docs, id_col, text_col, reach), "gone").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("gone").alias("__gone"), F.col("near").alias("__near"))
    row_id, digest = _row_key(docs, id_col, text_col)
    rows = docs.withColumns({"__id": row_id, "__digest": digest})
    count = gone.agg(F.sum(F.size("__gone") + F.size("__near")), F.count(F.lit(1))).first()
    return join_sized(rows, gone, ["__id", "__digest"], "left", 1, (count[0] or 0) * 8 + (count[1] or 0) * 72)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: Reach = REACH) -> DataFrame:
    """One row per document: its lines, those that go, how many of them only resemble the one that stays, and the rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_near", pa.int64()), ("kept_chars", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in slices(batches, rows=2048):
            rows = []
            for doc, t, gone, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, out = (t or "").split("\n"), set(gone or ())
                kept = "\n".join(x for i, x in enumerate(own) if i not in out)
                rows.append((doc, len(own), len(out), len(near or ()), len(kept), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return _with_gone(rows, "doc_id", "text", reach).select("doc_id", "text", "__gone", "__near").mapInArrow(run, "doc_id long, n_lines long, n_removed long, n_near long, kept_chars long, kept_sha256 string")


def _without(batches, column: int):
    """Texts without the lines that go."""
    for batch in slices(batches, rows=2048, column=column):
        texts = []
        for t, gone in zip(batch.column(column).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if t is not None and gone:
                out = set(gone)
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out)
            texts.append(t)
        kept = pa.array(texts, batch.schema.field(column).type)
        yield pa.record_batch([kept if i == column else c for i, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", reach: Reach = REACH) -> DataFrame:
    """The documents without the lines that go; a null text stays null. ``chars_col``, where there, follows the text."""
    columns = docs.columns
    marked = _with_gone(docs, id_col, text_col, reach)
    at = columns.index(text_col)
    touched = marked.filter("__gone is not null").select(*columns, "__gone")
    changed = touched.mapInArrow(lambda batches: _without(batches, at), docs.schema)
    if chars_col in columns:
        changed = changed.withColumn(chars_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return marked.filter("__gone is null").select(*columns).unionByName(changed)

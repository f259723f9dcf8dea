"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere, by distributed prefix doubling.

Plain prefix doubling ranks every position of the corpus in every round. Here a rank is a 64-bit fingerprint of the string at a position,
so a pair of ranks at an offset needs no join, and only positions that can still matter take part:

1. Of the ``GRAM``-byte strings, only sampled ones are ranked: in each window of ``LENGTH`` bytes the smallest fingerprint, the
   rightmost of equal ones. Equal windows sample the same place, so a window can repeat only where its sample's rank does.
2. Windows are taken by their sample and by the offset to it, in steps of ``STEP``. The string that all windows of a step share and the
   string that spans them all are ranked. Where the first is unique nothing repeats; where the second repeats, all do.
3. What is left is ranked window by window, past the threshold.

In each round Spark groups the (rank, position) pairs by bucket, each bucket is sorted, and unique ranks drop out.
Pairs travel packed; a task sends a repeated rank once and settles the others itself, so a hot string is not gathered in full.
Equal texts are handled first and one stands for all: all windows of a text with copies repeat.

Defined cases: null text is empty; texts under ``LENGTH`` bytes keep all bytes; strings never cross documents; the string may
repeat in the same document, also overlapping; repeated rows and equal ids are copies like any other; null ids are rows of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, join_sized, mix64, saved, slices, small_batches

LENGTH, GRAM, STEP = 200, 50, 19
BUCKET_BYTES = 24 << 20
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PACKED = "bucket int, keys binary, places binary, docs binary"
FLAGS = "part int, settled int, places binary, docs binary"

_rng = np.random.default_rng(77003)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_P = int(_rng.integers(1, 1 << 62)) * 4 + 3
_PINV = pow(_P, -1, 1 << 64)
_tables: list[np.ndarray] = []
PLACE = np.dtype([("doc", "<u4"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1"), ("known", "u1"), ("pad", "u1")])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = n + n // 8 + 1
        with np.errstate(over="ignore"):
            _tables[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(p), dtype=np.uint64)], dtype=np.uint64) for p in (_P, _PINV)]
    return _tables[0], _tables[1]


class Text:
    """Some documents end to end, with fingerprints of any of their strings."""

    def __init__(self, texts: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.n = len(raw)
        powers, self.inverse = _powers(self.n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[raw] * powers[: self.n], out=self.sums[1:])

    def prints(self, begin, end) -> np.ndarray:
        """Fingerprints of the strings [begin, end)."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[begin]) * self.inverse[begin])


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys; none for no keys."""
    if not len(keys):
        return []
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
    return list(zip(begins, [*begins[1:], len(keys)], strict=True))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over all runs of ``width``."""
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def sample(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions in the joined texts: position, document, and the smallest and largest offset from a window's start."""
    none = np.zeros(0, dtype=np.int64)
    if text.n < LENGTH:
        return none, none, none, none
    width = LENGTH - GRAM + 1
    with np.errstate(over="ignore"):
        # The order only has to be the same everywhere; the raw fingerprint of the gram, mixed, gives it.
        g = mix64((text.sums[GRAM:] - text.sums[: text.n - GRAM + 1]) * text.inverse[: text.n - GRAM + 1])
    low = _sliding(g, width, np.minimum)
    valid = np.zeros(len(low), dtype=bool)
    for s, n in zip(text.starts.tolist(), text.lengths.tolist(), strict=True):
        if n >= LENGTH:
            valid[s : s + n - LENGTH + 1] = True
    low[~valid] = 0
    high = _sliding(np.r_[np.zeros(width - 1, dtype=np.uint64), low, np.zeros(width - 1, dtype=np.uint64)], width, np.maximum)
    at = np.flatnonzero((g == high[: len(g)]) & (high[: len(g)] > 0))
    doc = np.searchsorted(text.starts, at, side="right") - 1
    # A zero-length document starts where the next one does; take the one that holds the position.
    if not len(at):
        return none, none, none, none
    first = np.r_[True, doc[1:] != doc[:-1]]
    before = np.r_[0, at[:-1]]
    smaller = np.r_[False, g[at[1:]] <= g[at[:-1]]]
    begin = np.where(first, text.starts[doc], np.where(smaller, at - (width - 1), before + 1))
    begin = np.maximum.accumulate(begin)
    last = np.r_[first[1:], True]
    end = np.where(last, text.starts[doc] + text.lengths[doc] - LENGTH, np.r_[begin[1:], 0] - 1)
    used = end >= begin
    at, doc, begin, end = at[used], doc[used], begin[used], end[used]
    return at, doc, at - end, at - begin


def _pack(keys: np.ndarray, places: np.ndarray, ids: list[bytes], buckets: int, second: np.ndarray | None = None):
    """Rows of ``PACKED``. A key (with its second one, if any) that repeats here is sent once, as known; the rest goes to bucket -1."""
    whole = keys if second is None else mix64(keys + mix64(second))
    order = np.argsort(whole, kind="stable")
    ranked = whole[order]
    same = np.r_[False, ranked[1:] == ranked[:-1]]
    if second is not None:
        same &= second[order] != 0
    leads = np.flatnonzero(same & np.r_[True, ~same[:-1]]) - 1
    places["known"][order[leads]] = 1
    settled = np.zeros(len(keys), dtype=bool)
    settled[order[same]] = True
    bucket = ((mix64(keys ^ np.uint64(0x5BD1E995)) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    bucket[settled] = -1
    order = np.argsort(bucket, kind="stable")
    rows = []
    table = np.frombuffer(b"".join(ids), dtype="V16")
    for a, b in _runs(bucket[order]):
        part = order[a:b]
        used, local = np.unique(places["doc"][part], return_inverse=True)
        mine = places[part].copy()
        mine["doc"] = local
        k = keys[part] if second is None else np.column_stack([keys[part], second[part]])
        rows.append((int(bucket[part[0]]), np.ascontiguousarray(k).tobytes(), mine.tobytes(), table[used].tobytes()))
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("places", pa.binary()), ("docs", pa.binary())])
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _round_one(buckets: int):
    def run(batches):
        for batch in slices(batches, rows=4096, max_bytes=2 << 20):
            text = Text(byte_values(batch.column(1)))
            at, doc, lo, hi = sample(text)
            places = np.zeros(len(at), dtype=PLACE)
            places["doc"], places["pos"], places["lo"], places["hi"] = doc, at - text.starts[doc], lo, hi
            yield _pack(text.prints(at, at + GRAM), places, batch.column(0).to_pylist(), buckets)

    return run


def _steps(places: np.ndarray) -> np.ndarray:
    """A place for each step of offsets that a sampled position's windows fall into."""
    first, last = places["lo"] // STEP, places["hi"] // STEP
    n = (last - first + 1).astype(np.int64)
    out = np.repeat(places, n)
    step = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n))
    out["lo"] = np.maximum(out["lo"], step * STEP)
    out["hi"] = np.minimum(out["hi"], step * STEP + STEP - 1)
    return out


def _gather(batch):
    """Texts of a slice with the places that were flagged in them."""
    text = Text(byte_values(batch.column(1)))
    lists = batch.column(2).to_pylist()
    found = []
    for i, parts in enumerate(lists):
        p = np.frombuffer(parts, dtype=PLACE).copy()
        p["doc"] = i
        found.append(p)
    return text, np.concatenate([*found, np.zeros(0, dtype=PLACE)])


def _round_two(buckets: int):
    def run(batches):
        for batch in slices(batches, rows=4096, max_bytes=2 << 20):
            text, places = _gather(batch)
            places = _steps(places)
            start = text.starts[places["doc"]]
            at = start + places["pos"].astype(np.int64)
            x0 = (places["lo"] // STEP).astype(np.int64) * STEP
            x1 = x0 + STEP - 1
            core = mix64(text.prints(at - x0, at - x1 + LENGTH) + x0.astype(np.uint64))
            begin, end = at - x1, at - x0 + LENGTH
            inside = (begin >= start) & (end <= start + text.lengths[places["doc"]])
            span = np.where(inside, text.prints(np.maximum(begin, 0), np.minimum(end, text.n)) | np.uint64(1), np.uint64(0))
            places["known"] = 0
            yield _pack(core, places, batch.column(0).to_pylist(), buckets, span)

    return run


def _round_three(buckets: int):
    def run(batches):
        for batch in slices(batches, rows=4096, max_bytes=1 << 20):
            text, places = _gather(batch)
            n = places["hi"].astype(np.int64) - places["lo"] + 1
            out = np.repeat(places, n)
            offset = np.repeat(places["lo"], n) + (np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n))
            at = text.starts[out["doc"]] + out["pos"].astype(np.int64) - offset
            out["pos"] = at - text.starts[out["doc"]]
            out["lo"] = out["hi"] = 0
            yield _pack(text.prints(at, at + LENGTH), out, batch.column(0).to_pylist(), buckets)

    return run


def _emit(parts: int, *keep: tuple[np.ndarray, np.ndarray, int]) -> pa.Table:
    """Rows of ``FLAGS``: chosen places with their documents, dealt to ``parts`` by the documents' digests."""
    rows = []
    for places, docs, settled in keep:
        part = (docs.view(np.uint8).reshape(-1, 16)[:, :4].copy().view(np.uint32).ravel() % np.uint32(parts)).astype(np.int64)
        of = part[places["doc"]]
        order = np.argsort(of, kind="stable")
        for a, b in _runs(of[order]):
            mine = places[order[a:b]]
            used, local = np.unique(mine["doc"], return_inverse=True)
            mine["doc"] = local
            rows.append((int(of[order[a]]), settled, mine.tobytes(), docs[used].tobytes()))
    types = [("part", pa.int32()), ("settled", pa.int32()), ("places", pa.binary()), ("docs", pa.binary())]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(types)})


def _by_document(table: pa.Table) -> pa.Table:
    """One row per document, with all its places."""
    places, docs = _unpack(table)
    halves = docs.view(np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    fresh = np.r_[True, (halves[order][1:] != halves[order][:-1]).any(axis=1)]
    number = np.empty(len(docs), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    unique = docs[order[fresh]]
    of = number[places["doc"]]
    by = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(unique)))
    chosen = places[by]
    found = [chosen[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
    return pa.table({"k": pa.array([u.tobytes() for u in unique], pa.binary()), "places": pa.array(found, pa.binary())})


def _unpack(table: pa.Table):
    places, docs, shift = [], [], 0
    for p, d in zip(table.column("places").to_pylist(), table.column("docs").to_pylist(), strict=True):
        p = np.frombuffer(p, dtype=PLACE).copy()
        p["doc"] += shift
        docs.append(np.frombuffer(d, dtype="V16"))
        shift += len(docs[-1])
        places.append(p)
    return np.concatenate(places), np.concatenate(docs)


def _repeated(table: pa.Table, parts: int) -> pa.Table:
    """Places whose key another place has too; those sent as known count as two."""
    places, docs = _unpack(table)
    if table.column("bucket")[0].as_py() < 0:
        return _emit(parts, (places, docs, 0))
    keys = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist()])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    hit = places["known"][order].astype(bool)
    hit[1:] |= same
    hit[:-1] |= same
    return _emit(parts, (places[order[hit]], docs, 0))


def _repeated_steps(table: pa.Table, parts: int) -> pa.Table:
    """Settled steps, and those to be looked at window by window; of these, known ones repeat and stand for others."""
    places, docs = _unpack(table)
    if table.column("bucket")[0].as_py() < 0:
        return _emit(parts, (places, docs, 1))
    keys = np.concatenate([np.frombuffer(x, dtype=np.uint64).reshape(-1, 2) for x in table.column("keys").to_pylist()])
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    core, span, places = keys[order, 0], keys[order, 1], places[order]
    new_core = np.r_[True, core[1:] != core[:-1]]
    new_span = new_core | np.r_[True, span[1:] != span[:-1]] | (span == 0)
    whole = places["known"].astype(bool)
    whole[1:] |= ~new_span[1:]
    whole[:-1] |= ~new_span[1:]
    group = np.cumsum(new_core) - 1
    # Alone with its core: nothing to compare. All settled: nothing left to ask.
    mixed = (np.bincount(group, weights=~whole) > 0)[group] & (np.bincount(group) > 1)[group]
    single = mixed & (~whole | new_span)
    open_places = places[single].copy()
    open_places["known"] = whole[single]
    return _emit(parts, (places[whole].copy(), docs, 1), (open_places, docs, 0))


def _finish(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in slices(batches, rows=2048, max_bytes=8 << 20):
        rows = []
        for doc, data, copies, parts in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            n = len(data)
            if n < LENGTH or not (copies or parts):
                rows.append((doc, n, 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            if copies:
                rows.append((doc, n, n, 1, hashlib.sha256(b"").hexdigest()))
                continue
            p = np.frombuffer(parts, dtype=PLACE)
            edges = np.zeros(n + 1, dtype=np.int32)
            # A place covers windows from pos - hi to pos - lo, and each window LENGTH bytes.
            np.add.at(edges, p["pos"].astype(np.int64) - p["hi"], 1)
            np.add.at(edges, p["pos"].astype(np.int64) - p["lo"] + LENGTH, -1)
            gone = np.cumsum(edges[:n]) > 0
            kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            rows.append((doc, n, int(gone.sum()), int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes, bytes removed, maximal removed runs and digest of the rest."""
    small_batches(docs)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("k"), text.alias("text"))
    sizes = saved(texts.select("doc_id", "k", F.octet_length("text").cast("long").alias("n")).filter(F.col("n") >= LENGTH), "sizes")
    kinds = saved(sizes.groupBy("k").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("c"), F.first("n").alias("n")), "kinds")
    total = kinds.agg(F.sum("n")).first()[0] or 0
    copied = saved(kinds.filter("c > 1").select("k", F.lit(True).alias("copies"), "lead"), "copied")
    n_copied = copied.count()
    marked = join_sized(texts, copied, ["k"], "left", 96, n_copied)
    one = marked.filter((F.octet_length("text") >= LENGTH) & (F.col("lead").isNull() & F.col("copies").isNull() | F.col("lead").eqNullSafe(F.col("doc_id")))).select("k", "text")
    entries = total * 2 // (LENGTH - GRAM + 2)

    def buckets(n: int, size: int) -> int:
        return max(1, n * size // BUCKET_BYTES + 1)

    parts = max(1, entries * PLACE.itemsize // BUCKET_BYTES + 1)

    def by_document(found: DataFrame) -> DataFrame:
        return found.select("part", "places", "docs").groupBy("part").applyInArrow(_by_document, "k binary, places binary")

    def placed(found: DataFrame) -> DataFrame:
        """Texts with their flagged places; texts without any drop out. Always a shuffle: the places grow with the texts."""
        return one.join(by_document(found).hint("shuffle_merge"), "k").select("k", "text", "places")

    def ranked(packed: DataFrame, reduce) -> DataFrame:
        # Settled rows need no company; their buckets are spread by a second key.
        spread = packed.withColumn("spread", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("docs"), F.lit(1 << 20)).cast("int")).otherwise(0))
        return spread.groupBy("bucket", "spread").applyInArrow(lambda t: reduce(t, parts), FLAGS)

    def count(found: DataFrame) -> int:
        return (found.agg(F.sum(F.octet_length("places"))).first()[0] or 0) // PLACE.itemsize

    first = saved(ranked(one.mapInArrow(_round_one(buckets(entries, 20)), PACKED), _repeated), "round1")
    second = saved(ranked(placed(first).mapInArrow(_round_two(buckets(5 * count(first), 28)), PACKED), _repeated_steps), "round2")
    settled, single = second.filter("settled = 1"), second.filter("settled = 0")
    third = saved(ranked(placed(single).mapInArrow(_round_three(buckets(STEP * count(single), 20)), PACKED), _repeated), "round3")
    flags = by_document(settled.unionByName(third))
    out = marked.join(flags.hint("shuffle_merge"), "k", "left")
    return out.select("doc_id", "text", F.coalesce("copies", F.lit(False)).alias("copies"), "places").mapInArrow(_finish, SCHEMA)

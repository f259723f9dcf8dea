"""Benchmark decontamination by template canonicalisation.

Texts become tokens with typed placeholders: numbers (with their decimals and thousands, or as words), units after a number, and names
(capitalised words that begin no ordinary sentence, several in a row as one). Windows of ``WINDOW`` such tokens are hash-joined with those of
the benchmark. For each document, item and alignment, every value of the item must be replaced by one value of the
document throughout, else only windows without changes count; so a question with other numbers or names is caught, and a
text that only shares the template's shape is not. Two values may become the same one. A document leaks an item where the windows that count
cover at least ``min(MOST, SHARE of the item's tokens)`` of it, and at least ``WINDOW``.

Templates need half their tokens to be literal, and ``LEAST`` tokens. Besides, every window is joined by its lower-cased words themselves,
numbers, units and names included, so an exact copy is found whatever its words are and whatever its capitals and punctuation. An item
shorter than a window is one window by itself. Document windows are first tested against a bitmap of the benchmark's hashes while these are
few; beyond that all windows go to the join, with the same result.

Defined cases: null or empty texts leak nothing; texts of any length are taken whole; repeated rows and equal ids count as one document in
the pairs, where null ids are left out; the filter judges each row by its own text, whatever its id; an empty benchmark leaks nothing and
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import groupby, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, join_sized, mix64, saved, saved_alone, slices, small_batches
from .shingles import hash_runs

WINDOW, MOST, SHARE, LEAST = 8, 13, 0.6, 5
BITMAP_BITS, BITMAP_ROWS = 1 << 23, 1 << 20
# Units of measure and currency, as words.
UNITS = (
    "mm cm m km kilometers kilometres meters metres centimeters inches inch feet foot yards miles mile mg g kg grams gram kilograms pounds pound ounces lb lbs oz tons "
    "ml l liters litres liter litre gallons gallon seconds second minutes minute hours hour days day weeks week months month years year "
    "percent degrees dollars dollar cents cent euros euro usd eur mph kmh hz watts volts joules newtons"
).split()

# Numbers as words; those of the second line only go on a number that has begun.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion trillion dozen"
).split()
# Words that begin sentences and are no names, however they are written.
STARTERS = (
    "a about after all also although an and another any are as at be because before both but by can could did do does during each either else even every few find first for from given has have he her here his how however "
    "i if in is it its just last let many most much my name neither next no not now of on once only or other our out over she should since so some suppose than that the their then there these they this those through to under "
    "until up use was we were what when where whether which while who whom whose why will with would write yes you your calculate compute consider define describe determine evaluate explain list prove show solve state"
).split()

_WORD = np.zeros(256, dtype=bool)
for _c in range(256):
    _WORD[_c] = 48 <= _c <= 57 or 65 <= _c <= 90 or 97 <= _c <= 122 or _c >= 128
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(5501)
_PLACES = _rng.integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
NUMBER, UNIT, NAME = (np.uint64(x) for x in _rng.integers(1, 1 << 63, 3, dtype=np.uint64))


def _hashes_of(words: list[str]) -> np.ndarray:
    """Hashes of a word list, sorted."""
    lengths = np.array([len(u) for u in words], dtype=np.int64)
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]].astype(np.int64)
    return np.sort(hash_runs(np.frombuffer(" ".join(words).encode(), dtype=np.uint8), starts, lengths))


_LISTS = {name: _hashes_of(words) for name, words in (("unit", UNITS), ("number", NUMBER_WORDS), ("starter", STARTERS))}


def _among(words: np.ndarray, name: str) -> np.ndarray:
    known = _LISTS[name]
    return known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words


def _lowered(data: bytes) -> bytes:
    """Lower case with every character in its place; letters whose lower case has another length stay."""
    if data.isascii():
        return data.translate(_LOWER)
    text = data.decode("utf-8", "surrogatepass")
    low = text.lower().encode("utf-8", "surrogatepass")
    if len(low) == len(data):
        was, now = np.frombuffer(data, dtype=np.uint8), np.frombuffer(low, dtype=np.uint8)
        if np.array_equal(was & 0xC0 == 0x80, now & 0xC0 == 0x80):
            return low
    size = lambda c: len(c.encode("utf-8", "surrogatepass"))
    return text.translate({ord(c): c.lower() for c in set(text) if size(c.lower()) == size(c)}).encode("utf-8", "surrogatepass")


class Tokens(NamedTuple):
    """Hashes of the plain words and of the tokens of some texts; template hashes and slot values (0 for literal ones) of the tokens; the word
    that each token begins with; and where each text's words and tokens begin."""

    words: np.ndarray
    tokens: np.ndarray
    template: np.ndarray
    slots: np.ndarray
    begins: np.ndarray
    word_offsets: np.ndarray
    offsets: np.ndarray


def canonical_words(texts: list[bytes]) -> Tokens:
    data = b"\n".join([*texts, b""])
    raw = np.frombuffer(data, dtype=np.uint8)
    text_ends = np.cumsum([len(t) + 1 for t in texts]).astype(np.int64) if texts else np.zeros(0, dtype=np.int64)
    edge = np.diff(np.r_[False, _WORD[raw], False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = hash_runs(np.frombuffer(b"\n".join([*map(_lowered, texts), b""]), dtype=np.uint8), starts, ends - starts)
    word_offsets = np.r_[0, np.searchsorted(starts, text_ends)].astype(np.int64)
    if not len(words):
        none = np.zeros(0, dtype=np.int64)
        return Tokens(words, words, words, words, none, word_offsets, word_offsets)
    first = raw[starts]
    second = raw[np.minimum(starts + 1, ends - 1)]
    digits = (first >= 48) & (first <= 57)
    spelled = _among(words, "number")
    number = digits | spelled
    name = (first >= 65) & (first <= 90) & (ends - starts > 1) & ~((second >= 65) & (second <= 90)) & ~_among(words, "starter") & ~number
    # What one character parts: decimals and thousands, numbers as words, and names of several words are one token.
    gap = np.where(starts[1:] - ends[:-1] == 1, raw[ends[:-1]], 0)
    blank = (gap == 32) | (gap == 45)
    joins = digits[1:] & digits[:-1] & ((gap == 46) | (gap == 44)) | spelled[1:] & number[:-1] & blank | name[1:] & name[:-1] & blank
    begins = np.flatnonzero(np.r_[True, ~joins])
    lengths = np.diff(np.r_[begins, len(words)])
    within = np.arange(len(words)) - np.repeat(begins, lengths)
    with np.errstate(over="ignore"):
        together = mix64(np.add.reduceat(mix64(words + within.astype(np.uint64)), begins))
    tokens = np.where(lengths > 1, together, words[begins])
    number, name = number[begins], name[begins]
    unit = np.r_[False, number[:-1]] & ~number & ~name & _among(tokens, "unit")
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, tokens)))
    slots = np.where(number | name | unit, tokens | np.uint64(1), np.uint64(0))
    return Tokens(words, tokens, template, slots, begins, word_offsets, np.searchsorted(begins, word_offsets).astype(np.int64))


def windows_of(words: np.ndarray, width: int, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``width`` words; with slots, of templates that are literal enough."""
    at = np.arange(max(0, len(words) - width + 1) if width else 0)
    if slots is not None and len(at):
        literal = np.r_[0, np.cumsum(slots == 0)]
        at = at[(2 * (literal[width:] - literal[:-width]) >= width) & (width >= LEAST)]
    return at, _window_hash(words, width, slots is None)[at]


def _window_hash(template: np.ndarray, width: int, exact: bool) -> np.ndarray:
    m = len(template) - width + 1
    out = np.full(max(0, m), 2 * width + exact, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width if m > 0 else 0):
            out += template[k : k + m] * _PLACES[k]
    return mix64(out)


ROWS = "h long, id long, at int, first int, width int, n_words int, slots binary"
_ROWS = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("width", pa.int32()), ("n_words", pa.int32()), ("slots", pa.binary())])


def _window_rows(is_item: bool, bitmap: bytes | None, short: list[tuple[bool, int]]):
    """Windows of texts: hash, id, place among the words (or, with slots, among the tokens), words that it covers, and words of the text."""

    def run(batches):
        bits = None if bitmap is None else np.frombuffer(bitmap, dtype=np.uint8)
        for batch in slices(batches, rows=1024, max_bytes=2 << 20):
            t = canonical_words(byte_values(batch.column(1)))
            ends = np.r_[t.begins, len(t.words)]
            ids, cols = batch.column(0).to_pylist(), [[] for _ in _ROWS]
            for exact in (True, False):
                hashed, offsets, slots = (t.words, t.word_offsets, None) if exact else (t.template, t.offsets, t.slots)
                every = []
                if is_item:
                    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                        width = min(WINDOW, int(b - a))
                        at, h = windows_of(hashed[a:b], width, None if exact else slots[a:b])
                        every.append((at + a, h, np.full(len(at), i), width))
                else:
                    # Windows over all texts at once; those across a border are dropped.
                    for width in [WINDOW, *(w for e, w in short if e == exact)]:
                        at, h = windows_of(hashed, width, slots)
                        if bits is not None:
                            ok = bits[(h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)] > 0
                            at, h = at[ok], h[ok]
                        doc = np.searchsorted(offsets, at, side="right") - 1
                        inside = at + width <= offsets[doc + 1]
                        every.append((at[inside], h[inside], doc[inside], width))
                for at, h, doc, width in every:
                    first = at if exact else t.begins[at]
                    cols[0] += h.view(np.int64).tolist()
                    cols[1] += [ids[d] for d in doc]
                    cols[2] += (at - offsets[doc]).tolist()
                    cols[3] += (first - t.word_offsets[doc]).tolist()
                    cols[4] += [width] * len(at) if exact else (ends[at + width] - first).tolist()
                    cols[5] += (t.word_offsets[doc + 1] - t.word_offsets[doc]).tolist()
                    cols[6] += [None] * len(at) if exact else [slots[x : x + width].tobytes() for x in at]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)

    return run


def _judge(least_share: float, most: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("n_covered", pa.int64()), ("n_item_words", pa.int64()), ("n_slots", pa.int64()), ("n_changed", pa.int64())])

    def rows(batches):
        every = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (doc, item), run in groupby(every, key=lambda r: r[:2]):
            covered, places, slots_seen, changed = set(), set(), set(), set()
            # doc_id, item_id, at, item_at, first, width, n_words, slots, item_slots
            run = sorted(set(run), key=lambda r: (r[7] is None, r[2] - r[3], r[3]))
            n_item = run[0][6]
            for (exact, shift), aligned in groupby(run, key=lambda r: (r[7] is None, r[2] - r[3])):
                aligned = list(aligned)
                there: dict[int, int] = {}
                if not exact:
                    pairs = [(int(y), int(x)) for r in aligned for x, y in zip(np.frombuffer(r[7], dtype=np.uint64), np.frombuffer(r[8], dtype=np.uint64), strict=True) if y]
                    if any(there.setdefault(y, x) != x for y, x in pairs):
                        # What is unchanged in here is found by its words.
                        continue
                    slots_seen.update(there)
                    changed.update(y for y, x in there.items() if x != y)
                for r in aligned:
                    places.add((shift, r[4]))
                    covered.update(range(r[4], r[4] + r[5]))
            need = max(min(WINDOW, n_item), min(most, int(np.ceil(least_share * n_item))))
            if len(covered) >= need:
                yield doc, item, len(places), len(covered), n_item, len(slots_seen), len(changed)

    def run(batches):
        found = rows(batches)
        while block := list(islice(found, 4096)):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document and benchmark item that it leaks."""
    small_batches(docs)
    items = benchmark.select(benchmark[item_col].cast("long").alias("id"), benchmark[item_text_col].cast("string").alias("text")).filter("id is not null")
    asked = saved(items.mapInArrow(_window_rows(True, None, []), ROWS).dropDuplicates(), "item-windows")
    n = asked.count()
    # A few widths of each kind.
    kinds = asked.select(F.col("slots").isNull().alias("exact"), F.coalesce(F.octet_length("slots") / 8, "width").cast("int").alias("w")).distinct().collect()
    bitmap = None
    if n <= BITMAP_ROWS:
        bits = np.zeros(BITMAP_BITS, dtype=np.uint8)
        hashes = np.array([r[0] for r in asked.select("h").distinct().collect()], dtype=np.int64).view(np.uint64)
        bits[(hashes & np.uint64(BITMAP_BITS - 1)).astype(np.int64)] = 1
        bitmap = bits.tobytes()
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).filter("id is not null")
    seen = texts.mapInArrow(_window_rows(False, bitmap, sorted((r[0], r[1]) for r in kinds if r[1] < WINDOW)), ROWS)
    theirs = asked.select("h", F.col("id").alias("item_id"), F.col("at").alias("item_at"), "first", "width", "n_words", F.col("slots").alias("item_slots"))
    joined = join_sized(seen.select("h", F.col("id").alias("doc_id"), "at", "slots"), theirs, ["h"], "inner", 160, n)
    joined = joined.filter(F.octet_length("slots").eqNullSafe(F.octet_length("item_slots")))
    pairs = joined.select("doc_id", "item_id", "at", "item_at", "first", "width", "n_words", "slots", "item_slots")
    sorted_pairs = pairs.repartition("doc_id", "item_id").sortWithinPartitions("doc_id", "item_id")
    return sorted_pairs.mapInArrow(_judge(share, most), "doc_id long, item_id long, n_windows long, n_covered long, n_item_words long, n_slots long, n_changed long")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that leak no item. Each row is known by its id and text."""
    row = F.xxhash64(docs[id_col], docs[text_col].cast("string"))
    rows = docs.select(row.alias("__row"), docs[text_col].alias("__text"))
    leaks = saved_alone(docs.sparkSession, lambda: find_leaks(rows, benchmark, "__row", "__text").select(F.col("doc_id").alias("__row")).distinct(), "leaking")
    return join_sized(docs.withColumn("__row", row), leaks, ["__row"], "left_anti", 32).select(*docs.columns)

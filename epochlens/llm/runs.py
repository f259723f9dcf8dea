"""Periodic runs of words, by Lyndon arrays on an ordered alphabet.

A run is a stretch of words with smallest period q and at least 2q words that no neighbouring word extends. Each run has a root, a Lyndon word of q words for one of
two opposite orders of the alphabet, that starts in the run's first q words and ends where the next smaller suffix begins. So the next smaller suffixes of both orders,
with how far each pair of suffixes matches, give all runs.

They are found from left to right in time linear in the words, and only by comparing words. The candidates at a position are those before it that are not yet followed by a smaller suffix; each
knows how far it matches the one before it. When a suffix has been compared with one candidate, its match with the next follows from these two lengths unless they are equal, and then goes on from
there. Matches are never read twice: the pair that reached furthest to the right is remembered, and a pair that lies within its right part has its match from the
pair in the left part (Ellert and Fischer, "Linear time runs over general ordered alphabets", 2021). Neither suffix arrays nor hashes of words are used.

Each text is a row, and rows are independent: there is no shuffle, and a long text is read by one task.

Defined cases: a null or empty text has no words and no runs; a null id stays; rows with equal ids or texts are rows of their own; an empty table
gives no rows; other columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, slices, small_batches

#: Words of the shortest run that counts.
MIN_LENGTH = 12
RUN = "struct<start: bigint, length: bigint, period: bigint>"
SCHEMA = f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def ranks(words: list[bytes]) -> list[int]:
    """Each word's place among the distinct words."""
    place = {w: k for k, w in enumerate(sorted(set(words)))}
    return [place[w] for w in words]


def smaller_suffixes(w: list[int]) -> list[tuple[int, int, int]]:
    """``w`` ends with an entry that is smaller than all others. (a, j, r) for each position a whose next smaller suffix begins at j with the same word; r words match."""
    n = len(w) - 1
    memory = array("q", w).tobytes()
    before, before_match = [-1] * (n + 1), [0] * (n + 1)  # the last smaller suffix before, and how far it matches
    after, after_match = [0] * (n + 1), [0] * (n + 1)  # the next smaller suffix, where the first words are equal
    left = right = reach = 0  # w[left:] and w[right:] match up to ``reach`` in the right one
    found = []

    def match(a: int, i: int, k: int) -> int:
        """How far the suffixes at a < i match; at least k."""
        nonlocal left, right, reach
        if right <= a and i < reach:
            p, q = a - right + left, i - right + left
            known = after_match[p] if after[p] == q else before_match[q] if before[q] == p else -1
            if known >= 0:
                if i + known < reach:
                    return known
                k = max(k, reach - i)
        end = k + 8
        while w[a + k] == w[i + k]:
            k += 1
            if k == end:
                k = _gallop(memory, a, i, k)
                break
        if i + k >= reach:
            left, right, reach = a, i, i + k
        return k

    for i in range(1, n + 1):
        now, a = w[i], i - 1
        while (other := w[a]) > now:
            a = before[a]
        if other < now or a < 0:  # at -1 stands the last entry
            before[i] = a
            continue
        k = match(a, i, 1)
        while True:
            if w[a + k] < w[i + k]:
                before[i], before_match[i] = a, k
                break
            after[a], after_match[a] = i, k
            found.append((a, i, k))
            m, a = before_match[a], before[a]
            if a < 0:
                break
            if m < k:
                before[i], before_match[i] = a, m
                break
            if m == k:
                k = match(a, i, k)
    return found


def _gallop(memory: bytes, a: int, i: int, k: int) -> int:
    """From a match of k entries of eight bytes on, by stretches that double and halve."""
    step = 16
    while step:
        p, q = 8 * (a + k), 8 * (i + k)
        if q + 8 * step <= len(memory) and memory[p : p + 8 * step] == memory[q : q + 8 * step]:
            k, step = k + step, 2 * step
        else:
            step //= 2
    return k


def find_runs(words: list[bytes], least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words, by start and period."""
    if len(words) < max(2, least):
        return []
    up = ranks(words)
    top = max(up)
    memory = array("q", up).tobytes()
    found = set()
    for w in (up, [top - x for x in up]):
        for a, j, r in smaller_suffixes([*w, -1]):
            q = j - a
            need = max(q, least - q) - r  # words that must match before both
            if need >= q or need > a or need > 0 and memory[8 * (a - need) : 8 * a] != memory[8 * (j - need) : 8 * j]:
                continue
            k = _back(memory, a, j, max(need, 0), q)
            if k < q:  # else the root a period earlier shows the run
                found.add((a - k, q + k + r, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def _back(memory: bytes, a: int, j: int, k: int, most: int) -> int:
    """How many entries before a and j match, from k on; no more than ``most``."""
    most, step = min(most, a), 16
    while k < most:
        size = min(step, most - k)
        p, q = 8 * (a - k), 8 * (j - k)
        if memory[p - 8 * size : p] == memory[q - 8 * size : q]:
            k, step = k + size, 2 * step
        elif size > 1:
            step = size // 2
        else:
            break
    return k


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    kept, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        if start > at:
            kept += words[at:start]
        at = max(at, end)
    return b" ".join(kept + words[at:] if at else words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period, in words, by start and period) and the text without repetitions (words joined by one space)."""
    small_batches(docs)

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in byte_values(batch.column(1)):
                words = text.split()  # bytes are split at the six ASCII blanks
                runs = find_runs(words, least)
                rows.append((len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], collapse(words, runs)))
            n_words, runs, kept = zip(*rows, strict=True)
            # The parts of valid UTF-8 are valid; nothing needs to be checked.
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.binary()).view(pa.string())], schema=_SCHEMA)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text, or for about one document in ten the text with its words from some place on replaced by repetitions of the words there."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(doc_id.cast("string"))
    n, g = F.greatest(F.size(words), F.lit(1)).cast("long"), F.floor(h / 10)
    start = g % n
    period = 1 + F.floor((n - start) / (3 + g % 8))
    unit = F.slice(words, (start + 1).cast("int"), period.cast("int"))
    again = F.flatten(F.array_repeat(unit, F.floor((n - start) / period).cast("int")))
    whole = F.concat(F.slice(words, F.lit(1), start.cast("int")), again, F.slice(unit, F.lit(1), ((n - start) % period).cast("int")))
    return F.when(h % 10 == 0, F.concat_ws(" ", whole)).otherwise(text)


def run_digests(runs: DataFrame) -> DataFrame:
    """Of the rows of ``periodic_runs``: doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the kept words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    named = runs.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

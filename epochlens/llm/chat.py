"""Chat formatting with minimum-cost role repair.

A legal chat is an optional system turn, then user and assistant turns in alternation, ending with an assistant turn.
Dynamic programming over that automaton picks, for each turn, one of: keep it, relabel it, merge it into the turn before,
each after inserting empty turns where needed. Costs are in ``COSTS``; equal costs prefer, in order, fewer inserted
turns, then keeping, then relabelling to the first of user, assistant, system, then merging.

One turn is a 4x4 matrix over (min, +), so a run of turns is their product. Conversations are cut into segments
of ``SEGMENT`` turn numbers, and a segment of more than ``MOST_ROWS`` rows, whose turns are null or share their numbers, into parts of so
many distinct rows: segments are multiplied apart, their matrices are scanned in order for the boundary states, and each
is then traced and rendered apart. No task holds the text of a whole long conversation; the texts of a conversation's segments and
parts, in order, make its rendering. The scan takes one task a conversation, with 150 bytes for each of its segments.

Defined cases: exact repeats of a row count once; equal turn numbers are ordered by role then text; a null turn number
comes last; a null conversation is a conversation of its own; a null or unknown role is relabelled at a lower cost; null text is
empty; an empty table gives no rows; other columns are ignored. Control marks inside texts are escaped.
"""

from __future__ import annotations

from array import array
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, running_sums, saved

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
COSTS = {"keep": 0, "merge": 2, "relabel": 3, "relabel_unknown": 1, "insert": 2}
SEGMENT, MOST_ROWS = 256, 4096
INF = 1 << 40
FINAL = ASSISTANT
SCHEMA = "conv_id long, segment long, part long, n_turns long, n_out long, cost long, n_merged long, n_relabelled long, n_inserted long, roles string, text string"


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest inserted turns that lead from one state to another."""
    paths = {(s, s): () for s in range(4)}
    todo = [(s, s) for s in range(4)]
    for s, at in todo:
        for to in (USER, ASSISTANT, SYSTEM):
            if (at, to) in LEGAL and (s, to) not in paths:
                paths[s, to] = (*paths[s, at], to)
                todo.append((s, to))
    return paths


INSERTS = _inserts()


def _moves(role: int) -> dict[tuple[int, int], tuple[int, tuple[int, ...], str]]:
    """For a turn of ``role`` (0: unknown): (from, to) -> cost, inserted turns, operation."""
    best: dict = {}
    for (s, mid), path in INSERTS.items():
        base = COSTS["insert"] * len(path)
        options = []
        for to in (USER, ASSISTANT, SYSTEM):
            if (mid, to) in LEGAL:
                if to == role:
                    options.append((base, len(path), 0, to, path, "keep"))
                else:
                    options.append((base + COSTS["relabel" if role else "relabel_unknown"], len(path), 1, to, path, "relabel"))
        if mid != START:
            extra = 0 if mid == role else COSTS["relabel" if role else "relabel_unknown"]
            options.append((base + COSTS["merge"] + extra, len(path), 2, mid, path, "merge"))
        for cost, n, rank, to, path_, op in options:
            key = (cost, n, rank)
            if (s, to) not in best or key < best[s, to][0]:
                best[s, to] = (key, path_, op)
    return {k: (v[0][0], v[1], v[2]) for k, v in best.items()}


MOVES = {role: _moves(role) for role in range(4)}
MATRICES = np.full((4, 4, 4), INF, dtype=np.int64)
for _role, _table in MOVES.items():
    for (_s, _t), (_cost, _, _) in _table.items():
        MATRICES[_role, _s, _t] = _cost
_IDENTITY = np.where(np.eye(4, dtype=bool), 0, INF)
#: Cost of ending in each state: inserted turns up to a final one.
ENDING = np.array([COSTS["insert"] * len(INSERTS[s, FINAL]) if (s, FINAL) in INSERTS else INF for s in range(4)], dtype=np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), INF)


def role_code(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) + 1 if role in ROLES else 0


def trace(roles: list[int], start: int, end: int) -> list[tuple[tuple[int, ...], str, int]]:
    """Of the cheapest walks from ``start`` to ``end``: inserted turns, operation and state for each turn."""
    ahead = np.full((len(roles) + 1, 4), INF, dtype=np.int64)
    ahead[-1, end] = 0
    for i in range(len(roles) - 1, -1, -1):
        ahead[i] = np.minimum((MATRICES[roles[i]] + ahead[i + 1][None, :]).min(axis=1), INF)
    out, at = [], start
    for i, role in enumerate(roles):
        to = int(np.argmin(MATRICES[role][at] + ahead[i + 1]))
        _, path, op = MOVES[role][at, to]
        out.append((path, op, to))
        at = to
    return out


def escape(text: str) -> str:
    return text.replace("<|", "<\\|")


def render(steps: list, texts: list[str], start: int, last: bool, end: int) -> tuple[str, list[str], int, int, int]:
    """Text, roles begun, merges, relabels, inserts of one segment. A turn is closed where the next begins."""
    out, begun, merged, relabelled, inserted = [], [], 0, 0, 0
    is_open = start != START

    def begin(state: int) -> None:
        nonlocal is_open
        out.append(("<|end|>\n" if is_open else "") + f"<|{ROLES[state - 1]}|>\n")
        begun.append(ROLES[state - 1])
        is_open = True

    for (path, op, state), text in zip(steps, texts, strict=True):
        for x in path:
            begin(x)
            inserted += 1
        if op == "merge":
            out.append("\n\n")
            merged += 1
        else:
            begin(state)
            relabelled += op == "relabel"
        out.append(escape(text))
    if last:
        for x in INSERTS[end, FINAL]:
            begin(x)
            inserted += 1
        out.append("<|end|>\n" if is_open else "")
    return "".join(out), begun, merged, relabelled, inserted


def _runs(batches, n_keys: int):
    """Consecutive rows with equal leading keys, over batch borders."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda r: r[:n_keys])


#: Rows and characters of text in a batch; one segment alone may be longer.
BATCH_ROWS, BATCH_CHARS = 256, 8 << 20


def _to_batches(rows, schema: pa.Schema, most: int = BATCH_ROWS):
    block, chars = [], 0
    for row in rows:
        size = sum(len(x) for x in row if isinstance(x, str))
        if block and (len(block) == most or chars + size > BATCH_CHARS):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)
            block, chars = [], 0
        block.append(row)
        chars += size
    if block:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)


def _unique(rows):
    """Drop exact repeats, which stand side by side after the sort."""
    before = object()
    for row in rows:
        if row != before:
            yield row
        before = row


def _multiply(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("part", pa.int64()), ("matrix", pa.list_(pa.int64()))])

    def rows():
        for key, run in _runs(batches, 3):
            m = _IDENTITY
            for row in _unique(run):
                m = product(m, MATRICES[role_code(row[4])])
            yield *key, m.ravel().tolist()

    yield from _to_batches(rows(), schema, 4096)


def _bounds(batches):
    """States before and after each segment on a cheapest walk of the conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("part", pa.int64()), ("s_from", pa.int64()), ("s_to", pa.int64()), ("is_last", pa.bool_()), ("cost", pa.int64())])

    def rows():
        for (conv,), run in _runs(batches, 1):
            flat, places = array("q"), array("q")
            for r in run:
                places.extend(r[1:3])
                flat.extend(r[3])
            ms = np.frombuffer(flat, dtype=np.int64).reshape(-1, 4, 4)
            n = len(ms)
            ahead = np.empty((n + 1, 4), dtype=np.int64)
            ahead[-1] = ENDING
            for i in range(n - 1, -1, -1):
                ahead[i] = np.minimum((ms[i] + ahead[i + 1][None, :]).min(axis=1), INF)
            at = START
            for i in range(n):
                to = int(np.argmin(ms[i][at] + ahead[i + 1]))
                last = i == n - 1
                yield conv, places[2 * i], places[2 * i + 1], at, to, last, int(ms[i][at, to] + (ENDING[to] if last else 0))
                at = to

    yield from _to_batches(rows(), schema, 4096)


def _render_segments(batches):
    schema = pa.schema([(n, pa.string() if n in ("roles", "text") else pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))])

    def rows():
        for key, run in _runs(batches, 3):
            run = list(_unique(run))
            start, end, last, cost = run[0][6:10]
            steps = trace([role_code(r[4]) for r in run], start, end)
            text, begun, merged, relabelled, inserted = render(steps, [r[5] or "" for r in run], start, last, end)
            yield *key, len(run), len(begun), cost, merged, relabelled, inserted, ",".join(begun), text

    yield from _to_batches(rows(), schema)


def _with_parts(rows: DataFrame) -> DataFrame:
    """Adds the part of its segment that a row belongs to: 0, but for segments of very many rows."""
    segment = ["conv_id", "segment"]
    wide = saved(rows.groupBy(*segment).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_ROWS).select(F.col("conv_id").alias("w_conv"), F.col("segment").alias("w_seg")), "wide")
    n = wide.count()
    if not n:
        return rows.withColumn("part", F.lit(0).cast("long"))
    side = F.broadcast(wide) if n * 64 <= BROADCAST_BYTES else wide
    on = rows.conv_id.eqNullSafe(wide.w_conv) & (rows.segment == wide.w_seg)
    few = rows.join(side, on, "left_anti").withColumn("part", F.lit(0).cast("long"))
    order = [F.col("conv_id"), F.col("segment"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    ranked = saved(running_sums(rows.join(side, on, "left_semi").dropDuplicates(), order, {"rank": F.lit(1).cast("long")}), "ranked")
    begins = ranked.groupBy(*segment).agg(F.min("rank").alias("begin")).select(F.col("conv_id").alias("b_conv"), F.col("segment").alias("b_seg"), "begin")
    parts = ranked.join(F.broadcast(begins) if n * 64 <= BROADCAST_BYTES else begins, ranked.conv_id.eqNullSafe(begins.b_conv) & (ranked.segment == begins.b_seg))
    return few.unionByName(parts.select(*rows.columns, F.floor((F.col("rank") - F.col("begin")) / MOST_ROWS).cast("long").alias("part")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Repaired and rendered conversations, one row per segment (one per conversation of up to ``SEGMENT`` turns)."""
    rows = _with_parts(
        turns.select(
            turns[conv_col].cast("long").alias("conv_id"),
            F.coalesce(F.floor(turns[turn_col].cast("long") / SEGMENT), F.lit(1 << 60)).cast("long").alias("segment"),
            turns[turn_col].cast("long").alias("turn"),
            turns[role_col].cast("string").alias("role"),
            turns[text_col].cast("string").alias("text"),
        )
    ).select("conv_id", "segment", "part", "turn", "role", "text")
    keys = ["conv_id", "segment", "part"]
    order = [*keys, F.col("turn").asc_nulls_last(), "role", "text"]
    # Exact repeats must go before multiplication as well; a digest stands for the text there.
    short = rows.withColumn("text", F.sha2("text", 256)).repartition(*keys).sortWithinPartitions(*order)
    matrices = short.mapInArrow(_multiply, "conv_id long, segment long, part long, matrix array<long>")
    bounds = matrices.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(_bounds, "conv_id long, segment long, part long, s_from long, s_to long, is_last boolean, cost long")
    b = bounds.toDF("b_conv", "b_seg", "b_part", *bounds.columns[3:])
    joined = rows.join(b, rows.conv_id.eqNullSafe(b.b_conv) & (rows.segment == b.b_seg) & (rows.part == b.b_part)).drop("b_conv", "b_seg", "b_part")
    return joined.repartition(*keys).sortWithinPartitions(*order).mapInArrow(_render_segments, SCHEMA)

"""Candidates: union, identity, deduplication with conflicts, order, evidence by function span."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, bound_snippet, candidate_id, function_id, normalize_newlines
from .cuts import capped_cuts, greedy_groups

IDENTITY = ["path", "line", "col_start", "col_end", "symbol", "risk"]
#: Lines of a block whose targets are one row.
CHUNK = 4096


# How a candidate may have been found.
METHODS = ("catalog_symbol_match", "time_t_cast", "define_scanner", "arithmetic_scanner", "io_boundary", "migration", "unknown")


def discovery_method(value: Column) -> Column:
    """A method of the vocabulary; blank is unknown, and anything else an error."""
    v = blank_to_null(value)
    return F.when(v.isNull(), "unknown").when(v.isin(*METHODS), v).otherwise(F.raise_error(F.concat(F.lit("unknown discovery method "), v)))


def as_candidates(rows: DataFrame) -> DataFrame:
    """Project rows with path, line, text, symbol, risk, description and discovery_method (and rule_id, where there) to the candidate columns."""
    none = F.lit(None)
    return rows.select(
        "path", "line", none.cast("int").alias("col_start"), none.cast("int").alias("col_end"), "symbol", "risk", bound_snippet(F.col("text")).alias("snippet"), normalize_newlines(F.col("description")).alias("description"),
        "discovery_method", (F.col("rule_id") if "rule_id" in rows.columns else none.cast("string")).alias("rule_id"),
    )


def unite(*rows: DataFrame) -> DataFrame:
    """All candidate rows of all detectors, repeats included."""
    return reduce(DataFrame.unionByName, map(as_candidates, rows))


def dedupe(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per identity, empty fields filled, and the identities whose rows contradict each other.

    A conflict is more than one method, rule id or description besides the empty ones. ``dedupe_strict`` raises on it instead.
    """
    filled = candidates.withColumn("description", blank_to_null(F.col("description"))).withColumn("rule_id", blank_to_null(F.col("rule_id")))
    groups = filled.groupBy(*IDENTITY).agg(
        F.min("snippet").alias("snippet"), F.min("description").alias("description"), F.min("discovery_method").alias("discovery_method"), F.min("rule_id").alias("rule_id"), F.count(F.lit(1)).alias("n_rows"),
        # Least and greatest differ where there is more than one; distinct counts would make four rows of each.
        reduce(Column.__or__, [F.coalesce(F.min(c) < F.max(c), F.lit(False)) for c in ("description", "discovery_method", "rule_id")]).alias("conflict"),
    )
    ids = groups.withColumn("candidate_id", candidate_id(F.col("path"), F.col("line"), F.col("col_start"), F.col("col_end"), F.col("risk"), F.col("symbol")))
    return ids.drop("conflict"), ids.filter("conflict").select("candidate_id", "n_rows")


def dedupe_strict(candidates: DataFrame) -> DataFrame:
    kept, conflicts = dedupe(candidates)
    first = conflicts.head(1)
    if first:
        raise ValueError(f"contradicting candidates: {first[0]['candidate_id']}")
    return kept


def in_order(candidates: DataFrame) -> DataFrame:
    """Total order by identity; missing columns count as 0."""
    return candidates.orderBy("path", "line", F.coalesce("col_start", F.lit(0)), F.coalesce("col_end", F.lit(0)), "symbol", "risk")


def part_id(path: Column, name: Column, start: Column, end: Column, part: Column) -> Column:
    """A function's id, with its part where it was split."""
    whole = function_id(path, name, start, end)
    return F.when(part > 0, F.concat(whole, F.lit(":part"), part.cast("string"))).otherwise(whole)


def join_functions(candidates: DataFrame, functions: DataFrame, block: int = 256) -> DataFrame:
    """Candidates with the function whose lines hold them, null where none does; the innermost, then the first, where several do.

    Lines are cut into blocks of a file. The functions of a block are one row: for each pair of lines of the block that functions span, the best of those; so a row is bounded by the
    block, and candidates are read once and meet one row each.
    """
    part = F.col("part") if "part" in functions.columns else F.lit(0)
    placed = functions.withColumn("function_id", part_id(F.col("path"), F.col("name"), F.col("start_line"), F.col("end_line"), part)).filter("function_id is not null")
    spans = placed.select("path", F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))).alias("__blk"), "function_id", "start_line", "end_line")
    lo, hi = F.greatest(F.col("start_line"), F.col("__blk") * block), F.least(F.col("end_line"), F.col("__blk") * block + block - 1)
    best = F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "start_line", "function_id")
    each = spans.groupBy("path", "__blk", lo.alias("lo"), hi.alias("hi")).agg(F.min(best).alias("best"))
    blocks = each.groupBy("path", "__blk").agg(F.collect_list(F.struct("lo", "hi", "best")).alias("__spans"))
    # A block's functions are a row beside its candidates: where both are dealt by path already, nothing is dealt again.
    kind = blocks.schema["__spans"].dataType
    rows = candidates.withColumns({"__blk": F.floor(F.col("line") / block), "__spans": F.lit(None).cast(kind), "__own": F.lit(True)})
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in candidates.schema if f.name != "path"]
    both = rows.unionByName(blocks.select("path", *others, "__blk", "__spans", F.lit(False).alias("__own")))
    line = F.col("line")
    told = both.withColumn("__spans", F.first("__spans", ignorenulls=True).over(Window.partitionBy("path", "__blk"))).filter("__own")
    own = F.array_min(F.transform(F.filter("__spans", lambda x: (x["lo"] <= line) & (line <= x["hi"])), lambda x: x["best"]))["function_id"]
    return told.withColumn("function_id", own).select(*candidates.columns, "function_id", F.when(F.col("function_id").isNotNull(), "grouped").otherwise("ungrouped").alias("analysis_coverage"))


def summarize(evidence: DataFrame) -> DataFrame:
    return evidence.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("function_id").isNotNull()).alias("grouped"), F.count_if(F.col("function_id").isNull()).alias("ungrouped"), F.countDistinct("function_id").alias("functions"))


def function_candidates(evidence: DataFrame) -> DataFrame:
    """Per function its candidate lines and ids in order."""
    rows = evidence.filter("function_id is not null")
    ordered = F.array_sort(F.collect_set(F.struct("line", "candidate_id")))
    return rows.groupBy("function_id", "path").agg(ordered.alias("c")).select("function_id", "path", F.array_distinct(F.transform("c", lambda x: x["line"])).alias("candidate_lines"), F.transform("c", lambda x: x["candidate_id"]).alias("candidate_ids"))


def dedupe_functions(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each function_id, the first by path and lines, with the candidate lines of all its rows in order; and the id that each row's own place now has
    (path, start_line, end_line, function_id, kept_path), where that is another place.

    Rows of one id are never gathered: the first is kept by partial aggregation, and lines are made distinct before they meet.
    """
    place = F.struct("path", "start_line", "end_line", F.xxhash64(*[c for c in functions.columns if c != "candidate_lines"]).alias("tie"))
    firsts = functions.groupBy("function_id").agg(F.min_by(F.struct(*[c for c in functions.columns if c not in ("function_id", "candidate_lines")]), place).alias("r"))
    lines = functions.select("function_id", F.explode("candidate_lines").alias("n")).distinct().groupBy("function_id").agg(F.array_sort(F.collect_list("n")).alias("candidate_lines"))
    empty = F.array().cast("array<int>")
    kept = firsts.join(lines, "function_id", "left").select("function_id", "r.*", F.coalesce("candidate_lines", empty).alias("candidate_lines")).select(*functions.columns)
    placed = functions.select("path", "start_line", "end_line", "function_id").distinct()
    to = kept.select("function_id", F.col("path").alias("kept_path"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    moved = placed.join(to, "function_id").filter("path <> kept_path OR start_line <> s OR end_line <> e").select("path", "start_line", "end_line", "function_id", "kept_path")
    return kept, moved


def batches(functions: DataFrame, size: int = 15) -> DataFrame:
    """Fixed batches inside each file, in order of the function id; a global number would need one task."""
    order = Window.partitionBy("path").orderBy("function_id")
    return functions.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def _with_targets(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Lines and, as rows of their own without a text, the places of targets, once each: path, line, text, target. Where both are dealt by path already, nothing is dealt again."""
    places = targets.groupBy("path", "line").agg(F.lit(True).alias("target"))
    return lines.select("path", "line", "text", F.lit(False).alias("target")).unionByName(places.select("path", "line", F.lit(None).cast("string").alias("text"), "target"))


def line_frames(lines: DataFrame, targets: DataFrame, reach: int = 5) -> DataFrame:
    """The lines around each target line, joined, with a mark on the target. One window over lines and targets, so that no frame is made or moved but those asked for."""
    near = Window.partitionBy("path").orderBy("line").rangeBetween(-reach, reach)
    framed = _with_targets(lines, targets).withColumn("l", F.collect_list(F.when(~F.col("target"), F.struct("line", "text"))).over(near)).filter("target")
    wanted = framed.select("path", F.col("line").alias("target"), "l").filter(F.exists("l", lambda x: x["line"] == F.col("target")))
    shown = F.transform(F.array_sort("l"), lambda x: F.concat(F.when(x["line"] == F.col("target"), ">>> ").otherwise("    "), x["line"].cast("string"), F.lit(": "), x["text"]))
    return wanted.select("path", "target", F.array_join(shown, "\n").alias("frame"))


def block_contexts(lines: DataFrame, targets: DataFrame, most: int = 100) -> DataFrame:
    """The block around each target line: from the last line before it that opens a definition to the line where its braces are even again.

    At most ``most`` lines, numbered, with a mark on the target; targets without such a block have no row. path, target, context.
    """
    t = F.trim("text")
    kinds = "|".join(("int ", "void ", "char ", "struct ", "enum ", "float ", "double ", "long ", "short ", "unsigned ", "signed "))
    opens = t.endswith("{") & ~t.rlike(r"^(?://|/\*|\*)") & (t.rlike("static|extern") | t.rlike(kinds) & F.contains(t, F.lit("(")) & F.contains(t, F.lit(")")))
    count = lambda c: F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))
    upto = Window.partitionBy("path").orderBy("line", "target").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda value: F.last(F.when(opens, value), ignorenulls=True).over(upto)
    # Depth before the opening line's own last brace (``base``): the block ends where it is reached again.
    depth = _with_targets(lines, targets).withColumn("start", last(F.col("line"))).withColumn("depth", F.sum(count("{") - count("}")).over(upto))
    marked = depth.withColumn("base", last(F.col("depth") - 1)).filter("start is not null")
    # A block's text is made once, in the first of its chunks of lines; targets are held a chunk at a time.
    line, own = F.col("line"), ~F.col("target")
    shown = F.concat(F.lit(" "), F.lpad(line.cast("string"), F.greatest(F.lit(4), F.length(line.cast("string"))), F.lit(" ")), F.lit(": "), F.rtrim("text"))
    chunks = marked.groupBy("path", "start", F.floor((line - F.col("start")) / max(most, CHUNK)).alias("chunk")).agg(
        F.collect_list(F.when(own & (line < F.col("start") + most), F.struct("line", shown.alias("t")))).alias("l"), F.collect_list(F.when(F.col("target"), line)).alias("targets"),
        F.min(F.when(own & (line > F.col("start")) & (F.col("depth") == F.col("base")), line)).alias("end"),
    )
    whole = Window.partitionBy("path", "start")
    blocks = chunks.withColumn("end", F.min("end").over(whole)).withColumn("l", F.first(F.when(F.col("chunk") == 0, F.array_sort(F.filter("l", lambda x: x["line"] <= F.col("end")))), ignorenulls=True).over(whole))
    each = blocks.filter("end is not null").select("path", "start", "end", "l", F.explode(F.filter("targets", lambda x: x <= F.col("end"))).alias("target"))
    text = F.array_join(F.transform("l", lambda x: F.concat(F.when(x["line"] == F.col("target"), ">>>").otherwise("   "), x["t"])), "\n")
    cut = F.when(F.col("end") - F.col("start") + 1 > most, F.lit(f"\n... [function truncated at {most} lines]")).otherwise("")
    return each.select("path", "target", F.concat(text, cut).alias("context"))


def widened_contexts(lines: DataFrame, targets: DataFrame, reach: int = 5) -> DataFrame:
    """The block around each target line, else the lines next to it."""
    frames = line_frames(lines, targets, reach)
    return frames.join(block_contexts(lines, targets), ["path", "target"], "left").select("path", "target", F.coalesce("context", "frame").alias("context"))


def find_by_place(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates for ids that are a file and a line: by path, else by path with forward slashes, else by base name alone where one candidate fits.

    ``asked``: response_id. Returns response_id and candidate_id, null where none is found.
    """
    file = F.regexp_extract("response_id", r"^(.*):(\d+)$", 1)
    at = asked.select("response_id", F.replace(file, F.lit("\\"), F.lit("/")).alias("file"), F.regexp_extract("response_id", r":(\d+)$", 1).try_cast("int").alias("line")).distinct()
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    exact = candidates.select("candidate_id").join(asked.select("response_id").distinct(), F.col("candidate_id") == F.col("response_id")).select("response_id", F.col("candidate_id").alias("c0"))
    by_path = candidates.groupBy(F.col("path").alias("file"), "line").agg(F.min("candidate_id").alias("c1"))
    by_base = by_path.groupBy(base(F.col("file")).alias("base"), "line").agg(F.min("c1").alias("c2"), F.count("file").alias("n")).filter("n = 1").drop("n")
    joined = at.withColumn("base", base(F.col("file"))).join(exact, "response_id", "left").join(by_path, ["file", "line"], "left").join(by_base, ["base", "line"], "left")
    return joined.select("response_id", F.coalesce("c0", "c1", "c2").alias("candidate_id"))


def split_parts(lines: DataFrame, max_lines: int = 10_000, max_chars: int = 20_000) -> DataFrame:
    """Greedy parts of each file: a part ends where the next line would pass a limit. path, part, first and last line, characters with line ends."""
    found = greedy_groups(lines, "path", "line", F.length("text") + 1, capped_cuts(max_lines, max_chars), max_lines)
    parts = found.groupBy("path", "group").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum("n").alias("chars"))
    return parts.select("path", (F.col("group") + 1).cast("int").alias("part"), "first", "last", "chars")

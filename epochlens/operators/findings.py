"""Findings from analyses: lines the model means, regions, rows per issue, adaptive batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound_reason
from .assessments import controlled_reason
from .cuts import adaptive_cuts, greedy_groups

BATCH, LONG_LINE, HUGE_LINE, BATCH_CHARS = 100, 500, 1000, 50_000


def nearest_line(lines: Column, target: Column) -> Column:
    """The candidate line closest to the target; of equally close ones the first."""
    return F.get(F.array_sort(F.transform(lines, lambda x: F.struct(F.abs(x - target).alias("d"), x.alias("line")))), F.lit(0))["line"]


def focus_line(raw: Column, candidates: Column, start: Column, end: Column) -> Column:
    """What an issue's line number means: a candidate line, a line of the span, else a line of the body counted from 1."""
    n = raw.try_cast("int")
    return F.when(F.array_contains(candidates, n), n).when(n.between(start, end), n).when(n.between(0, end - start + 1), F.least(end, start + F.greatest(n, F.lit(1)) - 1))


def region(candidates: Column, start: Column, end: Column) -> Column:
    """First and last candidate line, else the span."""
    good = F.filter(candidates, lambda x: x > 0)
    return F.struct(F.coalesce(F.array_min(good), start).alias("start_line"), F.coalesce(F.array_max(good), end).alias("end_line"))


def to_findings(analyses: DataFrame) -> DataFrame:
    """One row per issue, or one per function without issues.

    ``analyses``: function_id, path, start_line, end_line, candidate_lines, verdict, confidence, issues (type, line, description).
    """
    rows = analyses.select("*", F.posexplode_outer("issues").alias("issue_no", "issue"))
    line = F.coalesce(focus_line(F.col("issue.line"), F.col("candidate_lines"), F.col("start_line"), F.col("end_line")), F.get("candidate_lines", F.lit(0)), F.col("start_line"))
    r = region(F.col("candidate_lines"), F.col("start_line"), F.col("end_line"))
    return rows.select(
        F.concat_ws("#", "function_id", F.coalesce("issue_no", F.lit(0)).cast("string")).alias("finding_id"), "function_id", "path", "verdict", "confidence", F.coalesce("issue.type", F.lit("none")).alias("issue_type"), "issue.description",
        nearest_line(F.when(F.size("candidate_lines") > 0, F.col("candidate_lines")).otherwise(F.array("start_line")), line).alias("line"), r["start_line"].alias("start_line"), r["end_line"].alias("end_line"),
    )


def disabled_findings(functions: DataFrame) -> DataFrame:
    """One finding for each function with candidates while no model is asked."""
    r = region(F.col("candidate_lines"), F.col("start_line"), F.col("end_line"))
    return functions.select(
        F.concat(F.col("function_id"), F.lit("#0")).alias("finding_id"), "function_id", "path", F.lit("abstain").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit("medium").alias("severity"), F.lit("abstain").alias("issue_type"),
        F.lit("LLM analysis disabled").alias("description"), F.coalesce(F.get("candidate_lines", F.lit(0)), F.col("start_line")).alias("line"), r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), F.left("body", F.lit(200)).alias("source_snippet"),
    )


def severity_of(verdict: Column, confidence: Column) -> Column:
    """How grave a finding is: positive ones by confidence, abstentions medium, negative ones low."""
    return F.when(verdict == "yes", F.when(confidence >= 0.9, "high").otherwise("medium")).when(verdict == "no", "low").otherwise("medium")


def assessed_findings(rows: DataFrame) -> DataFrame:
    """One finding for each assessed function (status, verdict, confidence, reason); what failed abstains, with its fixed reason."""
    issue = F.when(F.col("status") == "duplicate", "duplicate_function_id").when(F.col("status") == "invalid", "invalid_result_schema").when(F.col("status") != "completed", "missing_expected_result")
    verdict = F.coalesce(F.when(F.col("status") == "completed", F.col("verdict")), F.lit("abstain"))
    confidence = F.coalesce("confidence", F.lit(0.0))
    r = region(F.col("candidate_lines"), F.col("start_line"), F.col("end_line"))
    return rows.select(
        F.concat(F.col("function_id"), F.lit("#0")).alias("finding_id"), "function_id", "path", verdict.alias("verdict"), confidence.alias("confidence"), severity_of(verdict, confidence).alias("severity"),
        F.coalesce(issue, verdict).alias("issue_type"), F.when(issue.isNotNull(), controlled_reason(issue)).otherwise(F.col("reason")).alias("description"), F.coalesce(F.get("candidate_lines", F.lit(0)), F.col("start_line")).alias("line"),
        r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), F.left("body", F.lit(200)).alias("source_snippet"),
    )


def line_findings(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """Findings from answers to single candidates."""
    rows = responses.join(candidates.select("candidate_id", "path", F.col("line").alias("at"), "symbol", "snippet", "risk"), "candidate_id")
    return rows.select(
        F.concat(F.col("candidate_id"), F.lit("#line")).alias("finding_id"), F.lit(None).cast("string").alias("function_id"), "path", "verdict", "confidence", F.when(F.col("risk").isin("low", "medium", "high"), F.col("risk")).otherwise("medium").alias("severity"),
        F.col("symbol").alias("issue_type"), bound_reason(F.col("reason")).alias("description"), F.col("at").alias("line"), F.col("at").alias("start_line"), F.col("at").alias("end_line"), F.col("snippet").alias("source_snippet"),
    )


def widened_requests(survivors: DataFrame, candidates: DataFrame, contexts: DataFrame, size: int = 40) -> DataFrame:
    """Abstaining answers with the context of their line, in batches of ``size`` inside a file: path, batch, candidate_id, line, symbol, context."""
    rows = survivors.filter("verdict = 'abstain'").select("candidate_id").join(candidates.select("candidate_id", "path", "line", "symbol", "snippet"), "candidate_id")
    joined = rows.join(contexts.withColumnRenamed("target", "line"), ["path", "line"], "left").withColumn("context", F.coalesce("context", "snippet"))
    order = Window.partitionBy("path").orderBy("line", "candidate_id")
    return joined.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int")).select("path", "batch", "candidate_id", "line", "symbol", "context")


def file_requests(unresolved: DataFrame, candidates: DataFrame, files: DataFrame, size: int = 20, most: int = 200_000) -> DataFrame:
    """What still abstains, by file and batch, with the file's text up to ``most`` characters: that bound is part of the rule."""
    rows = unresolved.filter("verdict = 'abstain'").select("candidate_id").join(candidates.select("candidate_id", "path", "line", "symbol", "snippet"), "candidate_id")
    order = Window.partitionBy("path").orderBy("line", "candidate_id")
    batches = rows.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int")).groupBy("path", "batch").agg(F.array_sort(F.collect_list(F.struct("line", "symbol", "candidate_id", "snippet"))).alias("items"))
    return batches.join(files.select("path", F.left("content", F.lit(most)).alias("file_text")), "path", "left")


def adaptive_batches(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Batch numbers inside each ``key``: at most ``BATCH`` rows, a huge text alone, half the rows where a long text is in, a cut before too many characters.

    Blocks of a key are numbered apart, see ``cuts``; ``order`` must be unique within a key.
    """
    found = greedy_groups(rows, key, order, F.length(text), adaptive_cuts(BATCH, LONG_LINE, HUGE_LINE, BATCH_CHARS), BATCH)
    return found.select(key, order, F.col("group").cast("int").alias("batch"))


def abstain_rows(functions: DataFrame) -> DataFrame:
    """What is reported for each function while no model is asked."""
    return functions.select("function_id", F.lit("abstain").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit("medium").alias("severity"), F.left("body", F.lit(200)).alias("snippet"))

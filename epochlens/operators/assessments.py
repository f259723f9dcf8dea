"""Model assessments: aligning responses with requests, later passes, summaries, status, output filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import clamp_confidence, issue_class
from ..functions.text import blank_to_null, bound_reason, redact_paths

SCORED = "function_id string, summary string, confidence double, reason string"


def score_functions(functions: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Responses of a model for functions (function_id, body); without a scorer there is none."""
    if scorer is None:
        return functions.selectExpr("function_id", "cast(null as string) summary", "cast(null as double) confidence", "cast(null as string) reason").limit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)[["function_id", "summary", "confidence", "reason"]]

    return functions.mapInPandas(run, SCORED)


# What is said publicly of answers that could not be used.
REASONS = {
    "parse_gap": "No usable model output for this function",
    "missing_expected_result": "No usable model output for this function",
    "missing_function_id": "Model item missing function_id",
    "duplicate_conflict": "Conflicting model outputs for this function",
    "duplicate_function_id": "Duplicate function_id in model response",
    "invalid_result_schema": "Model item failed canonical schema validation",
    "unknown_function_id": "Model item referenced an unknown function_id",
    "analysis_error": "Model analysis failed for this function",
}
NO_REASON = "Model analysis could not be completed for this function"
PUBLIC = ("assessment_id", "function_id", "candidate_ids", "execution_status", "verdict", "confidence", "reason", "analysis_mode")
STATUS_ISSUES = {"duplicate": "duplicate_function_id", "invalid": "invalid_result_schema", "missing": "missing_expected_result", "unknown_id": "unknown_function_id"}


def is_operational(issue: Column) -> Column:
    """Whether an issue type tells of a failed call and not of the code."""
    return F.coalesce(issue.isin(*REASONS), F.lit(False))


def controlled_reason(issue: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), issue), F.lit(NO_REASON))


def public_reason(status: Column, issue: Column, text: Column) -> Column:
    """A fixed text for what failed, else the model's own words, without paths, bounded; null without words."""
    return F.when(status == "analysis_error", controlled_reason(issue)).otherwise(bound_reason(redact_paths(blank_to_null(text))))


def verdict_of(summary: Column) -> Column:
    """A model's summary as a verdict; everything but yes and no abstains."""
    return F.when(summary.isin("yes", "no"), summary).otherwise("abstain")


def align(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per requested function and one per unknown response id: status and verdict.

    An id that is answered twice is void; a summary outside the vocabulary is invalid; no answer is missing.
    """
    answers = responses.groupBy("function_id").agg(F.count(F.lit(1)).alias("n"), F.min("summary").alias("summary"), F.min("confidence").alias("confidence"), F.min("reason").alias("reason"))
    asked = requests.select("function_id").distinct().withColumn("asked", F.lit(True))
    both = asked.join(answers, "function_id", "full_outer")
    verdict = issue_class(F.col("summary"))
    status = F.when(F.col("asked").isNull(), "unknown_id").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(verdict == "unknown", "invalid").otherwise("completed")
    done = F.col("status") == "completed"
    return both.withColumn("status", status).select("function_id", "status", F.when(done, verdict).alias("verdict"), F.when(done, clamp_confidence(F.col("confidence"))).alias("confidence"), F.when(done, bound_reason(F.col("reason"))).alias("reason"))


def align_items(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Judged items (``wire.judge_items``) joined with the functions asked about: one analysis per function.

    function_id, status, issue_type, summary, confidence, issues, needs_more_context, needs. An id that several items have, whatever their form,
    is void; an item with a problem counts for its id where that is a text; the rest is missing.
    """
    claimed = items.filter("function_id is not null").groupBy("function_id").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("problem", "summary", "confidence", "issues", "needs_more_context", "needs")).alias("i"))
    joined = requests.select("function_id", "start_line").join(claimed, "function_id", "left")
    failed = F.when(F.col("n").isNull(), "missing_expected_result").when(F.col("n") > 1, "duplicate_function_id").when(F.col("i.problem").isNotNull(), "invalid_result_schema")
    ok = F.col("issue_type").isNull()
    stub = F.array(F.struct(F.col("issue_type").alias("type"), F.col("start_line").alias("line"), controlled_reason(F.col("issue_type")).alias("description")))
    return joined.withColumn("issue_type", failed).select(
        "function_id", F.when(ok, "completed").otherwise("analysis_error").alias("status"), "issue_type", F.when(ok, F.col("i.summary")).otherwise("abstain").alias("summary"), F.when(ok, F.col("i.confidence")).otherwise(0.0).alias("confidence"),
        F.when(ok, F.col("i.issues")).otherwise(stub).alias("issues"), F.coalesce(ok & F.col("i.needs_more_context"), F.lit(False)).alias("needs_more_context"), F.when(ok, F.col("i.needs")).otherwise(F.array().cast("array<string>")).alias("needs"),
    )


def item_diagnostics(requests: DataFrame, items: DataFrame) -> DataFrame:
    """How many items have an unknown id, no id, an id that is no text or are no objects, and how many ids occur more than once."""
    ids = requests.select("function_id").distinct().withColumn("asked", F.lit(True))
    rows = items.join(ids, "function_id", "left")
    per_id = rows.filter("function_id is not null").groupBy("function_id").agg(F.count(F.lit(1)).alias("n"), F.max("asked").alias("asked"))
    known = per_id.agg(F.coalesce(F.sum(F.when(F.col("asked").isNull(), F.col("n"))), F.lit(0)).alias("unknown_function_id"), F.count_if(F.col("n") > 1).alias("duplicate_function_id"))
    other = items.agg(F.count_if(F.col("function_id").isNull() & F.coalesce(F.col("has_id") == False, F.lit(False))).alias("missing_function_id"), F.count_if(F.col("function_id").isNull() & F.coalesce(F.col("has_id"), F.lit(True))).alias("invalid_item"))  # noqa: E712
    # Two tables of one row each.
    return known.crossJoin(other)


def conflicts(left: Column, right: Column) -> Column:
    """Whether two summaries of one function differ."""
    return ~F.lower(left).eqNullSafe(F.lower(right))


def counts_by_execution(analyses: DataFrame, by: str | None = None) -> DataFrame:
    """Yes, no, abstain and failed analyses, in all or for each batch; failed ones are no abstentions."""
    s = F.lower("summary")
    ok = F.col("status") != "analysis_error"
    groups = analyses.groupBy(by) if by else analyses.groupBy()
    return groups.agg(F.count_if(ok & (s == "yes")).alias("yes"), F.count_if(ok & (s == "no")).alias("no"), F.count_if(ok & ~s.isin("yes", "no")).alias("abstain"), F.count_if(~ok).alias("analysis_errors"), F.count(F.lit(1)).alias("total"))


def counts_text(yes: Column, no: Column, abstain: Column, errors: Column) -> Column:
    base = F.concat(yes.cast("string"), F.lit(" yes, "), no.cast("string"), F.lit(" no, "), abstain.cast("string"), F.lit(" abstain"))
    return F.when(errors > 0, F.concat(base, F.lit(", "), errors.cast("string"), F.lit(" analysis_error"))).otherwise(base)


def finding_counts(findings: DataFrame) -> DataFrame:
    """Verdicts over finding rows."""
    v = F.col("verdict")
    return findings.agg(*[F.count_if(v == x).alias(x) for x in ("yes", "no", "abstain")], F.count(F.lit(1)).alias("total"))


def function_counts(findings: DataFrame) -> DataFrame:
    """Verdicts over functions: that of each function's first finding; findings without a function count by place."""
    key = F.coalesce("function_id", F.concat_ws(":", "path", F.col("line").cast("string")))
    return finding_counts(findings.groupBy(key.alias("k")).agg(F.min_by("verdict", "finding_id").alias("verdict")))


def with_ids(assessments: DataFrame, mode: str = "function_first") -> DataFrame:
    """Rows of ``align`` with candidate_ids, as assessments: execution status, public reason, id."""
    issue = F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_ISSUES.items() for x in pair]), F.col("status"))
    state = F.when(F.col("status").isin("completed", "not_requested"), F.col("status")).otherwise("analysis_error")
    return assessments.select(
        F.concat(F.lit("assessment:"), "function_id").alias("assessment_id"), "function_id", "candidate_ids", state.alias("execution_status"), F.when(state == "completed", F.col("verdict")).alias("verdict"), F.when(state == "completed", clamp_confidence(F.col("confidence"))).alias("confidence"),
        public_reason(state, issue, F.col("reason")).alias("reason"), F.lit(mode).alias("analysis_mode"),
    )


def public_rows(assessments: DataFrame) -> DataFrame:
    """Only the public columns, bounded again; missing ones get their defaults."""
    c = assessments.columns
    get = lambda name, default: F.coalesce(F.col(name), default) if name in c else default
    none = F.lit(None)
    return assessments.select(
        get("assessment_id", F.lit("assessment:unknown")).alias("assessment_id"), get("function_id", F.lit("unknown")).alias("function_id"), get("candidate_ids", F.array().cast("array<string>")).alias("candidate_ids"),
        get("execution_status", F.lit("analysis_error")).alias("execution_status"), (F.col("verdict") if "verdict" in c else none.cast("string")).alias("verdict"), (clamp_confidence(F.col("confidence")) if "confidence" in c else none.cast("double")).alias("confidence"),
        (bound_reason(redact_paths(F.col("reason"))) if "reason" in c else none.cast("string")).alias("reason"), get("analysis_mode", F.lit("function_first")).alias("analysis_mode"),
    )


def in_order(assessments: DataFrame) -> DataFrame:
    return assessments.orderBy("assessment_id")


def serialized_summary(rows: DataFrame, findings: int) -> DataFrame:
    """Counts over public rows."""
    s, v = F.col("execution_status"), F.col("verdict")
    done = s == "completed"
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), *[F.count_if(done & (v == x)).alias(x) for x in ("yes", "no", "abstain")], F.count_if(s == "analysis_error").alias("analysis_errors"), F.count_if(s == "not_requested").alias("not_requested"), F.lit(findings).cast("long").alias("findings"))


def statuses(assessments: DataFrame) -> DataFrame:
    """The execution status of each function that has one."""
    rows = assessments.filter(blank_to_null(F.col("function_id")).isNotNull() & blank_to_null(F.col("execution_status")).isNotNull())
    return rows.groupBy("function_id").agg(F.max(F.trim("execution_status")).alias("execution_status"))


def triage_survivors(rows: DataFrame, floor: float) -> DataFrame:
    """Line answers that go on: no negative ones, and positive ones only from the floor."""
    return rows.filter((F.col("verdict") != "no") & ((F.col("verdict") != "yes") | (F.coalesce("confidence", F.lit(0.0)) >= floor)))


def abstain_lines(candidates: DataFrame) -> DataFrame:
    """Answers to candidates while no model is asked."""
    return candidates.select("candidate_id", F.lit("abstain").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit("LLM analysis disabled").alias("reason"))


def upsert(passes: DataFrame) -> DataFrame:
    """The row of the latest pass of each function."""
    return passes.groupBy("function_id").agg(F.max_by(F.struct(*[c for c in passes.columns if c != "function_id"]), "pass_no").alias("r")).select("function_id", "r.*")


def summary(assessments: DataFrame) -> DataFrame:
    s, v = F.col("status"), F.col("verdict")
    return assessments.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s != "completed").alias("errors"),
        *[F.count_if((s == "completed") & (v == x)).alias(x) for x in ("yes", "no", "abstain")],
    )


def run_status(assessments: DataFrame, requested: bool = True) -> DataFrame:
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") != "completed")
    return assessments.agg(F.when(~F.lit(requested), "not_requested").when(failed == 0, "complete").when(done == 0, "failed").otherwise("partial").alias("run_status"))


def escalated(assessments: DataFrame) -> DataFrame:
    """Only completed abstentions go to the next pass."""
    return assessments.filter("status = 'completed' and verdict = 'abstain'")


def replace_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of functions in ``new`` take the place of those in ``old``."""
    return old.join(new.select("function_id").distinct(), "function_id", "left_anti").unionByName(new)


def output_filter(findings: DataFrame, include_no: bool = False, detect_y2106: bool = False) -> DataFrame:
    """Negative findings go unless asked for; a positive second check stays where it is enabled."""
    keep = (F.col("verdict") != "no") | F.lit(include_no)
    return findings.filter(keep | (F.lit(detect_y2106) & (F.col("y2106") == "yes")))


def known_ids(assessments: DataFrame, candidates: DataFrame) -> DataFrame:
    """Assessments with only those candidate ids that exist, in their order."""
    rows = assessments.select("function_id", F.posexplode_outer("candidate_ids").alias("pos", "candidate_id"))
    ok = rows.join(candidates.select("candidate_id").distinct().withColumn("there", F.lit(True)), "candidate_id", "left")
    ids = F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("pos", "candidate_id"))))
    return ok.groupBy("function_id").agg(F.transform(ids, lambda x: x["candidate_id"]).alias("candidate_ids"))

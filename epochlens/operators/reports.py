"""Report-time operations on findings and result documents: normalising, filters, orders, groups, counts, text and HTML."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import coerce_confidence, derived_risk, issue_class, positive_int, risk_rank
from ..functions.text import blank_to_null, canonical_rule, function_id_start, plural, script_json
from ..sources.documents import piece
from ..sources.files import glob_regex

#: Fields of a finding as it may come, besides the two it must have; missing ones are null.
RAW_FIELDS = {
    "symbol": "string", "rule_id": "string", "rule": "string", "check_id": "string", "issue_type": "string", "issues": "array<struct<type:string,line:int,description:string>>", "migration_risk_type": "string",
    "y2038_issue": "string", "verdict": "string", "y2106_issue": "string", "confidence": "string", "severity": "string", "region": "struct<start_line:int,end_line:int>", "lines": "array<int>", "function_id": "string",
    "reason": "string", "source_snippet": "string",
}
NOTE = "Automated analysis; absence of findings is no proof of absence of issues."


def _with_fields(raw: DataFrame) -> DataFrame:
    return raw.withColumns({n: F.lit(None).cast(t) for n, t in RAW_FIELDS.items() if n not in raw.columns})


def rule_name() -> Column:
    """The first of the fields that may name a rule, in canonical form."""
    types = F.get(F.filter(F.transform("issues", lambda i: blank_to_null(i["type"])), lambda t: t.isNotNull()), F.lit(0))
    named = F.coalesce(*[blank_to_null(F.col(c)) for c in ("rule_id", "rule", "check_id", "issue_type")], types, *[blank_to_null(F.col(c)) for c in ("symbol", "migration_risk_type")])
    return F.coalesce(F.nullif(canonical_rule(named), F.lit("")), F.lit("UNSPECIFIED_RULE"))


def region() -> Column:
    """Struct of first and last line: the region where it has both, else the smallest and largest of the lines."""
    start, end = positive_int(F.col("region.start_line")), positive_int(F.col("region.end_line"))
    lines = F.filter(F.transform("lines", positive_int), lambda x: x.isNotNull())
    whole = start.isNotNull() & end.isNotNull()
    return F.struct(F.when(whole, start).otherwise(F.array_min(lines)).alias("start_line"), F.when(whole, end).otherwise(F.array_max(lines)).alias("end_line"))


def affected_lines(start: Column, end: Column) -> Column:
    """The lines of the issues, else all from the first to the last, else the lines given."""
    issues = F.array_sort(F.array_distinct(F.filter(F.transform("issues", lambda i: positive_int(i["line"])), lambda x: x.isNotNull())))
    lines = F.array_sort(F.array_distinct(F.filter(F.transform("lines", positive_int), lambda x: x.isNotNull())))
    return F.when(F.size(issues) > 0, issues).when(start.isNotNull() & (end >= start), F.sequence(start, end)).otherwise(F.coalesce(lines, F.array().cast("array<int>")))


def normalize_findings(raw: DataFrame) -> DataFrame:
    """finding_id, file, symbol, rule_id, class, confidence, risk, risk source, first and last line; and what reports show besides."""
    rows = _with_fields(raw).withColumn("__r", region())
    confidence = coerce_confidence(F.col("confidence"))
    r = derived_risk(F.col("severity"), confidence)
    verdict = issue_class(F.coalesce("y2038_issue", "verdict"))
    return rows.select(
        "finding_id", F.coalesce("file", F.lit("<unknown-file>")).alias("file"), "symbol", rule_name().alias("rule_id"), verdict.alias("issue_class"), confidence.alias("confidence"), r["risk"].alias("risk"), r["source"].alias("risk_source"),
        F.col("__r.start_line").alias("start_line"), F.col("__r.end_line").alias("end_line"), affected_lines(F.col("__r.start_line"), F.col("__r.end_line")).alias("affected_lines"), "function_id",
        F.lower(F.trim("y2106_issue")).alias("y2106_issue"), blank_to_null(F.col("issue_type")).alias("issue_type"), F.coalesce(blank_to_null(F.col("reason")), F.lit("No reason provided.")).alias("reason"), F.col("source_snippet").alias("snippet"),
    )


def reject_findings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON texts of findings (pos, body): those that are objects, parsed, and a warning for each other one."""
    kinds = ", ".join(f"{n} {t}" for n, t in RAW_FIELDS.items())
    parsed = raw.withColumn("j", F.from_json("body", f"file string, {kinds}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.trim("body").startswith("{") & F.col("j._bad").isNull() & F.col("j").isNotNull()
    warned = parsed.filter(~F.coalesce(good, F.lit(False))).select("pos", F.concat(F.lit("finding "), F.col("pos").cast("string"), F.lit(" is no object")).alias("warning"))
    return parsed.filter(good).select("pos", F.col("pos").cast("string").alias("finding_id"), "j.*").drop("_bad"), warned


def is_positive() -> Column:
    return (F.col("issue_class") == "yes") | F.coalesce(F.col("y2106_issue") == "yes", F.lit(False))


def apply_filters(findings: DataFrame, only: str | None = None, min_confidence: float | None = None, globs: list[str] | None = None, rules: list[str] | None = None) -> DataFrame:
    """``only``: a class; yes holds for either check."""
    out = findings
    if only:
        out = out.filter(is_positive() if only == "yes" and "y2106_issue" in findings.columns else F.col("issue_class") == only)
    if min_confidence is not None:
        out = out.filter(F.col("confidence") >= min_confidence)
    if globs:
        # A star crosses folders here.
        out = out.filter(F.regexp_like("file", F.lit("|".join(glob_regex(g.replace("*", "**").replace("****", "**")) for g in globs))))
    if rules:
        out = out.filter(F.col("rule_id").isin(*rules))
    return out


def sort_keys(by: str) -> list[Column]:
    """Keys of the four orders; a confidence of 0 ranks as missing where risk leads."""
    c = F.col
    at = [c("file").asc_nulls_last(), c("start_line").asc_nulls_last(), c("finding_id").asc(), c("rule_id").asc_nulls_last(), c("confidence").asc_nulls_last(), c("end_line").asc_nulls_last()]
    return {
        "file": at, "line": [c("start_line").asc_nulls_last(), *at],
        "risk": [risk_rank(c("risk")).desc(), F.coalesce(F.nullif(c("confidence"), F.lit(0.0)), F.lit(-1.0)).desc(), *at],
        "confidence": [F.coalesce(c("confidence"), F.lit(-1.0)).desc(), *at],
    }[by]


def top(findings: DataFrame, by: str, n: int) -> DataFrame:
    """The first ``n`` in an order, numbered from 1; only those rows meet in one task."""
    first = findings.orderBy(*sort_keys(by)).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*sort_keys(by))))


def group_findings(findings: DataFrame, key: str = "rule_id") -> DataFrame:
    return findings.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("issue_class") == "yes").alias("n_yes"), F.max("confidence").alias("top_confidence"), F.array_sort(F.collect_set("file")).alias("files"))


def class_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("issue_class").agg(F.count(F.lit(1)).alias("n"))


def snippet_lines(snippets: DataFrame) -> DataFrame:
    """snippet, base_line, affected -> numbered lines with a mark on the affected ones."""
    numbered = F.transform(F.split("snippet", "\n", -1), lambda t, i: F.struct((F.col("base_line") + i).alias("line_no"), t.alias("text"), F.array_contains("affected", F.col("base_line") + i).alias("is_affected")))
    return snippets.select("finding_id", F.inline(numbered))


def snippet_base() -> Column:
    """The line that a finding's text begins at: that of its function, else its own first line."""
    return F.coalesce(function_id_start(F.col("function_id")), F.col("start_line"), F.array_min("affected_lines"))


def display_class(findings: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Adds ``shown_class``: yes, yes by the second check, analysis_error where the function's assessment failed, else the class."""
    rows = findings
    if statuses is not None:
        # Findings without a function get keys of their own, numbers, so that they are dealt over all tasks; ids have a letter before them.
        named = lambda c: F.concat(F.lit("f"), c)
        key = F.coalesce(named(F.col("function_id")), F.monotonically_increasing_id().cast("string"))
        rows = findings.withColumn("__f", key).join(statuses.select(named(F.col("function_id")).alias("__f"), F.col("execution_status").alias("__s")), "__f", "left").drop("__f")
    failed = F.lit(False) if statuses is None else F.coalesce(F.col("__s") == "analysis_error", F.lit(False))
    shown = F.when(F.col("issue_class") == "yes", "yes").when(F.col("y2106_issue") == "yes", "yes(y2106)").when(failed, "analysis_error").otherwise(F.col("issue_class"))
    return rows.withColumn("shown_class", shown).drop("__s")


# ---- documents


def candidate_counts(documents: DataFrame) -> DataFrame:
    """Counts of candidates of result documents (doc, meta, candidates, findings): those in meta, else counted."""
    meta = lambda k: F.get_json_object("meta", f"$.candidate_summary.{k}").try_cast("long")
    given = F.get_json_object("meta", "$.candidate_summary").isNotNull()
    has = lambda x: x["function_id"].isNotNull() | F.coalesce(x["analysis_coverage"] == "grouped", F.lit(False))
    grouped = F.size(F.filter("candidates", has))
    own = {"total": F.size("candidates"), "grouped": grouped, "ungrouped": F.size("candidates") - grouped, "functions_with_candidates": F.size(F.array_distinct(F.array_compact(F.transform("candidates", lambda x: x["function_id"])))), "findings": F.size("findings")}
    return documents.select("doc", *[F.when(given, F.coalesce(meta(k), F.lit(0) if k != "findings" else v.cast("long"))).otherwise(v).cast("long").alias(k) for k, v in own.items()])


def assessment_counts(documents: DataFrame) -> DataFrame:
    """Counts of assessments of result documents (doc, meta, assessments): those in meta, else counted; and the status of the run."""
    meta = lambda k: F.get_json_object("meta", f"$.assessment_summary.{k}").try_cast("long")
    given = F.get_json_object("meta", "$.assessment_summary").isNotNull()
    n = lambda test: F.size(F.filter("assessments", test))
    done = lambda a: a["execution_status"] == "completed"
    said = lambda v: lambda a: done(a) & (a["verdict"] == v)
    own = {
        "total": F.size("assessments"), "completed": n(done), **{v: n(said(v)) for v in ("yes", "no", "abstain")}, "analysis_errors": n(lambda a: a["execution_status"] == "analysis_error"), "not_requested": n(lambda a: a["execution_status"] == "not_requested"),
    }
    return documents.select("doc", *[F.when(given, F.coalesce(meta(k), F.lit(0))).otherwise(v).cast("long").alias(k) for k, v in own.items()], F.get_json_object("meta", "$.analysis_status").alias("analysis_status"))


def empty_message(candidates: Column, ungrouped: Column, shown: Column, has_section: Column) -> Column:
    """What a report says of candidates and missing findings."""
    n, u = candidates.cast("string"), ungrouped.cast("string")
    none = (candidates == 0) & (shown == 0)
    return (
        F.when(~has_section, F.when(shown == 0, "No findings match the selected filters.").otherwise("")).when(none, "No deterministic candidates were found.")
        .when(shown == 0, F.concat(F.lit("No model-retained findings were produced; "), n, F.lit(" deterministic candidates were recorded for review.")))
        .when(candidates > 0, F.concat(n, F.lit(" deterministic candidates were recorded"), F.when(ungrouped > 0, F.concat(F.lit(", including "), u, F.lit(" candidates not grouped into a recognized function."))).otherwise("."))).otherwise("")
    )


def provenance(meta: Column) -> Column:
    """Provider, model and effort of a run on one line; null without a model."""
    get = lambda k: blank_to_null(F.get_json_object(meta, f"$.{k}"))
    part = lambda name, k: F.when(get(k).isNotNull(), F.concat(F.lit(f"{name}: "), get(k)))
    return F.when(get("model").isNotNull(), F.concat_ws(" | ", part("provider", "llm_provider"), part("model", "model"), part("reasoning_effort", "reasoning_effort")))


# ---- text and HTML


def _show(value: Column, other: str) -> Column:
    return F.coalesce(blank_to_null(value.cast("string")), F.lit(other))


def _confidence(value: Column) -> Column:
    return F.coalesce(F.format_string("%.2f", value), F.lit("N/A"))


def _lines_of() -> Column:
    return F.when(F.col("start_line").isNull(), "N/A").when(F.col("end_line").isNull() | (F.col("end_line") == F.col("start_line")), F.col("start_line").cast("string")).otherwise(F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")))


def finding_text(rank: Column, total: Column) -> Column:
    """A finding as a block of text, with its numbered lines; over rows of ``display_class``."""
    base = snippet_base()
    text = F.replace(F.col("snippet"), F.lit("\\n"), F.lit("\n"))
    text = F.when(F.contains(F.col("snippet"), F.lit("\n")), F.col("snippet")).otherwise(text)
    number = lambda i: F.lpad(F.coalesce((base + i).cast("string"), F.lit("?")), 5, " ")
    mark = lambda i: F.when(F.coalesce(F.array_contains("affected_lines", base + i), F.lit(False)), ">>> ").otherwise("    ")
    lines = F.transform(F.split(F.coalesce(blank_to_null(text), F.lit("<no snippet>")), r"\r\n|\r|\n", -1), lambda t, i: F.concat(number(i), F.lit(" | "), mark(i), t))
    several = F.coalesce(F.col("end_line") != F.col("start_line"), F.lit(False))
    return F.concat_ws(
        "\n", F.concat(F.lit("Finding "), rank.cast("string"), F.lit(" of "), total.cast("string")), F.concat(F.lit("Rule: "), "rule_id"), F.concat(F.lit("Risk: "), F.initcap("risk")), F.concat(F.lit("File: "), "file"),
        F.concat(F.when(several, "Lines: ").otherwise("Line: "), _lines_of()), F.concat(F.lit("Confidence: "), _confidence(F.col("confidence"))), F.lit(""), F.concat(F.lit("Issue: "), "shown_class", F.lit(" classification for this candidate.")),
        F.concat(F.lit("Why flagged: "), "reason"), F.lit(""), F.array_join(lines, "\n"),
    )


def finding_line(rank: Column) -> Column:
    """A finding on one line."""
    return F.concat(F.lit("["), F.lpad(rank.cast("string"), 3, " "), F.lit("] "), F.lpad("shown_class", 14, " "), F.lit(" "), F.lpad("risk", 8, " "), F.lit(" "), F.lpad(_confidence(F.col("confidence")), 5, " "), F.lit(" "), F.col("file"), F.lit(":"), _lines_of(), F.lit(" "), F.col("rule_id"))


def candidate_text(rank: Column, total: Column) -> Column:
    """A candidate as a block of text."""
    c = F.col
    fields = {"candidate_id": _show(c("candidate_id"), ""), "discovery_method": _show(c("discovery_method"), "unknown"), "rule_id": _show(c("rule_id"), "(none)"), "risk": _show(c("risk"), ""), "symbol": _show(c("symbol"), ""), "file": _show(c("file"), ""), "line": _show(c("line"), ""), "analysis_coverage": _show(c("analysis_coverage"), "ungrouped"), "function_id": _show(c("function_id"), "(ungrouped)"), "snippet": F.replace(F.coalesce("one_line_snippet", F.lit("")), F.lit("\n"), F.lit(" "))}
    return F.concat_ws("\n", F.concat(F.lit("Candidate "), rank.cast("string"), F.lit(" of "), total.cast("string")), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()])


def assessment_text(rank: Column, total: Column) -> Column:
    """An assessment as a block of text."""
    c = F.col
    ids = F.when(F.size("candidate_ids") > 0, F.array_join("candidate_ids", ", ")).otherwise("(none)")
    fields = {"assessment_id": _show(c("assessment_id"), ""), "function_id": _show(c("function_id"), ""), "execution_status": _show(c("execution_status"), ""), "verdict": _show(c("verdict"), "(none)"), "confidence": _confidence(c("confidence")), "candidate_ids": ids, "reason": _show(c("reason"), "")}
    return F.concat_ws("\n", F.concat(F.lit("Assessment "), rank.cast("string"), F.lit(" of "), total.cast("string")), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()])


def escape(value: Column) -> Column:
    """Text that may stand in HTML."""
    out = value
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def finding_json(rank: Column) -> Column:
    """What the page's filter knows of a finding, as JSON that may stand in a script."""
    return script_json(F.to_json(F.struct(rank.alias("index"), F.col("file").alias("file_path"), "rule_id", F.col("reason").alias("reason_short"), F.col("shown_class").alias("issue_class"), "confidence")))


def finding_card(rank: Column) -> Column:
    """A finding as an HTML element."""
    return F.concat(
        F.lit('<details class="card" id="finding-'), rank.cast("string"), F.lit('"><summary><span class="badge '), escape(F.col("shown_class")), F.lit('">'), escape(F.col("shown_class")), F.lit("</span> Finding "), rank.cast("string"), F.lit(": "), escape(F.col("rule_id")),
        F.lit(' <span class="meta">'), escape(F.col("file")), F.lit(" | risk "), escape(F.col("risk")), F.lit(" | conf "), _confidence(F.col("confidence")), F.lit("</span></summary><p>"), escape(F.col("reason")), F.lit("</p><pre>"), escape(F.coalesce("snippet", F.lit(""))), F.lit("</pre></details>"),
    )


def numbered(findings: DataFrame, by: str) -> DataFrame:
    """All findings in an order, numbered from 1 in ``rank``. The numbers are made in two steps, so no task sees all rows."""
    parts = findings.repartitionByRange(*sort_keys(by)).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*sort_keys(by)).checkpoint()
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # As many rows as there are partitions.
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*sort_keys(by)))
    return parts.join(F.broadcast(before), "__part").withColumn("rank", own + F.col("__before")).drop("__part", "__before")


def report_lines(findings: DataFrame, by: str = "risk", list_mode: bool = False, statuses: DataFrame | None = None) -> DataFrame:
    """All findings of a report as texts, in order by ``rank``; write them as text for a report of any length."""
    rows = numbered(display_class(findings, statuses), by)
    total = F.lit(findings.count())
    return rows.select("rank", (finding_line(F.col("rank")) if list_mode else finding_text(F.col("rank"), total)).alias("value"))


def count_line(n: int, one: str, many: str, spark) -> str:
    return spark.range(1).select(plural(F.lit(n), one, many)).first()[0]


def _shown(n: int, total: int) -> str:
    return "" if n >= total else f"Shown: the first {n} of {total} findings by risk. The full list is the table itself (report_lines).\n"


SHOW = (
    "const show=()=>{const q=document.getElementById('q').value.toLowerCase();const c=document.getElementById('c').value;const m=parseFloat(document.getElementById('m').value);"
    "rows.forEach(r=>{const ok=JSON.stringify(r).toLowerCase().includes(q)&&(!c||r.issue_class===c)&&(isNaN(m)||(r.confidence??-1)>=m);document.getElementById('finding-'+r.index).hidden=!ok;});};"
    "['q','c','m'].forEach(i=>document.getElementById(i).oninput=show);show();</script></body></html>"
)


def render_text(findings: DataFrame, most: int = 1000, list_mode: bool = True, meta: str | None = None) -> str:
    """A plain report of the first ``most`` findings by risk, which says so where there are more; counts cover all."""
    counts = {r["issue_class"]: r["n"] for r in class_counts(findings).collect()}
    total = sum(counts.values())
    rows = top(display_class(findings), "risk", most)
    texts = rows.select("rank", (finding_line(F.col("rank")) if list_mode else finding_text(F.col("rank"), F.lit(total))).alias("t")).orderBy("rank").collect()
    head = ", ".join(f"{k}: {v}" for k, v in sorted(counts.items()))
    told = findings.sparkSession.range(1).select(provenance(F.lit(meta))).first()[0] if meta else None
    body = ("\n" if list_mode else "\n\n").join(r["t"] for r in texts) or "No findings match the selected filters."
    return f"{NOTE}\n\n" + (f"{told}\n\n" if told else "") + f"Findings by class: {head or 'none'}\n{_shown(len(texts), total)}\n{body}"


def render_html(findings: DataFrame, title: str, most: int = 1000, group_by: str = "none") -> str:
    """A page with the first ``most`` findings as cards, in groups by file or rule, with a filter by text, class and confidence; it says where there are more."""
    total = findings.count()
    rows = top(display_class(findings), "risk", most)
    packed = rows.select("rank", "file", "rule_id", finding_json(F.col("rank")).alias("j"), finding_card(F.col("rank")).alias("h")).orderBy("rank").collect()
    data = ",".join(r["j"] for r in packed)
    groups: dict[str, list[str]] = {}
    for r in packed:
        groups.setdefault({"file": r["file"], "rule": r["rule_id"]}.get(group_by, "All findings"), []).append(r["h"])
    body = "".join(f"<h2>{html.escape(k)}</h2>{''.join(v)}" for k, v in sorted(groups.items()))
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{html.escape(NOTE)}</p><p>{html.escape(_shown(len(packed), total))}</p>"
        f"<input id='q' placeholder='text'><select id='c'><option></option><option>yes</option><option>no</option><option>abstain</option></select><input id='m' type='number' step='0.05' min='0' max='1'>{body}"
        f"<script>const rows=[{data}];{SHOW}"
    )


def _rank_key() -> Column:
    return F.lpad(F.col("rank").cast("string"), 18, "0")


def text_pieces(findings: DataFrame, name: str, list_mode: bool = True, meta: str | None = None) -> DataFrame:
    """``render_text`` without its bound, as pieces for ``sources.documents.write_documents``."""
    counts = {r["issue_class"]: r["n"] for r in class_counts(findings).collect()}  # a row for each class
    rows, document = numbered(display_class(findings), "risk"), F.lit(name)
    told = findings.sparkSession.range(1).select(provenance(F.lit(meta))).first()[0] if meta else None
    head = f"{NOTE}\n\n" + (f"{told}\n\n" if told else "") + f"Findings by class: {', '.join(f'{k}: {v}' for k, v in sorted(counts.items())) or 'none'}\n\n" + ("" if counts else "No findings match the selected filters.")
    shown = finding_line(F.col("rank")) if list_mode else finding_text(F.col("rank"), F.lit(sum(counts.values())))
    return findings.sparkSession.range(1).select(*piece(document, 0, F.lit(""), F.lit(head))).unionByName(rows.select(*piece(document, 1, _rank_key(), shown, "\n" if list_mode else "\n\n")))


def html_pieces(findings: DataFrame, name: str, title: str, group_by: str = "none") -> DataFrame:
    """``render_html`` without its bound, as pieces for ``sources.documents.write_documents``."""
    rows, document, one = numbered(display_class(findings), "risk"), F.lit(name), findings.sparkSession.range(1)
    group = {"file": F.col("file"), "rule": F.col("rule_id")}.get(group_by, F.lit("All findings"))
    key = lambda rank: F.concat(group, F.lit("\0"), rank)
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{html.escape(NOTE)}</p><p></p>"
    tools = "<input id='q' placeholder='text'><select id='c'><option></option><option>yes</option><option>no</option><option>abstain</option></select><input id='m' type='number' step='0.05' min='0' max='1'>"
    cards = rows.select(*piece(document, 1, key(_rank_key()), finding_card(F.col("rank"))))
    titles = rows.select(group.alias("g")).distinct().select(*piece(document, 1, F.concat("g", F.lit("\0")), F.concat(F.lit("<h2>"), escape(F.col("g")), F.lit("</h2>"))))
    parts = [one.select(*piece(document, 0, F.lit(""), F.lit(head + tools))), titles, cards, one.select(*piece(document, 2, F.lit(""), F.lit("<script>const rows=["))), rows.select(*piece(document, 3, _rank_key(), finding_json(F.col("rank")), ",")), one.select(*piece(document, 4, F.lit(""), F.lit("];" + SHOW)))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_text(text: str, path: str) -> str:
    """Write a report where the driver can reach it; its folders are made."""
    from pathlib import Path

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")
    return str(target)

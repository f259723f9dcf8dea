"""The whole scan as one plan: from files to candidates, functions, evidence, assessments and findings, and to result documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import artifacts as Z
from ..operators import assessments as A
from ..operators import boundaries as B
from ..operators import candidates as C
from ..operators import closure as G
from ..operators import cparse as P
from ..operators import detectors as D
from ..operators import findings as N
from ..operators import matching as M
from ..operators.statements import statements
from ..session import ensure_checkpoints, shuffles_end
from ..sources.documents import pack, piece
from ..sources.documents import write_documents as write_long_documents
from ..sources.lines import split_lines, with_clean_text
from .passes import Asking, as_answers, run_passes
from .publication import publish

SCHEMA_VERSION = "1.2"


@dataclass(frozen=True)
class Options:
    """How a scan is run. Without a scorer no model is asked."""

    min_risk: str = "low"
    discovery: bool = True
    structural: bool = False
    io: bool = True
    io_threshold: float = B.THRESHOLD
    abi: B.Abi = field(default_factory=B.Abi)
    migrate_to: B.Abi | None = None
    include_no: bool = False
    detect_y2106: bool = False
    #: Detectors and I/O boundaries see whole statements, told at their first line; the catalog is matched line by line in any case.
    statements: bool = False
    scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None
    #: A model that is asked in passes; takes the place of a scorer.
    asking: Asking | None = None
    model: str = "none"
    provider: str = "none"


@dataclass(frozen=True)
class Scan:
    candidates: DataFrame
    conflicts: DataFrame
    metrics: DataFrame


@dataclass(frozen=True)
class Run:
    """Tables of a scan of files."""

    metrics: DataFrame
    typedefs: DataFrame
    aliases: DataFrame
    rules: DataFrame
    candidates: DataFrame
    conflicts: DataFrame
    io: DataFrame
    migration: DataFrame
    functions: DataFrame
    evidence: DataFrame
    assessments: DataFrame
    findings: DataFrame


def _define_rule(rules: DataFrame) -> bool:
    """Whether the catalog has the rule that switches the define scan on."""
    return not rules.filter(F.col("symbol") == "#define").isEmpty()


def found_rows(known: DataFrame, rules: DataFrame, min_risk: str = "low", with_defines: bool = True) -> DataFrame:
    """Candidate rows of the catalog and the detectors over lines with ``clean`` and context; with few rules in one pass, which keeps the lines dealt by path."""
    few = M.few_rules(rules, min_risk)
    if not few:
        return C.unite(M.match_rules(known, rules, min_risk), D.line_candidates(known, with_defines))

    def hits(kind: str) -> Column:
        text = lambda r, n: F.lit(r[n]).cast("string").alias(n)
        made = lambda r: F.struct(text(r, "symbol"), text(r, "risk"), text(r, "description"), F.lit("catalog_symbol_match").alias("discovery_method"), text(r, "rule_id"))
        return F.coalesce(M.rule_hits(few, made), F.array().cast(f"array<{kind}>"))

    return C.unite(D.line_candidates(M.with_terms(known, few), with_defines, hits))


def scan(lines: DataFrame, rules: DataFrame, min_risk: str = "low", aliases: DataFrame | None = None) -> Scan:
    """Catalog matches and line detectors over lines (path, line, text), united and deduplicated."""
    known = D.with_context(with_clean_text(lines), D.file_context(lines, aliases))
    kept, conflicts = C.dedupe(found_rows(known, rules, min_risk, _define_rule(rules)))
    return Scan(kept, conflicts, M.code_metrics(lines))


def discover(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Type definitions of all files, the aliases of the time type that each file sees, and their definitions."""
    typedefs = G.typedefs_of_files(files).checkpoint()
    edges = G.include_edges(lines, files).checkpoint()
    aliases = G.reached_aliases(typedefs, edges, D.TIME_TYPES).checkpoint()
    return typedefs, aliases, G.reached_definitions(aliases, typedefs, edges)


def scan_files(files: DataFrame, rules: DataFrame, options: Options = Options()) -> Run:
    """All stages over files (path, content).

    Aliases are found first and widen the catalog; candidates come from the catalog, the line detectors, I/O boundaries and, where a
    target platform is given, migration risks; each is then joined with the function that holds it, and functions with candidates are assessed.
    """
    # What several stages read is written once to the checkpoint folder; the shuffle files of a stage go when it is.
    ensure_checkpoints(files.sparkSession)
    with shuffles_end(files.sparkSession):
        return _scan_files(files, rules, options)


def _scan_files(files: DataFrame, rules: DataFrame, options: Options) -> Run:
    lines = split_lines(files)
    if options.discovery:
        typedefs, aliases, definitions = discover(files, lines)
        rules = Z.merge_catalog(rules, G.alias_rules(definitions)).checkpoint()
    else:
        typedefs, aliases = G.typedefs_of_files(files).filter(F.lit(False)), None
    known = D.with_context(with_clean_text(lines), D.file_context(lines, aliases)).checkpoint()
    seen = known
    if options.statements:
        whole = statements(lines).select("path", "line", "text")
        seen = D.with_context(with_clean_text(whole), D.file_context(whole, aliases)).checkpoint()
    rows = [M.match_rules(known, rules, options.min_risk), D.line_candidates(seen, _define_rule(rules))]
    io = B.scan_io(seen.join(B.io_files(known.select("path", "line", "text")), "path", "left_semi") if options.io else seen.filter(F.lit(False)), options.abi, options.io_threshold).checkpoint()
    found, _ = C.dedupe(C.unite(*rows))
    kept = M.structural_filter(found, options.structural)
    rows = [kept.withColumnRenamed("snippet", "text"), B.io_candidates(io)]
    if options.migrate_to is None:
        candidates, conflicts = C.dedupe(C.unite(*rows))
        migration = found.select("path", "line", "symbol", *[F.lit("").alias(c) for c in ("risk_type", "severity", "description", "remediation")]).filter(F.lit(False))
    else:
        before, found_conflicts = C.dedupe(C.unite(*rows))
        before = before.checkpoint()
        metadata = B.io_metadata(io)
        migration = B.migration_risks(before, options.abi, options.migrate_to, aliases).unionByName(B.io_migration_risks(metadata, options.abi, options.migrate_to)).checkpoint()
        # Places with a risk and no candidate yet; they cannot meet one of those.
        more, conflicts = C.dedupe(C.unite(B.migration_candidates(migration, before)))
        candidates, conflicts = before.unionByName(more), found_conflicts.unionByName(conflicts)
    functions = P.scan_bodies(files).checkpoint()
    evidence = C.join_functions(candidates, functions).checkpoint()
    candidates = evidence.drop("function_id", "analysis_coverage")
    units = analysis_units(functions, evidence)
    assessments, findings = assess(units, options, files)
    findings = B.with_io_metadata(findings, B.io_metadata(io), migration).checkpoint()
    return Run(M.code_metrics(known), typedefs, aliases if aliases is not None else typedefs.select(F.col("path").alias("tu"), "alias", F.lit(0).alias("hop")), rules, candidates, conflicts, io, migration, functions, evidence, assessments, findings)


def analysis_units(functions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Functions that hold candidates, with their text and the candidates' lines and ids."""
    named = functions.withColumn("function_id", C.part_id(F.col("path"), F.col("name"), F.col("start_line"), F.col("end_line"), F.col("part")))
    return named.join(C.function_candidates(evidence).drop("path"), "function_id")


def assess(units: DataFrame, options: Options, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Assessments and findings of functions. Without a scorer every function is not asked about, and its finding abstains."""
    names = ["function_id", "path", "name", "start_line", "end_line", "candidate_lines", "candidate_ids", "body"]
    if options.asking is not None:
        answers = as_answers(run_passes(units.select(*names), files, options.asking, options.detect_y2106)).checkpoint()
        done = answers.drop("y2106").join(units.select("function_id", "candidate_ids"), "function_id")
        rows = N.assessed_findings(units.select(*names).join(answers.drop("y2106"), "function_id")).join(answers.select("function_id", "y2106"), "function_id")
        return A.with_ids(done), A.output_filter(rows, options.include_no, options.detect_y2106).drop("y2106")
    if options.scorer is None:
        none = units.select("function_id", F.lit("not_requested").alias("status"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("reason"), "candidate_ids").filter(F.lit(False))
        return A.with_ids(none), N.disabled_findings(units.select(*names))
    answers = A.align(units, A.score_functions(units.select("function_id", "body"), options.scorer))
    done = answers.filter("status <> 'unknown_id'").join(units.select("function_id", "candidate_ids"), "function_id")
    rows = units.select(*names).join(answers.select("function_id", "status", "verdict", "confidence", "reason"), "function_id")
    return A.with_ids(done), A.output_filter(N.assessed_findings(rows).withColumn("y2106", F.lit(None).cast("string")), options.include_no, options.detect_y2106).drop("y2106")


# ---- sinks


def write_scan(result: Scan, path: str) -> None:
    """Tables as Parquet; readers see them only when the job commits."""
    result.candidates.repartition("path").sortWithinPartitions("path", "line").write.mode("overwrite").parquet(f"{path}/candidates")
    result.conflicts.write.mode("overwrite").parquet(f"{path}/conflicts")
    result.metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def write_run(run: Run, path: str) -> None:
    """All tables of a run as Parquet, the rules and metrics as JSON lines."""
    for name in ("typedefs", "aliases", "candidates", "conflicts", "io", "migration", "functions", "evidence", "assessments", "findings"):
        getattr(run, name).write.mode("overwrite").parquet(f"{path}/{name}")
    run.rules.write.mode("overwrite").json(f"{path}/rules")
    run.metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def candidate_rows(evidence: DataFrame) -> Column:
    """A candidate as it stands in documents."""
    c = F.col
    return F.struct(
        "candidate_id", c("path").alias("file"), "line", F.coalesce("col_start", F.lit(0)).alias("col_start"), F.coalesce("col_end", F.lit(0)).alias("col_end"), "symbol", "risk", c("snippet").alias("one_line_snippet"),
        "description", "discovery_method", "rule_id", "function_id", "analysis_coverage",
    )


@dataclass(frozen=True)
class Told:
    """What documents tell of a run."""

    evidence: DataFrame
    assessments: DataFrame
    findings: DataFrame


def result_document(evidence: DataFrame, functions: DataFrame, options: Options = Options(), timestamp: str | None = None) -> DataFrame:
    """One JSON document per file with candidates, path and document: schema version, meta, candidates, assessments and findings, as ``result_documents`` has them for repositories.

    ``functions`` has path, name, start_line and end_line of what ``evidence`` was joined with, and part and body where they are known. Candidates of I/O and migration are those of the evidence.
    """
    known = functions.select("path", "name", "start_line", "end_line", *[F.col(c) if c in functions.columns else none.alias(c) for c, none in (("part", F.lit(0)), ("body", F.lit(None).cast("string")))])
    assessments, findings = assess(analysis_units(known, evidence), options)
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    findings = findings.select("*", *none("io_category", "io_function", "remediation_class", "migration_risk_type", "migration_severity", "migration_impact", "migration_remediation"))
    return result_documents(Told(evidence, assessments, findings), lambda path: path, options, timestamp=timestamp).withColumnRenamed("repo", "path")


NULLS = {"ignoreNullFields": "false"}


def document_items(run: Run | Told, repo: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """Candidates, assessments and findings as they stand in documents: repo, key, and the row as JSON, beside what is counted of it.

    Candidate ids that no candidate has are left out of assessments.
    """
    of = repo or (lambda path: F.lit("."))
    item = lambda row: F.to_json(row, NULLS).alias("text")
    path_of = F.regexp_extract("function_id", r"^(.*)@[^@]*$", 1)
    known = A.known_ids(run.assessments, run.evidence)
    public = A.public_rows(run.assessments.drop("candidate_ids").join(known, "function_id"))
    finding = F.struct("finding_id", F.col("path").alias("file"), F.coalesce("function_id", F.lit("unknown")).alias("function_id"), F.col("verdict").alias("y2038_issue"), "confidence", "severity", "issue_type", F.col("description").alias("reason"), F.array("line").alias("lines"), F.struct("start_line", "end_line").alias("region"), "io_category", "io_function", "remediation_class", "migration_risk_type", "migration_severity", "migration_impact", "migration_remediation")
    return {
        "candidates": run.evidence.select(of(F.col("path")).alias("repo"), F.col("candidate_id").alias("key"), item(candidate_rows(run.evidence)), "function_id"),
        "assessments": public.select(of(path_of).alias("repo"), F.col("assessment_id").alias("key"), item(F.struct(*A.PUBLIC)), "execution_status", "verdict"),
        "findings": run.findings.select(of(F.col("path")).alias("repo"), F.col("finding_id").alias("key"), item(finding)),
    }


def _per_repo(items: dict[str, DataFrame], with_texts: bool = False) -> DataFrame:
    """repo and what is counted of its rows, with the first key of each table, or with the rows' texts in order where these are wanted. Each table is read once."""
    state, done = F.col("execution_status"), F.col("execution_status") == "completed"
    n = F.count(F.lit(1))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda x: x["text"]), ",")
    more = lambda name: texts.alias(f"{name}_text") if with_texts else F.min("key").alias(f"{name}_text")
    functions = F.size(F.collect_set("function_id")).cast("long") if with_texts else F.count_distinct("function_id")
    c = items["candidates"].groupBy("repo").agg(n.alias("candidates"), F.count("function_id").alias("grouped"), functions.alias("functions"), more("candidates"))
    a = items["assessments"].groupBy("repo").agg(n.alias("assessments"), F.count_if(done).alias("completed"), *[F.count_if(done & (F.col("verdict") == v)).alias(v) for v in ("yes", "no", "abstain")], F.count_if(state == "analysis_error").alias("errors"), F.count_if(state == "not_requested").alias("not_requested"), more("assessments"))
    f = items["findings"].groupBy("repo").agg(n.alias("findings"), more("findings"))
    told = c.join(a, "repo", "full_outer").join(f, "repo", "full_outer")
    return told.select("repo", *[k if k.endswith("_text") else F.coalesce(k, F.lit(0)).alias(k) for k in told.columns if k != "repo"])


def _head(options: Options, root: str, rules_path: str, timestamp: str | None) -> Column:
    """The beginning of a document over rows of ``_per_repo``: schema version and meta, as JSON without the last brace."""
    k = F.col
    summary = F.struct(k("candidates").alias("total"), "grouped", (k("candidates") - k("grouped")).alias("ungrouped"), k("functions").alias("functions_with_candidates"), "findings")
    status = F.lit("not_requested") if options.scorer is None and options.asking is None else F.when((k("errors") > 0) & (k("completed") > 0), "partial").when(k("errors") > 0, "failed").otherwise("complete")
    assessed = F.struct(k("assessments").alias("total"), "completed", "yes", "no", "abstain", k("errors").alias("analysis_errors"), "not_requested", "findings")
    abi = F.struct(F.lit(options.abi.model).alias("hardware_model"), F.lit(options.abi.bits).alias("time_t_size_bits"), F.lit(options.abi.sign).alias("time_t_signed"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if timestamp is None else F.lit(timestamp)
    meta = F.struct(F.lit(root).alias("root"), F.lit(rules_path).alias("rules_path"), F.lit(options.model if options.scorer or options.asking else "none").alias("model"), F.lit(options.provider).alias("llm_provider"), stamp.alias("timestamp"), abi.alias("environment_config"), summary.alias("candidate_summary"), status.alias("analysis_status"), assessed.alias("assessment_summary"))
    return F.regexp_replace(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), meta.alias("meta")), NULLS), r"\}$", "")


def document_heads(items: dict[str, DataFrame], options: Options = Options(), root: str = ".", rules_path: str = "", timestamp: str | None = None) -> DataFrame:
    """repo and the beginning of its document. All counts are aggregated from the rows that the document will hold."""
    return _per_repo(items).select("repo", _head(options, root, rules_path, timestamp).alias("head"))


def result_documents(run: Run | Told, repo: Callable[[Column], Column] | None = None, options: Options = Options(), root: str = ".", rules_path: str = "", timestamp: str | None = None) -> DataFrame:
    """One JSON document per repository as a row: schema version, meta, candidates, assessments and findings, each in order.

    ``repo`` gives the repository of a path; without it there is one. A repository's rows meet in one task, as its document is one text; ``document_parts`` and ``document_pieces`` make the same
    documents for repositories of any size.
    """
    items = document_items(run, repo)
    parts = [x for name in items for x in (F.lit(f',"{name}":['), F.coalesce(f"{name}_text", F.lit("")), F.lit("]"))]
    return _per_repo(items, True).select("repo", F.concat(_head(options, root, rules_path, timestamp), *parts, F.lit("}")).alias("document"))


def document_parts(run: Run | Told, repo: Callable[[Column], Column] | None = None, options: Options = Options(), root: str = ".", rules_path: str = "", timestamp: str | None = None) -> DataFrame:
    """The documents of ``result_documents`` as rows of bounded length: repo, section, key, text. The texts of a repository, in order of section and key, are its document."""
    items = document_items(run, repo)
    heads = _per_repo(items).withColumn("head", _head(options, root, rules_path, timestamp))
    row = lambda section, key, bound, text: [F.col("repo").alias("document"), F.lit(section).alias("section"), key.alias("key"), F.left(bound, F.lit(64)).alias("bound"), text.alias("text")]
    none = F.lit("")
    out = heads.select(*row(0, none, none, F.col("head")))
    for k, (name, table) in enumerate(items.items()):
        opening = F.lit(("]" if k else "") + f',"{name}":[')
        out = out.unionByName(heads.select(*row(k + 1, none, F.coalesce(f"{name}_text", none), opening))).unionByName(table.select(*row(k + 1, F.col("key"), F.col("key"), F.col("text"))))
    return pack(out.unionByName(heads.select(*row(len(items) + 1, none, none, F.lit("]}"))))).withColumnRenamed("document", "repo")


def document_pieces(run: Run, repo: Callable[[Column], Column] | None = None, options: Options = Options(), root: str = ".", rules_path: str = "", timestamp: str | None = None) -> DataFrame:
    """The documents of ``result_documents`` as pieces for ``sources.documents.write_documents``: no row is longer than one candidate, assessment or finding."""
    items = document_items(run, repo)
    heads = document_heads(items, options, root, rules_path, timestamp)
    out = heads.select(*piece("repo", 0, F.lit(""), F.col("head")))
    for k, (name, table) in enumerate(items.items()):
        out = out.unionByName(heads.select(*piece("repo", 2 * k + 1, F.lit(""), F.lit(("]" if k else "") + f',"{name}":[')))).unionByName(table.select(*piece("repo", 2 * k + 2, "key", F.col("text"), ",")))
    return out.unionByName(heads.select(*piece("repo", 2 * len(items) + 1, F.lit(""), F.lit("]}"))))


TABLES = ("typedefs", "aliases", "rules", "candidates", "conflicts", "io", "migration", "functions", "evidence", "assessments", "findings", "metrics")


def publish_run(run: Run, path: str, options: Options = Options(), repo: Callable[[Column], Column] | None = None, root: str = ".", rules_path: str = "", timestamp: str | None = None) -> dict:
    """All tables of a run and its documents, which readers see together when the last one is there; returns the manifest."""
    pieces = document_pieces(run, repo, options, root, rules_path, timestamp)
    return publish(run.candidates.sparkSession, path, {name: getattr(run, name) for name in TABLES}, more=lambda folder: write_long_documents(pieces, f"{folder}/documents"))


def write_documents(documents: DataFrame, path: str) -> None:
    """A folder of JSON texts by repository."""
    documents.select("repo", F.col("document").alias("value")).repartition("repo").write.mode("overwrite").partitionBy("repo").text(path)

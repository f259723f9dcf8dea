"""Command line: scan a tree or a list of repositories, find a project's configuration, check an environment, and render results."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="epochlens", description="Source-risk scans on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="scan a tree of source files")
    scan.add_argument("root")
    scan.add_argument("out")
    repos = commands.add_parser("repos", help="scan the checked-out repositories of a list, all in one job")
    repos.add_argument("list", help="JSON lines with repo_url, ref, name, enabled, scan_overrides")
    repos.add_argument("root", help="folder that holds one folder per repository key")
    repos.add_argument("out")
    repos.add_argument("--repo", action="append", default=[], help="only repositories whose address or name holds this")
    repos.add_argument("--limit", type=int)
    repos.add_argument("--deadline", type=float, default=3600.0, help="seconds for the whole run")
    repos.add_argument("--dry-run", action="store_true")
    for sub in (scan, repos):
        sub.add_argument("--rules")
        sub.add_argument("--include", action="append")
        sub.add_argument("--exclude", action="append")
        sub.add_argument("--min-risk", choices=("low", "medium", "high"), default="medium")
        sub.add_argument("--max-file-size", type=int)
        sub.add_argument("--env-config", help="JSON file of the environment")
        sub.add_argument("--migrate-to", help="JSON file of the environment to come")
        sub.add_argument("--io-threshold", type=float, default=6.0)
        sub.add_argument("--no-io", action="store_true")
        sub.add_argument("--no-discovery", action="store_true")
        sub.add_argument("--include-no-findings", action="store_true")
        sub.add_argument("--publish", action="store_true", help="write a new version of the run, which readers see whole or not at all, with documents of any length")
    report = commands.add_parser("report", help="show the findings or candidates of a scan")
    report.add_argument("path")
    report.add_argument("--risk", choices=("low", "medium", "high"))
    report.add_argument("--top", type=int, default=100)
    render = commands.add_parser("render", help="render a result document, or every one of a run")
    render.add_argument("path")
    render.add_argument("--format", choices=("text", "html"), default="text")
    render.add_argument("--out")
    render.add_argument("--only", choices=("yes", "no", "abstain"))
    render.add_argument("--min-confidence", type=float)
    render.add_argument("--file", action="append")
    render.add_argument("--rule", action="append")
    render.add_argument("--nth", type=int, help="only this finding, counted from 1 in order of risk")
    detect = commands.add_parser("detect", help="find the data model and time type from build files")
    detect.add_argument("root")
    detect.add_argument("--format", choices=("text", "json"), default="text")
    env = commands.add_parser("env", help="check an environment file and add what follows from it")
    env.add_argument("path")
    env.add_argument("--out")
    return parser


def _abi(spark: SparkSession, path: str | None):
    from .operators.boundaries import Abi
    from .operators.wire import normalize_environment
    from .sources.files import read_environment

    found = read_environment(spark, path)
    if found is None:
        return None
    row = normalize_environment(found).first()
    return Abi(row["hardware_model"] or "LP64", row["time_t_size_bits"] or 64, (row["time_t_signed"] or "signed") == "signed")


def _options(spark: SparkSession, args: argparse.Namespace):
    from .operators.boundaries import Abi
    from .plans.scan import Options

    return Options(min_risk=args.min_risk, discovery=not args.no_discovery, io=not args.no_io, io_threshold=args.io_threshold, abi=_abi(spark, args.env_config) or Abi(), migrate_to=_abi(spark, args.migrate_to), include_no=args.include_no_findings)


def _rules(spark: SparkSession, args: argparse.Namespace):
    from .operators.matching import default_rules
    from .sources.files import read_rules

    return read_rules(spark, args.rules) if args.rules else default_rules(spark)


def _scan(spark: SparkSession, args: argparse.Namespace, of=None) -> int:
    from .plans.scan import publish_run, result_documents, scan_files, write_documents, write_run
    from .sources.files import list_tree, read_files, select_files

    kept, large, outside = select_files(list_tree(spark, args.root), args.include, args.exclude, args.max_file_size)
    files = read_files(spark, kept)
    options = _options(spark, args)
    run = scan_files(files.select("path", "content"), _rules(spark, args), options)
    if args.publish:
        manifest = publish_run(run, args.out, options, of, rules_path=args.rules or "")
        print(f"published {manifest['number']}: {manifest['id']}")
    else:
        write_run(run, args.out)
        write_documents(result_documents(run, of, options, root=".", rules_path=args.rules or ""), f"{args.out}/documents")
    print(f"files left out for their size: {large.count()}; links out of the root: {outside.count()}")
    return 0


def _repos(spark: SparkSession, args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from .operators import batches as T
    from .sources.files import check_overrides, read_repos

    good, warned = read_repos(spark, args.list)
    planned = T.plan(check_overrides(good), args.repo, args.limit)
    for row in warned.orderBy("source_line").toLocalIterator():
        print(f"line {row['source_line']}: {row['warning']}", file=sys.stderr)
    if args.dry_run:
        for row in planned.select("repo_key", "repo_url").orderBy("repo_key").toLocalIterator():
            print(row["repo_key"], row["repo_url"])
        return 0
    # A folder of a repository is its key.
    state, value = T.with_deadline(spark, lambda: _scan(spark, args, lambda path: F.element_at(F.split(path, "/"), 1)), args.deadline, "repos")
    if state != "ok":
        print(f"run {state}" + (f": {value}" if value else ""), file=sys.stderr)
        return 1
    return 0


def _report(spark: SparkSession, args: argparse.Namespace) -> int:
    from .plans.publication import current, published

    manifest = current(spark, args.path)
    found = published(spark, args.path, "candidates", manifest) if manifest else spark.read.parquet(f"{args.path}/candidates")
    found = found.filter(found.risk == args.risk) if args.risk else found
    for r in found.orderBy("path", "line", "symbol").limit(args.top).collect():
        print(f"{r['path']}:{r['line']} {r['risk']} {r['symbol']} {r['snippet']}")
    return 0


def _render_one(spark: SparkSession, args: argparse.Namespace, path: str, out: str | None) -> None:
    from pyspark.sql import functions as F

    from .operators import reports as R
    from .sources.files import read_results

    documents = read_results(spark, path)
    findings = R.apply_filters(R.normalize_findings(documents.select(F.inline("findings"))), args.only, args.min_confidence, args.file, args.rule)
    if args.nth:
        findings = R.top(findings, "risk", args.nth).filter(F.col("rank") == args.nth).drop("rank")
    meta = documents.select("meta").first()
    text = R.render_html(findings, path) if args.format == "html" else R.render_text(findings, list_mode=not args.nth, meta=meta[0] if meta else None)
    print(text) if out is None else R.write_text(text, out)


def _render(spark: SparkSession, args: argparse.Namespace) -> int:
    from .operators import batches as T

    mode, path = T.render_mode(args.path)
    if mode == "single":
        _render_one(spark, args, path, args.out)
        return 0
    from pathlib import Path

    for folder in T.repo_folders(path):
        found = T.findings_file(folder)
        if Path(found).is_file():
            _render_one(spark, args, found, f"{args.out or folder}/{Path(folder).name}.{'html' if args.format == 'html' else 'txt'}")
        else:
            print(f"{Path(folder).name}: no findings to render", file=sys.stderr)
    return 0


def _detect(spark: SparkSession, args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from .operators import environments as E
    from .sources.files import list_tree, read_files

    listed = list_tree(spark, args.root).filter("canonical is not null").withColumn("project", F.lit(args.root))
    wanted = E.make_files(listed).drop("n").unionByName(E.cmake_files(listed).drop("n"))
    files = wanted.select("project", "path").join(read_files(spark, wanted.select("path", "uri")), "path")
    scored = E.likelihoods(spark, E.detect(E.project_info(files, listed)).withColumnRenamed("project", "key"))
    row = (E.likelihood_json(scored).select("document") if args.format == "json" else E.likelihood_text(scored).select("text")).first()
    print(row[0] if row else "no files")
    return 0


def _env(spark: SparkSession, args: argparse.Namespace) -> int:
    from .operators import artifacts as Z
    from .operators import wire as W
    from .sources.files import read_environment

    found = W.derive_environment(W.normalize_environment(read_environment(spark, args.path)))
    row = W.environment_errors(found).first().asDict(recursive=True)
    errors = row.pop("errors")
    for error in errors:
        print(error, file=sys.stderr)
    if args.out and not errors:
        Z.write_json(args.out, {k: v for k, v in row.items() if v is not None})
    print(json.dumps({k: v for k, v in row.items() if v is not None}, indent=2))
    return 1 if errors else 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("epochlens").getOrCreate()
    return {"scan": _scan, "repos": _repos, "report": _report, "render": _render, "detect": _detect, "env": _env}[args.command](spark, args)


if __name__ == "__main__":
    raise SystemExit(main())

"""Runs over many repositories: what is planned, what each one's outcome was, the sums over all, and where results lie."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .repositories import matches_terms, repo_identity, repo_key

# How an error of a stage is named.
ERROR_CODES = (("requested ref not found", "REF_NOT_FOUND"), ("clone", "CLONE_FAILED"), ("fetch", "FETCH_FAILED"), ("checkout", "CHECKOUT_FAILED"), ("invalid config_override", "INVALID_CONFIG_OVERRIDE"))


def plan(repos: DataFrame, terms: list[str] | None = None, limit: int | None = None, ref: str | None = None) -> DataFrame:
    """Enabled repositories (source_line, repo_url, ref, name) that match any term, the first ``limit`` of the list where asked for, with key and identity."""
    wanted = F.col("ref") if ref is None else F.lit(ref)
    rows = repos.filter("enabled").filter(matches_terms(terms or [], "repo_url", "name"))
    rows = rows if limit is None else rows.orderBy("source_line").limit(limit)
    who = repo_identity(F.col("repo_url"))
    bad = (who["host"] == "") | (who["owner"] == "") | (who["repo"] == "")
    return rows.withColumn("identity", F.when(~bad, who)).withColumn("repo_key", F.when(bad, F.concat(F.lit("line_"), F.col("source_line").cast("string"))).otherwise(repo_key(F.col("repo_url"), wanted)))


def pick_ref(repos: DataFrame, refs: DataFrame) -> DataFrame:
    """The ref of each repository among those that it has (repo_key, ref, sha): the one asked for, also at the origin; without a wish the origin's head, main, master.

    ``refs`` names the head as HEAD. Adds resolved_ref and resolved_sha, null where there is none.
    """
    plain = F.regexp_replace("r_ref", "^origin/", "")
    named = refs.select("repo_key", F.col("ref").alias("r_ref"), "sha").withColumn("plain", plain)
    joined = repos.select("repo_key", F.col("ref").alias("asked")).join(named, "repo_key")
    rank = F.when(F.col("asked").isNotNull(), F.when(F.col("r_ref") == F.col("asked"), 0).when(F.col("plain") == F.col("asked"), 1)).otherwise(F.when(F.col("plain") == "HEAD", 0).when(F.col("plain") == "main", 1).when(F.col("plain") == "master", 2))
    best = joined.withColumn("rank", rank).filter("rank is not null").groupBy("repo_key").agg(F.min_by(F.struct(F.col("plain").alias("resolved_ref"), F.col("sha").alias("resolved_sha")), F.struct("rank", "r_ref")).alias("b"))
    return repos.join(best, "repo_key", "left").select(*repos.columns, "b.resolved_ref", "b.resolved_sha")


def error_code(message: Column, stage: Column) -> Column:
    """The code of a failure by what it says, else by its stage."""
    low = F.lower(message)
    out = F.when(stage == "config_detect", "CONFIG_DETECT_FAILED").when(stage == "scan_overrides", "INVALID_SCAN_OVERRIDE")
    for words, code in ERROR_CODES:
        out = out.when(F.contains(low, F.lit(words)), code)
    return out.otherwise("SCAN_FAILED")


def findings_summary(findings: DataFrame, by: str = "repo_key") -> DataFrame:
    """Findings of each repository by class."""
    v = F.lower(F.trim("y2038_issue"))
    return findings.groupBy(by).agg(F.count(F.lit(1)).alias("total_findings"), *[F.count_if(v == x).alias(f"{x}_findings") for x in ("yes", "no", "abstain")])


def scan_metrics(meta: Column) -> Column:
    """Metrics of a result's meta as a struct; missing ones are 0 and means have one digit."""
    n = lambda k: F.coalesce(F.get_json_object(meta, f"$.metrics.{k}").try_cast("long"), F.lit(0)).alias(k)
    mean = lambda k: F.round(F.coalesce(F.get_json_object(meta, f"$.metrics.{k}").try_cast("double"), F.lit(0.0)), 1).alias(k)
    return F.struct(*map(n, ("total_files", "total_lines", "total_chars", "total_words", "max_line_length", "max_file_length")), *map(mean, ("avg_line_length", "avg_file_length")))


def stage_counts(stats: Column) -> Column:
    """Counters of a stage document as a struct; what it does not hold has its default."""
    get = lambda path, default: F.coalesce(F.get_json_object(stats, f"$.{path}").try_cast("long"), F.lit(default).cast("long"))
    return F.struct(
        get("prescan.time_t_aliases", 0).alias("time_t_aliases"), get("ir.candidates", 0).alias("candidates"), get("ir.after_structural_filter", None).alias("after_structural_filter"), get("io_boundary.candidates", None).alias("io_candidates"),
        *[get(f"llm.{k}", 0).alias(k) for k in ("total_tokens", "prompt_tokens", "completion_tokens", "requests")],
    )


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Sums over repositories (status, config_source, metrics, stages): by status and source, by status, and overall."""
    m, s = "metrics.", "stages."
    return outcomes.rollup("status", "config_source").agg(
        F.count(F.lit(1)).alias("repos"), F.sum(m + "total_files").alias("total_files"), F.sum(m + "total_lines").alias("total_lines"), F.max(m + "max_line_length").alias("max_line_length"), F.sum(s + "candidates").alias("candidates"),
        F.sum(s + "io_candidates").alias("io_candidates"), F.sum(s + "total_tokens").alias("total_tokens"), F.grouping_id().alias("level"),
    )


def repo_line(findings: DataFrame, asked: bool) -> DataFrame:
    """One line of text about each repository's findings (``findings_summary``)."""
    n = lambda c: F.col(c).cast("string")
    silent = F.when(F.col("total_findings") == 0, "No Y2038 candidate findings detected").otherwise(F.concat(n("yes_findings"), F.lit(" confirmed Y2038 issues; "), n("abstain_findings"), F.lit(" finding records without model classification because LLM analysis was disabled")))
    asked_text = F.concat(F.lit("final classifications: "), n("yes_findings"), F.lit(" yes, "), n("no_findings"), F.lit(" no, "), n("abstain_findings"), F.lit(" abstain; retained finding records: "), n("total_findings"))
    return findings.select("repo_key", F.concat(F.col("repo_key"), F.lit(": "), asked_text if asked else silent).alias("line"))


def skip_reason(repos: DataFrame, statuses: DataFrame) -> DataFrame:
    """Why a repository has nothing to render, from what the run kept of it (repo_key, status, error_code)."""
    s = statuses.select("repo_key", F.col("status").alias("__s"), F.col("error_code").alias("__e"))
    failed = F.col("__s").isin("timeout", "failed")
    text = F.when(failed, F.concat(F.lit("scan "), "__s", F.lit(" ("), F.coalesce("__e", F.lit("unknown")), F.lit("); no findings to render"))).otherwise("missing findings.json")
    return repos.join(s, "repo_key", "left").select(*repos.columns, text.alias("reason"))


# ---- places of results on the driver's side


def repo_folders(run: str) -> list[str]:
    """The repositories of a run, in order."""
    folder = Path(run) / "repos"
    return sorted(str(p) for p in folder.iterdir() if p.is_dir()) if folder.is_dir() else []


def findings_file(folder: str) -> str:
    """Where a repository's result lies, now or formerly; where it should lie if there is none."""
    now, once = Path(folder) / "findings.json", Path(folder) / "scan" / "findings.json"
    return str(once if once.is_file() and not now.is_file() else now)


def render_mode(path: str) -> tuple[str, str]:
    """Whether a path is one result or a run, and where its result lies."""
    here = Path(path)
    if here.is_file():
        return "single", path
    if not here.is_dir():
        raise ValueError(f"path not found: {path}")
    if (here / "repos").is_dir():
        return "batch", path
    for name in ("scan/findings.json", "findings/findings.json", "findings.json"):
        if (here / name).is_file():
            return "single", str(here / name)
    raise ValueError(f"neither a result nor a run: {path}")


def newest(folder: str, run: str) -> bool:
    """Let ``latest`` in a folder name a run; false where that cannot be done, which stops nothing."""
    link = Path(folder) / "latest"
    try:
        link.parent.mkdir(parents=True, exist_ok=True)
        if link.is_symlink() or link.exists():
            link.unlink()
        link.symlink_to(run, target_is_directory=True)
    except OSError:
        return False
    return True


def discard_staged(folder: str) -> int:
    """Delete what failed writes left in a folder; returns how many files."""
    left = [p for p in Path(folder).glob(".*") if p.is_file() and re.search(r"\.[0-9a-f]{32}$", p.name)]
    for p in left:
        p.unlink()
    return len(left)


#: Seconds in which work that is over its deadline is cancelled again and again.
GRACE = 10


def with_deadline(spark: SparkSession, work: Callable[[], object], seconds: float, name: str = "scan") -> tuple[str, object]:
    """Run Spark work under a deadline: its jobs carry a tag and are cancelled when time is over. ('ok', result), ('timeout', None) or ('failed', error)."""
    tag, out = f"{name}-{time.time_ns()}", {}

    def run() -> None:
        spark.addTag(tag)
        try:
            out["value"] = work()
        except Exception as error:  # told to the caller
            out["error"] = error
        finally:
            spark.removeTag(tag)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        # Jobs that the work starts after the first cancellation are cancelled as well.
        for _ in range(GRACE):
            spark.interruptTag(tag)
            thread.join(1)
            if not thread.is_alive():
                break
        return "timeout", None
    return ("failed", out["error"]) if "error" in out else ("ok", out.get("value"))


def run_apart(spark: SparkSession, work: dict[str, Callable[[Callable[[], bool]], object]], seconds: float, at_once: int = 4, attempts: int = 2) -> DataFrame:
    """Run each repository's work under a deadline of its own; one that is slow or fails stops no other.

    The work is given a function that tells whether its time is over, to be asked before it publishes anything. What fails is tried again, what
    is over its time is not. repo_key, status (ok, timeout, failed), attempts, seconds, error; a row for each repository.
    """

    def one(key: str) -> tuple[str, str, int, float, str | None]:
        began, state, value, tries = time.time(), "failed", None, 0
        while state == "failed" and tries < attempts:
            tries, over = tries + 1, threading.Event()
            state, value = with_deadline(spark, lambda: work[key](over.is_set), seconds, "repo")  # noqa: B023
            over.set()
        return key, state, tries, round(time.time() - began, 3), f"{type(value).__name__}: {value}"[:500] if state == "failed" else None

    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(one, work))
    return spark.createDataFrame(found, "repo_key string, status string, attempts int, seconds double, error string")

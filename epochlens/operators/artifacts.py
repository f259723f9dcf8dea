"""Kept results: a cache with expiry, an index of the newest runs, merged catalogs, digests and usage of model batches."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_utf8


def cache_read(cache: DataFrame, keys: DataFrame, now: Column, days: int) -> DataFrame:
    """The newest unexpired row of each key asked for."""
    fresh = cache.filter(F.col("ts") > now - F.expr(f"interval {days} day")).join(keys, "key", "left_semi")
    return fresh.groupBy("key").agg(F.max_by("value", "ts").alias("value"))


def cache_sweep(cache: DataFrame, now: Column, days: int) -> DataFrame:
    return cache.filter(F.col("ts") > now - F.expr(f"interval {days} day"))


def newest_runs(index: DataFrame, run: DataFrame, keep: int = 50) -> DataFrame:
    """The index with a new run, the newest ``keep`` only; the bound is the feature."""
    return index.unionByName(run).orderBy(F.desc("ts"), "run_id").limit(keep)


def merge_catalog(catalog: DataFrame, discovered: DataFrame) -> DataFrame:
    """The catalog with discovered rules; one whose symbol is in the catalog only matches where the symbol is no call."""
    known = catalog.select("symbol").distinct().withColumn("known", F.lit(True))
    added = discovered.join(known, "symbol", "left").withColumn("type_use_only", F.coalesce("type_use_only", F.lit(False)) | F.coalesce("known", F.lit(False))).drop("known")
    return catalog.unionByName(added, allowMissingColumns=True)


def batch_digest(outputs: DataFrame) -> DataFrame:
    """Per batch: rows, verdicts, bytes and digest of its outputs in order; texts are not kept."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "body")))
    return outputs.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "yes").alias("n_yes"), F.sum(F.octet_length("body")).alias("bytes"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["body"]), "\n"), 256).alias("sha256"))


def usage(calls: DataFrame) -> DataFrame:
    """Tokens by stage and in total; counts that are no non-negative numbers are 0."""
    n = lambda c: F.coalesce(F.greatest(F.col(c).try_cast("long"), F.lit(0)), F.lit(0))
    return calls.rollup("stage").agg(F.sum(n("prompt_tokens")).alias("prompt_tokens"), F.sum(n("completion_tokens")).alias("completion_tokens"), F.sum(n("prompt_tokens") + n("completion_tokens")).alias("total_tokens"))


def cache_write(cache: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The cache with new results (key, value), stamped; of a key the new row counts."""
    fresh = results.select("key", "value", now.alias("ts"))
    return cache.select("key", "value", "ts").join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def typedef_rows(definitions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each alias of the time type at each place that defines it: alias, resolves_to, depth, defined_in, line."""
    place = F.explode("definitions").alias("d")
    rows = definitions.join(aliases, ["tu", "alias"]).groupBy("alias", "definitions").agg(F.min("hop").alias("depth")).select("alias", "depth", place)
    pattern = r"^([^:]*):(\d+):"
    found = rows.select("alias", F.lit("time_t").alias("resolves_to"), "depth", F.regexp_extract("d", pattern, 1).alias("defined_in"), F.regexp_extract("d", pattern, 2).try_cast("int").alias("line"))
    return found.groupBy("alias", "resolves_to", "defined_in", "line").agg(F.min("depth").alias("depth"))


def macro_rows(defines: DataFrame) -> DataFrame:
    """Macros of time where they are defined: macro, value, defined_in, line."""
    return defines.select("macro", "value", F.col("path").alias("defined_in"), "line")


def candidate_log(candidates: DataFrame) -> DataFrame:
    """Candidates as they are logged before any filter."""
    zero = F.lit(0)
    return candidates.select(F.col("candidate_id").alias("id"), F.col("path").alias("file"), "line", F.coalesce("col_start", zero).alias("col_start"), F.coalesce("col_end", zero).alias("col_end"), "symbol", F.col("risk").alias("rule"), F.col("snippet").alias("one_line_snippet"))


def discovery_report(definitions: DataFrame, macros: int = 0) -> DataFrame:
    """One JSON row per file with its aliases and definitions; the first row counts them all."""
    per_file = definitions.groupBy(F.col("tu").alias("file")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", "definitions")))).alias("aliases"))
    return per_file.select("file", F.size("aliases").alias("n_aliases"), F.lit(macros).alias("n_macros"), F.to_json("aliases").alias("aliases"))


def discovered_rules(rules: DataFrame) -> DataFrame:
    """The rules that a scan added to its catalog."""
    return rules.filter(F.coalesce("discovered", F.lit(False)))


def support_flags(rows: DataFrame, key: str = "symbol", flags: str = "os_support") -> DataFrame:
    """Of several maps of flags the one in which a flag holds where it does in any: ``key`` and ``flags``."""
    pairs = rows.select(key, F.explode(flags).alias("k", "v")).groupBy(key, "k").agg(F.bool_or(F.coalesce("v", F.lit(False))).alias("v"))
    return pairs.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(flags))


def consolidated_rules(rules: DataFrame) -> DataFrame:
    """One rule a symbol (pos, symbol, risk, description, os_support): at its first place, with the highest risk, the first description that says something, and all support."""
    c, rank = F.col, F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).when(F.col("risk") == "low", 0).otherwise(-1)
    said = F.nullif(F.trim("description"), F.lit(""))
    first = rules.groupBy("symbol").agg(F.min("pos").alias("pos"), F.max_by("risk", rank).alias("risk"), F.min_by(said, F.when(said.isNotNull(), c("pos"))).alias("description"), F.count(F.lit(1)).alias("n_rows"))
    return first.join(support_flags(rules), "symbol", "left")


def batch_manifest(functions: DataFrame, pass_name: str) -> DataFrame:
    """What is always kept of a batch: which functions it had and how large they were, without their text."""
    item = F.struct("function_id", F.size("candidate_lines").alias("candidate_lines"), F.length("body").alias("chars"))
    return functions.groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("functions"), F.count(F.lit(1)).alias("n")).withColumn("batch_id", F.concat(F.lit(f"{pass_name}_batch_"), F.lpad(F.col("batch").cast("string"), 4, "0")))


def batch_stats(functions: DataFrame) -> DataFrame:
    """Candidate lines of a batch: all, most of one function, and functions without any."""
    n = F.size("candidate_lines")
    return functions.groupBy("batch").agg(F.sum(n).alias("lines"), F.max(n).alias("most"), F.count_if(n == 0).alias("without"))


def private(rows: DataFrame, columns: tuple[str, ...], allowed: bool) -> DataFrame:
    """Rows without the columns that may hold source text, unless that is allowed."""
    return rows if allowed else rows.drop(*columns)


def batch_outputs(responses: DataFrame, raw: bool = False, most: int = 65_536) -> DataFrame:
    """Per batch of responses (batch, pos, function_id, status, summary, confidence, issues, body): counts by status and verdict, bytes, digest, items; and, where asked
    for, the responses themselves up to ``most`` bytes."""
    item = F.struct("pos", "function_id", "status", F.coalesce("summary", F.lit("unknown")).alias("summary"), "confidence", F.coalesce(F.size("issues"), F.lit(0)).alias("issue_count"))
    counted = lambda c: responses.groupBy("batch", F.coalesce(c, F.lit("unknown")).alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("batch").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(f"{c}_counts"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n")
    whole = responses.groupBy("batch").agg(F.count(F.lit(1)).alias("response_item_count"), ordered.alias("whole"), F.array_sort(F.collect_list(item)).alias("items"))
    out = whole.join(counted("status"), "batch").join(counted("summary"), "batch")
    kept = [truncate_utf8(F.col("whole"), most).alias("response"), (F.octet_length("whole") > most).alias("response_truncated")] if raw else []
    return out.select("batch", "response_item_count", F.octet_length("whole").alias("response_bytes"), F.sha2("whole", 256).alias("response_sha256"), "status_counts", "summary_counts", "items", F.lit(raw).alias("raw_model_output_persisted"), *kept)


def model_log(items: DataFrame, scan_id: str, model: str) -> DataFrame:
    """Inputs or outputs of model batches (pass, batch, and what is told of them) as they are logged, by pass and batch."""
    batch = F.col("batch").cast("string")
    told = [c for c in items.columns if c not in ("pass", "batch")]
    return items.select(F.lit(scan_id).alias("scan_id"), F.when(F.length(batch) < 4, F.lpad(batch, 4, "0")).otherwise(batch).alias("batch"), "pass", F.lit(model).alias("model"), *told, F.current_timestamp().alias("timestamp"))


def id_mappings(rows: DataFrame, pass_from: str, pass_to: str) -> DataFrame:
    """Ids of one pass and what they are called in another (id_from, id_to), as they are logged. Nulls and repeats go; an id with two names is an error."""
    pairs = rows.filter("id_from IS NOT NULL AND id_to IS NOT NULL").groupBy("id_from").agg(F.min("id_to").alias("id_to"), F.max("id_to").alias("last"))
    fail = F.raise_error(F.concat(F.lit("an id is mapped to two others: "), "id_from")).cast("string")
    return pairs.select(F.lit(pass_from).alias("pass_from"), F.lit(pass_to).alias("pass_to"), "id_from", F.when(F.col("id_to") == F.col("last"), F.col("id_to")).otherwise(fail).alias("id_to"))


def append_json(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append rows as JSON lines, in folders by columns where asked for."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).json(path)


def stage_stats(counts: dict[str, int | None], usage_rows: DataFrame | None = None) -> dict:
    """Counters of a scan by stage; what was not measured stays None, which is not 0."""
    by_pass, total = {}, {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0}
    # One row per stage and one for all.
    for r in [] if usage_rows is None else usage_rows.collect():
        row = {k: r[k] or 0 for k in total}
        if r["stage"] is None:
            total = row
        else:
            by_pass[r["stage"].upper()] = row
    return {
        "files": {k: counts.get(k) for k in ("max_file_size", "files_skipped_too_large", "files_skipped_external")}, "prescan": {"time_t_aliases": counts.get("aliases") or 0},
        "ir": {"candidates": counts.get("candidates") or 0, "after_structural_filter": counts.get("after_structural_filter")}, "io_boundary": {"candidates": counts.get("io_candidates")}, "llm": total | {"by_pass": by_pass},
    }


class Timers:
    """Milliseconds by stage; the total is taken once."""

    def __init__(self, clock: Callable[[], float] = time.time) -> None:
        self.clock, self.begun, self.spent = clock, clock(), {}
        self.open: dict[str, float] = {}

    def start(self, stage: str) -> None:
        self.open[stage] = self.clock()

    def end(self, stage: str) -> None:
        if stage in self.open:
            self.spent[stage] = int((self.clock() - self.open[stage]) * 1000)

    def total(self) -> int:
        return self.spent.setdefault("total", int((self.clock() - self.begun) * 1000))


def new_run_id(now: datetime | None = None) -> str:
    """The second in UTC and six random hexadecimal digits."""
    return f"{(now or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%SZ')}-{uuid.uuid4().hex[:6]}"


def session_metadata(scan_id: str, config: dict, metrics: dict, versions: dict, timers: Timers) -> dict:
    """What is kept of a run beside its tables."""
    return {"scan_id": scan_id, "config": config, "metrics": metrics, "versions": versions, "timing_ms": dict(timers.spent) | {"total": timers.total()}}


def summary_text(scan_id: str, root: str, metrics: dict, counts: dict, timers: Timers) -> str:
    """A run in a few lines."""
    lines = [f"Scan ID: {scan_id}", f"Root: {root}", "", *(f"- {k}: {v}" for k, v in {**metrics, **counts}.items()), "", *(f"- {k} ms: {v}" for k, v in timers.spent.items()), f"- total ms: {timers.total()}"]
    return "\n".join(lines) + "\n"


def write_json(path: str, value: dict) -> None:
    """Write a small JSON file of the driver; its folders are made, and a file appears whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        staged.write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")
        staged.replace(target)
    finally:
        staged.unlink(missing_ok=True)


def read_json(path: str) -> dict:
    """Read a JSON object; what is missing or no object is an error that says so."""
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise ValueError(f"no such file: {path}") from None
    except ValueError:
        raise ValueError(f"not JSON: {path}") from None
    if not isinstance(value, dict):
        raise ValueError(f"not a JSON object: {path}")
    return value

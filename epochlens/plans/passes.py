"""Functions judged by a model in passes, each of which takes only what the one before left open.

The first pass sees every function, in batches of one file; the next sees those that were answered with an abstention, with the context that the answer asked for; the last those that still
abstain, with the beginning of their file. What could not be used at all is an error and goes no further. The row of the latest pass counts.

Answers go to a table, a wave of batches at a time, under the digest of their prompt. A run that stops and is started again reads it and asks only what has no answer yet: prompts depend
on the functions and earlier answers alone, so they come out the same. Failed requests are no answers, so another run asks them again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_fence
from ..operators import artifacts as Z
from ..operators import assessments as A
from ..operators import candidates as C
from ..operators import cparse as P
from ..operators import models as O
from ..operators import wire as W
from ..session import ensure_checkpoints, scratch_folder

ANSWERS = "key string, pass string, batch string, n_functions int, prompt_bytes long, text string, error string, prompt_tokens long, completion_tokens long"


@dataclass(frozen=True)
class Step:
    """A pass: its rules, what it is called in prompts and logs, and the field of the context that it adds."""

    name: str
    rules: str
    task: str
    context: str | None = None


STEPS = (Step("2a", O.FUNCTION_RULES, "functions"), Step("2b", O.CONTEXT_RULES, "functions with context", "context_additions"), Step("9", O.FILE_RULES, "functions with file context", "file_context"))


@dataclass(frozen=True)
class Asking:
    """How a model is asked. ``folder`` keeps the answers; ``wave`` batches are asked and kept at a time, so that is what a failure can lose.

    With ``logs``, what is asked and answered is logged as JSON lines below that folder, by pass, under ``scan_id`` and ``model``: one line for each function of a request before it is
    asked, and one for each request after it.
    """

    ask: Callable[[O.Prompt], dict]
    folder: str
    size: int = 15
    wave: int = 4096
    tries: int = 3
    wait: float = 2.0
    most_failures: int | None = None
    environment: str = "{}"
    migration: str | None = None
    steps: tuple[Step, ...] = field(default=STEPS)
    logs: str | None = None
    scan_id: str = ""
    model: str = ""


def kept_answers(spark, folder: str) -> DataFrame:
    """All answers and failures that were kept."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(ANSWERS).parquet(folder) if there else spark.createDataFrame([], ANSWERS)


def step_prompts(units: DataFrame, step: Step, asking: Asking, detect_y2106: bool = False) -> DataFrame:
    """Prompts of a pass over units (function_id, path, name, start_line, end_line, body, candidate_lines and the step's context): key, batch, n_functions, function_ids, system, user."""
    numbered = C.batches(units, asking.size).withColumn("batch", F.concat_ws("#", "path", F.col("batch").cast("string")))
    sizes = numbered.groupBy("batch").agg(F.count(F.lit(1)).cast("int").alias("n_functions"), F.array_sort(F.collect_list("function_id")).alias("function_ids"))
    made = O.prompts(O.function_facts(numbered, step.context), step.rules, step.task, asking.environment, asking.migration, detect_y2106)
    key = F.sha2(F.concat_ws("\n", F.lit(step.name), "system", "user"), 256)
    return made.join(sizes, "batch").select(key.alias("key"), "batch", "n_functions", "function_ids", "system", "user")


#: Files of a wave, at most; so many tasks read it.
FILES = 16


def deal_waves(todo: DataFrame, waves: int, path: str) -> None:
    """Write the prompts wave by wave, so that a wave reads its own alone: else every wave would read all of them."""
    key = F.xxhash64("key")
    dealt = todo.withColumn("prompt_bytes", (F.octet_length("system") + F.octet_length("user")).cast("long")).withColumn("wave", F.pmod(key, F.lit(waves)))
    dealt.repartition("wave", F.pmod(F.shiftright(key, 32), F.lit(FILES))).write.partitionBy("wave").option("compression", "zstd").parquet(path)


def read_wave(spark: SparkSession, path: str, wave: int, schema) -> DataFrame:
    """The prompts of a wave, with their bytes; none where nothing was dealt to it."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", prompt_bytes long"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/wave={wave}")
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(columns).parquet(f"{path}/wave={wave}") if there else spark.createDataFrame([], columns)


def ask_open(prompts: DataFrame, step: Step, asking: Asking) -> DataFrame:
    """Ask the prompts that have no answer yet, wave by wave, and keep what comes; returns the best row kept of each prompt."""
    spark = prompts.sparkSession
    answered = kept_answers(spark, asking.folder).filter("error is null").select("key").distinct()
    todo = prompts.join(answered, "key", "left_anti")
    waves, dealt = -(-todo.count() // asking.wave), scratch_folder(spark, "waves")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dealt)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(target)  # what a run that fails leaves
    if waves:
        deal_waves(todo, waves, dealt)
    for w in range(waves):
        mine = read_wave(spark, dealt, w, prompts.schema)
        if asking.logs is not None:
            _log(mine.select("batch", F.sha2("system", 256).alias("preamble_hash"), F.explode("function_ids").alias("item")), step, asking, "input")
        # The digest travels as the name of the batch, so answers need no other join.
        got = O.ask_all(mine.select(F.col("key").alias("batch"), "system", "user"), asking.ask, asking.tries, asking.wait, asking.most_failures)
        named = got.withColumnRenamed("batch", "key").join(mine.select("key", "batch", "n_functions", "prompt_bytes"), "key")
        named.select("key", F.lit(step.name).alias("pass"), "batch", "n_functions", "prompt_bytes", "text", "error", "prompt_tokens", "completion_tokens").write.mode("append").parquet(asking.folder)
        if asking.logs is not None:
            # What was kept is told, so nothing is asked for the log.
            kept = kept_answers(spark, asking.folder).join(mine.select("key"), "key", "left_semi")
            _log(kept.select("batch", "key", "n_functions", F.col("prompt_tokens").alias("request_tokens"), F.col("completion_tokens").alias("response_tokens"), "error", F.col("text").alias("response")), step, asking, "output")
    store.delete(target, True)
    rows = kept_answers(spark, asking.folder).join(prompts.select("key"), "key", "left_semi")
    best = rows.groupBy("key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "key"]), F.struct(F.col("error").isNotNull(), F.coalesce("text", F.lit("")))).alias("r"))
    return best.select("key", "r.*")


def _log(rows: DataFrame, step: Step, asking: Asking, name: str) -> None:
    Z.append_json(Z.model_log(rows.withColumn("pass", F.lit(step.name)), asking.scan_id, asking.model), f"{asking.logs.rstrip('/')}/{name}", ["pass"])


def judged(units: DataFrame, answers: DataFrame, detect_y2106: bool = False) -> DataFrame:
    """One analysis for each unit from the answers of a pass; ``y2106`` is null unless asked for."""
    items = W.judge_items(W.parse_items(answers.filter("text is not null").select("key", strip_fence(F.col("text")).alias("body"))), detect_y2106).checkpoint()
    rows = A.align_items(units, items)
    if not detect_y2106:
        return rows.withColumn("y2106", F.lit(None).cast("string"))
    second = items.filter("problem is null").groupBy("function_id").agg(F.first("y2106_summary").alias("y2106"))
    return rows.join(second, "function_id", "left").withColumn("y2106", F.when(F.col("status") == "completed", F.col("y2106")))


def _needs() -> Column:
    """What an answer asks for; everything where it names nothing."""
    return F.when(F.size("needs") > 0, F.col("needs")).otherwise(F.array(*map(F.lit, P.NEEDS)))


def with_context(units: DataFrame, open_rows: DataFrame, step: Step, files: DataFrame) -> DataFrame:
    """The units that are still open with what the pass adds."""
    left = units.join(open_rows.select("function_id", _needs().alias("needs")), "function_id")
    if step.context is None:
        return left.drop("needs")
    items = P.context_items(files.join(left.select("path").distinct(), "path", "left_semi"))
    if step.context == "context_additions":
        lists = F.map_from_arrays(F.array(*map(F.lit, P.NEEDS)), F.array(*P.NEEDS))
        return left.join(items, "path", "left").withColumn(step.context, F.map_filter(lists, lambda k, _: F.array_contains("needs", k))).drop("needs", *P.NEEDS)
    lead = P.leading_context(files.join(left.select("path").distinct(), "path", "left_semi"), items).select("path", F.struct("leading_lines", "typedefs", "structs", "macros").alias(step.context))
    return left.drop("needs").join(lead, "path", "left")


def run_passes(units: DataFrame, files: DataFrame, asking: Asking, detect_y2106: bool = False) -> DataFrame:
    """Analyses of all units: function_id, pass, status, issue_type, summary, confidence, issues, needs_more_context, needs, y2106."""
    ensure_checkpoints(units.sparkSession)
    found: DataFrame | None = None
    for step in asking.steps:
        # Only completed abstentions are open; in the first pass everything is.
        todo = units if found is None else with_context(units, A.escalated(found.withColumn("verdict", F.col("summary"))), step, files)
        todo = todo.checkpoint()
        if found is not None and todo.isEmpty():
            break
        asked = step_prompts(todo, step, asking, detect_y2106).checkpoint()
        rows = judged(todo, ask_open(asked, step, asking), detect_y2106).withColumn("pass", F.lit(step.name)).checkpoint()
        found = (rows if found is None else A.replace_rows(found, rows.select(*found.columns))).checkpoint()
    return found


def as_answers(analyses: DataFrame) -> DataFrame:
    """Analyses in the form of ``assessments.align``: function_id, status, verdict, confidence, reason, y2106."""
    kinds = {v: k for k, v in A.STATUS_ISSUES.items()}
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("issue_type")), F.col("status"))
    done = F.col("issue_type").isNull()
    told = F.coalesce(F.get("issues", F.lit(0))["description"], F.concat(F.lit("Function analysis: "), "summary"))
    return analyses.select("function_id", status.alias("status"), F.when(done, F.col("summary")).alias("verdict"), F.when(done, F.col("confidence")).alias("confidence"), F.when(done, told).alias("reason"), "y2106")


def pass_usage(spark, folder: str) -> DataFrame:
    """Requests, failures, bytes and tokens of each pass."""
    return kept_answers(spark, folder).groupBy("pass").agg(
        F.count(F.lit(1)).alias("requests"), F.count("error").alias("failures"), F.sum("n_functions").alias("functions"), F.sum("prompt_bytes").alias("prompt_bytes"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )

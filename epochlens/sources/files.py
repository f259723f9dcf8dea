"""Sources besides tables: trees of files, rule catalogs, repository lists, result documents."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, carries_credentials
from .trees import list_folders, number_ranges, read_ranges

# Extensions, and the globs left out, where none are given.
EXTENSIONS = (".c", ".h", ".cc", ".cpp", ".cxx", ".hh", ".hpp", ".hxx")
EXCLUDES = ("**/tests/**",)
RULE_SCHEMA = (
    "symbol string, name string, risk string, category string, description string, needs_paren boolean, rule_id string, "
    "discovered boolean, discovery_type string, definitions array<string>, scope_files array<string>, type_use_only boolean, subchecks array<string>"
)
REPO_SCHEMA = "repo_url string, ref string, name string, enabled boolean, scan_overrides map<string,string>, _bad string"
FINDING = (
    "struct<finding_id:string,file:string,function_id:string,y2038_issue:string,y2106_issue:string,confidence:double,rule_id:string,rule:string,check_id:string,issue_type:string,severity:string,symbol:string,reason:string,summary:string,"
    "source_snippet:string,lines:array<int>,region:struct<start_line:int,end_line:int>,issues:array<struct<type:string,line:int,description:string>>,migration_risk_type:string>"
)
RESULT_SCHEMA = (
    "schema_version string, meta string, "
    "candidates array<struct<candidate_id:string,file:string,line:int,symbol:string,risk:string,one_line_snippet:string,description:string,discovery_method:string,rule_id:string,function_id:string,analysis_coverage:string>>, "
    f"assessments array<struct<assessment_id:string,function_id:string,execution_status:string,verdict:string,confidence:double,reason:string,candidate_ids:array<string>>>, findings array<{FINDING}>"
)


def glob_regex(pattern: str) -> str:
    """A glob over relative paths; ``**`` crosses folders, a leading slash means the root."""
    out, i, p = "", 0, pattern.lstrip("/")
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return f"^{out}$"


def include_patterns(extensions: tuple[str, ...] = EXTENSIONS, folders: tuple[str, ...] = ()) -> list[str]:
    return [f"{f}/**/*{e}" for f in folders for e in extensions] or [f"**/*{e}" for e in extensions]


def validate_size_limit(limit) -> int | None:
    """Null is no limit; everything but a positive whole number is an error."""
    if limit is None:
        return None
    if isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0:
        raise ValueError("the size limit must be a positive integer")
    return limit


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below a root, without their content: path (below the root), uri, length, and for links of a local tree where they lead.

    A local or mounted tree is walked by tasks, so that links can be followed; any other store is listed by Spark, and has no links.
    canonical is the place below the root that a name leads to, null where it leads out of the root.
    """
    base = root.rstrip("/")
    if base.startswith("/") or base.startswith("file:"):
        return list_folders(spark, urlsplit(base).path if base.startswith("file:") else base)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(F.col("path").alias("uri"), "length")
    prefix = base.split("://", 1)[-1] + "/"
    below = F.substring("uri", F.instr("uri", prefix) + F.lit(len(prefix)), F.lit(1 << 20))
    return files.select(below.alias("path"), "uri", "length", below.alias("canonical"))


def select_files(listed: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int | None = None, extensions: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a listing the files to scan, those left out for their size, and the names of links that lead out of the root.

    Names that lead to one file count once; a file is left out where any of its names is excluded. Null lengths are kept.
    """
    limit = validate_size_limit(max_bytes)
    wanted = F.regexp_like("path", F.lit("|".join(map(glob_regex, include or include_patterns()))))
    if extensions is not None:
        wanted &= F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*extensions)
    globs = EXCLUDES if exclude is None else exclude
    unwanted = F.regexp_like("path", F.lit("|".join(map(glob_regex, globs)))) if globs else F.lit(False)
    inside = listed.filter("canonical is not null")
    excluded = inside.filter(unwanted).select("canonical").distinct()
    # A canonical name may match a pattern of its own.
    gone = F.regexp_like("canonical", F.lit("|".join(map(glob_regex, globs)))) if globs else F.lit(False)
    kept = inside.filter(wanted & ~gone).join(excluded, "canonical", "left_anti").groupBy(F.col("canonical").alias("path")).agg(F.min("uri").alias("uri"), F.min("length").alias("length"))
    fits = F.lit(True) if limit is None else F.coalesce(F.col("length") <= limit, F.lit(True))
    outside = listed.filter(F.col("canonical").isNull() & wanted).select("path").distinct()
    return kept.filter(fits), kept.filter(~fits).select("path", F.col("length").alias("size_bytes")), outside


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Content of selected files (path, uri), read by the tasks; bytes that are no UTF-8 are dropped. path, length, content."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.string())])

    def run(batches):
        for batch in batches:
            for path, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = pafs.FileSystem.from_uri(uri)
                with store.open_input_stream(name) as stream:
                    data = stream.read()
                yield pa.record_batch([[path], [len(data)], [data.decode("utf-8", "ignore")]], schema=schema)

    return files.select("path", "uri").repartition("path").mapInArrow(run, "path string, length long, content string")


def scan_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files of a tree (path, length, content) and those left out for their size (path, size_bytes). Names are listed first; only chosen files are read."""
    kept, large, _ = select_files(list_tree(spark, root), include, exclude, max_bytes)
    return read_files(spark, kept), large


def scan_tree_lines(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines of the files of a tree (path, line, text), read by byte ranges, and the files left out for their size."""
    kept, large, _ = select_files(list_tree(spark, root), include, exclude, max_bytes)
    return number_ranges(read_ranges(kept)), large


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A catalog, as an array or as an object with ``rules``; keys in any case, symbols fall back to names and risks to high. Other documents are an error."""
    text = spark.read.text(path, wholetext=True)
    rows = "array<map<string,string>>"
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", rows)).otherwise(F.from_json(F.get_json_object("value", "$.rules"), rows))
    fail = F.raise_error(F.lit("a catalog is an array of rules or an object with rules"))
    whole = text.select(F.explode(F.coalesce(listed, F.when(F.lit(True), fail).cast(rows))).alias("r")).select(F.transform_keys("r", lambda k, _: F.lower(k)).alias("r"))
    value = lambda n: F.element_at("r", F.lit(n))
    kinds = dict(x.split(" ", 1) for x in RULE_SCHEMA.split(", "))
    return normalize_rules(whole.select(*[(F.from_json(value(n), t) if t.startswith("array") else value(n).try_cast(t)).alias(n) for n, t in kinds.items()]))


def normalize_rules(rules: DataFrame) -> DataFrame:
    from ..functions.config import NON_CALLABLE

    category = F.lower(F.trim(F.col("category")))
    return (
        rules.withColumn("symbol", F.coalesce(blank_to_null(F.col("symbol")), blank_to_null(F.col("name")) if "name" in rules.columns else F.lit(None)))
        .withColumn("risk", F.coalesce(F.lower(F.trim(F.col("risk"))), F.lit("high")))
        .withColumn("call_required", F.coalesce(F.col("needs_paren"), ~F.coalesce(category.isin(*NON_CALLABLE), F.lit(False))))
        .withColumn("rule_id", blank_to_null(F.col("rule_id")))
        .filter("symbol is not null")
    )


def read_repos(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A list of repositories as JSON lines, and a warning for each line that cannot be used."""
    # A list is one file of a few lines for each repository: its lines are numbered whole.
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n", -1)).alias("pos", "value"))
    text = whole.select("value", (F.col("pos") + 1).alias("source_line"))
    parsed = text.filter(F.trim("value") != "").withColumn("j", F.from_json("value", REPO_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    url = blank_to_null(F.col("j.repo_url"))
    reason = F.when(F.col("j").isNull() | F.col("j._bad").isNotNull(), "malformed JSON").when(url.isNull(), "missing repo_url").when(carries_credentials(url), "credentials in repo_url")
    judged = parsed.withColumn("warning", reason)
    good = judged.filter("warning is null").select("source_line", url.alias("repo_url"), "j.ref", "j.name", F.coalesce("j.enabled", F.lit(True)).alias("enabled"), "j.scan_overrides")
    return good, judged.filter("warning is not null").select("source_line", "warning")


# What a list may set for one repository, and what it no longer may.
OVERRIDES = ("include", "exclude", "max_file_size", "llm", "model", "min_risk", "detect_y2106", "confidence_floor", "include_no_findings", "config_override", "reasoning_effort", "request_timeout_sec")
REMOVED_OVERRIDES = ("disable_stage1",)


def check_overrides(repos: DataFrame) -> DataFrame:
    """Repositories with only the settings that are known, a warning for each other one, and an error where a removed one is set."""
    names = F.coalesce(F.map_keys("scan_overrides"), F.array().cast("array<string>"))
    unknown = F.array_except(names, F.array(*map(F.lit, (*OVERRIDES, *REMOVED_OVERRIDES))))
    removed = F.array_intersect(names, F.array(*map(F.lit, REMOVED_OVERRIDES)))
    return repos.withColumns({
        "override_warnings": F.transform(F.array_sort(unknown), lambda k: F.concat(F.lit("ignoring unknown scan_overrides key: "), k)),
        "override_error": F.when(F.size(removed) > 0, F.concat(F.lit("scan_overrides."), F.get(removed, F.lit(0)), F.lit(" is not supported"))),
        "scan_overrides": F.map_filter(F.coalesce("scan_overrides", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*OVERRIDES)),
    })


def retired_ids(spark: SparkSession, path: str | None) -> DataFrame:
    """Reserved rule ids from a JSON array; none without a file."""
    schema = "rule_id string"
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("rule_id"))


def read_environment(spark: SparkSession, path: str | None) -> DataFrame | None:
    """An environment configuration, one row; none without a path. A file that was named must hold one object."""
    if path is None:
        return None
    found = spark.read.schema(ENVIRONMENT_SCHEMA + ", _corrupt_record string").json(path, multiLine=True)
    rows = found.limit(2).collect()
    if len(rows) != 1 or rows[0]["_corrupt_record"] is not None:
        raise ValueError(f"no environment configuration: {path}")
    return found.drop("_corrupt_record")


ENVIRONMENT_SCHEMA = (
    "hardware_model string, time_t_size_bits int, time_t_signed string, time64_functions_available string, d_time_bits_supported string, d_time_bits_setting string, c_library string, c_library_other_text string, "
    "os_or_rtos string, notes string, toolchain_flags array<string>, scenario_hint string, mitigation_path string, config_id string"
)


def read_dotenv(text: str, environment: dict[str, str]) -> dict[str, str]:
    """The environment with what a file of KEY=VALUE lines adds; what is set already stays."""
    out = dict(environment)
    for line in text.splitlines():
        key, sign, value = line.strip().partition("=")
        if sign and key.strip() and not line.strip().startswith("#"):
            out.setdefault(key.strip(), value.strip().strip("'").strip('"'))
    return out


def first_setting(environment: dict[str, str], *names: str, default: str = "") -> str:
    """The first of the names that is set to more than blanks."""
    return next((environment[n].strip() for n in names if environment.get(n, "").strip()), default)


def legacy_results(documents: DataFrame) -> DataFrame:
    """Result documents as they were: meta and findings."""
    return documents.select("meta", "findings")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents, and bare arrays of findings as documents without the rest; missing sections are empty."""
    text = spark.read.text(path, wholetext=True)
    bare = F.ltrim("value").startswith("[")
    docs = text.select(F.when(~bare, F.from_json("value", RESULT_SCHEMA)).alias("d"), F.when(bare, F.from_json("value", f"array<{FINDING}>")).alias("f"))
    docs = docs.select("d.schema_version", "d.meta", "d.candidates", "d.assessments", F.coalesce("f", "d.findings").alias("findings"))
    for part in ("candidates", "assessments", "findings"):
        docs = docs.withColumn(part, F.coalesce(part, F.array().cast(docs.schema[part].dataType)))
    return docs

"""Strict checks of what comes from outside: model responses, match records, environment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import MODELS, SIGNS, capability, config_id, mitigation_path, needs_mitigation, scenario_hint, scenario_summary, setting
from ..functions.text import blank_to_null

# The fields of a response item, and what may be asked for more context.
FIELDS = ("function_id", "y2038_summary", "confidence", "issues", "needs_more_context", "needs")
NEEDS = ("callees", "headers", "macros", "structs", "typedefs")
SUMMARIES = ("yes", "no", "abstain")
Y2106_FIELDS = ("issue_type", "y2106_summary")
ISSUE_TYPES = ("y2038", "y2106", "both", "none", "abstain")
#: Each issue has a type, a line and a description, of the right kinds, and nothing else.
_ISSUES_FIT = (
    "forall(coalesce(try_variant_get(item, '$.issues', 'array<variant>'), array()), x -> coalesce(array_sort(map_keys(try_cast(x as map<string, variant>))) = array('description', 'line', 'type'), false) "
    "and coalesce(schema_of_variant(variant_get(x, '$.type', 'variant')) = 'STRING' and schema_of_variant(variant_get(x, '$.description', 'variant')) = 'STRING' "
    "and rlike(schema_of_variant(variant_get(x, '$.line', 'variant')), '^(BIGINT|DOUBLE|DECIMAL.*)$') and try_variant_get(x, '$.line', 'double') = floor(try_variant_get(x, '$.line', 'double')), false))"
)
FLAG = r"^(-{1,2}[A-Za-z0-9_][A-Za-z0-9_-]*(=.+)?|-[DU][A-Za-z0-9_]+(=.+)?)$"
ENV_REQUIRED = ("hardware_model", "time_t_size_bits", "time_t_signed", "c_library")


def parse_items(responses: DataFrame, column: str = "body") -> DataFrame:
    """Items of response arrays as variants, with their position; a body that is no JSON array gives one null item."""
    parsed = F.expr(f"try_cast(try_parse_json({column}) as array<variant>)")
    return responses.select("*", F.posexplode_outer(parsed).alias("pos", "item"))


def _kind(field: str) -> Column:
    return F.expr(f"schema_of_variant(variant_get(item, '$.{field}', 'variant'))")


def judge_items(items: DataFrame, detect_y2106: bool = False) -> DataFrame:
    """Adds ``problem``, null for an item with exactly the right fields and types, and the typed columns of those without a problem.

    Numbers given as text, texts given as numbers, extra and missing fields are problems; nothing is coerced, but a whole float may be a line. With
    ``detect_y2106`` an item has two more fields. ``function_id`` stands wherever it is a text, and ``has_id`` tells whether the field is there at all.
    """
    fields = F.expr("array_sort(map_keys(try_cast(item as map<string, variant>)))")
    want = F.array(*map(F.lit, sorted((*FIELDS, *Y2106_FIELDS) if detect_y2106 else FIELDS)))
    number = F.expr("try_variant_get(item, '$.confidence', 'double')")
    needs = F.expr("try_variant_get(item, '$.needs', 'array<string>')")
    text = lambda f: F.expr(f"try_variant_get(item, '$.{f}', 'string')")
    enum = lambda f, values: (_kind(f) != "STRING") | ~F.coalesce(text(f).isin(*values), F.lit(False))
    needs_kinds = F.expr("transform(coalesce(try_variant_get(item, '$.needs', 'array<variant>'), array()), x -> schema_of_variant(x))")
    problem = (
        F.when(F.col("item").isNull() | fields.isNull(), "not an object")
        .when(F.size(F.array_except(want, fields)) > 0, "missing field").when(F.size(F.array_except(fields, want)) > 0, "extra field")
        .when(_kind("function_id") != "STRING", "function_id").when(enum("y2038_summary", SUMMARIES), "summary")
        .when(~_kind("confidence").rlike(r"^(BIGINT|DOUBLE|DECIMAL.*)$") | ~F.coalesce(number.between(0.0, 1.0), F.lit(False)), "confidence")
        .when(_kind("needs_more_context") != "BOOLEAN", "needs_more_context").when(~_kind("issues").startswith("ARRAY"), "issues")
        .when(~_kind("needs").startswith("ARRAY") | needs.isNull() | ~F.forall(needs_kinds, lambda k: k == "STRING") | ~F.forall(needs, lambda x: F.coalesce(x.isin(*NEEDS), F.lit(False))), "needs")
        .when(~F.expr(_ISSUES_FIT), "issue")
    )
    if detect_y2106:
        problem = problem.when(enum("y2106_summary", SUMMARIES), "y2106_summary").when(enum("issue_type", ISSUE_TYPES), "issue_type")
    ok = F.col("problem").isNull()
    get = lambda f, t: F.when(ok, F.expr(f"try_variant_get(item, '$.{f}', '{t}')"))
    issues = F.when(ok, F.expr("transform(try_variant_get(item, '$.issues', 'array<variant>'), x -> named_struct('type', variant_get(x, '$.type', 'string'), 'line', cast(variant_get(x, '$.line', 'double') as int), 'description', variant_get(x, '$.description', 'string')))"))
    columns = {
        "has_id": F.when(fields.isNotNull(), F.array_contains(fields, "function_id")), "function_id": F.when(_kind("function_id") == "STRING", text("function_id")), "summary": get("y2038_summary", "string"), "confidence": get("confidence", "double"), "issues": issues,
        "needs_more_context": get("needs_more_context", "boolean"), "needs": get("needs", "array<string>"),
    }
    if detect_y2106:
        columns |= {"y2106_summary": get("y2106_summary", "string"), "issue_type": get("issue_type", "string")}
    return items.withColumn("problem", problem).withColumns(columns)


def column_problem(start: Column, end: Column) -> Column:
    """Both or neither, not negative, in order; null where they are."""
    return F.when(start.isNull() != end.isNull(), "one missing").when((start < 0) | (end < 0), "negative").when(start > end, "out of order")


def summary_problem(matches: Column, count: Column, risk: Column) -> Column:
    """Whether a line record's count and highest risk agree with its matches."""
    rank = lambda r: F.when(r == "high", 2).when(r == "medium", 1).when(r == "low", 0).otherwise(-1)
    top = F.array_max(F.transform(matches, lambda m: rank(m["risk"])))
    return F.when(F.size(matches) == 0, "no matches").when(count != F.size(matches), "count").when(rank(risk) != top, "risk").when(F.size(F.array_distinct(F.transform(matches, lambda m: m["line"]))) > 1, "lines")


def support_errors(supported: Column, setting: Column) -> list[Column]:
    """What contradicts in the support of a setting and its value."""
    away = setting == "not_available"
    return [
        F.when(~supported & ~F.coalesce(away, F.lit(False)), "d_time_bits_setting must be not_available where d_time_bits_supported is false"),
        F.when(supported & away, "d_time_bits_setting cannot be not_available where d_time_bits_supported is true"),
        F.when(supported.isNull() & away, "d_time_bits_setting cannot be not_available where d_time_bits_supported is unknown"),
    ]


def environment_errors(config: DataFrame) -> DataFrame:
    """Adds ``errors``: missing and wrong values, and settings that contradict each other. Columns that are not there are missing values."""
    has = set(config.columns)
    c = lambda name, kind="string": F.col(name) if name in has else F.lit(None).cast(kind)
    checks = [F.when(c(f).isNull(), F.concat(F.lit("missing "), F.lit(f))) for f in ENV_REQUIRED] + [
        F.when(~F.upper(c("hardware_model")).isin(*MODELS), "hardware_model"), F.when(~F.lower(c("time_t_signed")).isin(*SIGNS), "time_t_signed"), F.when(~c("time_t_size_bits", "int").isin(32, 64), "time_t_size_bits"),
        F.when((F.lower(c("c_library")) == "other") & F.coalesce(F.trim(c("c_library_other_text")) == "", F.lit(True)), "c_library_other_text"),
        *support_errors(c("d_time_bits_supported", "boolean"), c("d_time_bits_setting")),
        F.when(needs_mitigation(c("scenario_hint")) & c("mitigation_path").isNull(), "mitigation_path"),
        F.when(F.exists(F.coalesce(c("toolchain_flags", "array<string>"), F.array().cast("array<string>")), lambda f: ~F.coalesce(f.rlike(FLAG), F.lit(False))), "toolchain_flags"),
    ]
    return config.withColumn("errors", F.array_compact(F.array(*checks)))


def normalize_environment(config: DataFrame) -> DataFrame:
    """Upper and lower case, numbers and three-valued capabilities where they belong; blank optional texts and empty flag lists become null."""
    has, out = set(config.columns), {}
    for name, make in {
        "hardware_model": lambda v: F.upper(F.trim(v)), "time_t_signed": lambda v: F.lower(F.trim(v)), "time_t_size_bits": lambda v: v.try_cast("int"),
        **{n: capability for n in ("time64_functions_available", "d_time_bits_supported")}, "d_time_bits_setting": setting,
        **{n: blank_to_null for n in ("os_or_rtos", "c_library_other_text", "notes")}, "toolchain_flags": lambda v: F.when(F.size(v) > 0, v),
    }.items():
        if name in has:
            out[name] = make(F.col(name))
    return config.withColumns(out)


def derive_environment(config: DataFrame) -> DataFrame:
    """Adds scenario_hint, mitigation_path, config_id and a one-line summary."""
    c = F.col
    hint = scenario_hint(c("hardware_model"), c("time_t_size_bits"), c("time_t_signed"), c("time64_functions_available"))
    found = config.withColumn("scenario_hint", hint).withColumn("mitigation_path", mitigation_path(c("scenario_hint"))).withColumn("config_id", config_id(c("hardware_model"), c("time_t_signed"), c("time_t_size_bits")))
    return found.withColumn("summary", scenario_summary(F.struct(*[c(n) for n in ENV_SUMMARY])))


ENV_SUMMARY = ("hardware_model", "time_t_size_bits", "time_t_signed", "time64_functions_available", "d_time_bits_supported", "d_time_bits_setting", "c_library", "c_library_other_text")

"""Scalar functions over environment configurations, risks and confidences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Risk ranks, and the categories whose symbols are not calls.
RISK_RANK = {"low": 0, "medium": 1, "high": 2}
NON_CALLABLE = ("constant/definition", "env variable", "global variable", "macro", "simple type", "structure")
MODELS, SIGNS, BITS = ("ILP32", "LP64"), ("signed", "unsigned"), (32, 64)
# What each configuration means.
CONFIG_NOTES = {
    ("ILP32", "signed", 32): "ILP32 with signed 32-bit time_t (classic Y2038 scenario)",
    ("ILP32", "signed", 64): "ILP32 with signed 64-bit time_t (narrowing pattern risks)",
    ("ILP32", "unsigned", 32): "ILP32 with unsigned 32-bit time_t (Y2106 scenario)",
    ("ILP32", "unsigned", 64): "ILP32 with unsigned 64-bit time_t (narrowing pattern risks)",
    ("LP64", "signed", 32): "LP64 with signed 32-bit time_t (rare, Y2038 scenario)",
    ("LP64", "signed", 64): "LP64 with signed 64-bit time_t (modern safe, narrowing pattern risks)",
    ("LP64", "unsigned", 32): "LP64 with unsigned 32-bit time_t (rare, Y2106 scenario)",
    ("LP64", "unsigned", 64): "LP64 with unsigned 64-bit time_t (rare, narrowing pattern risks)",
}


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "high", 2).when(risk == "medium", 1).when(risk == "low", 0).otherwise(-1)


def clamp_confidence(value: Column) -> Column:
    """Within 0 and 1; null for what is no finite number."""
    x = value.try_cast("double")
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def coerce_confidence(value: Column) -> Column:
    x = value.try_cast("double")
    return F.when(x.between(0.0, 1.0), x)


def derived_risk(severity: Column, confidence: Column) -> Column:
    """Struct of risk and where it comes from: a valid severity, else the confidence bands."""
    s = F.lower(F.trim(severity))
    return (
        F.when(s.isin("critical", "high", "medium", "low"), F.struct(s.alias("risk"), F.lit("severity").alias("source")))
        .when(confidence.isNull(), F.struct(F.lit("unknown").alias("risk"), F.lit("none").alias("source")))
        .otherwise(F.struct(F.when(confidence >= 0.90, "high").when(confidence >= 0.75, "medium").otherwise("low").alias("risk"), F.lit("derived").alias("source")))
    )


def issue_class(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("yes", "no", "abstain"), v).otherwise("unknown")


def capability(value: Column) -> Column:
    """True, false, or null where it is not known."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("yes", "true"), True).when(v.isin("no", "false"), False)


def capability_suffix(value: Column) -> Column:
    return F.when(value, "yes").when(~value, "no").otherwise("unknown")


def config_id(model: Column, sign: Column, bits: Column) -> Column:
    """Null unless all three are valid."""
    m, s = F.upper(F.trim(model)), F.lower(F.trim(sign))
    return F.when(m.isin(*MODELS) & s.isin(*SIGNS) & bits.isin(*BITS), F.concat_ws("_", F.lower(m), s, F.concat(bits.cast("string"), F.lit("bit"))))


def scenario_hint(model: Column, bits: Column, sign: Column, time64: Column) -> Column:
    risky = (model == "ILP32") & (bits == 32) & sign.isin("signed", "unsigned")
    return F.when(risky, F.concat(F.lit("ILP32-32bit-"), sign, F.lit("-time64_"), capability_suffix(time64))).when((model == "ILP32") & (bits == 64), "ILP32-64bit-N/A").otherwise("LP64-64bit-N/A")


# The scenarios that must name a way out.
RISKY_HINTS = ("ILP32-32bit-signed-time64_no", "ILP32-32bit-signed-time64_unknown")


def needs_mitigation(hint: Column) -> Column:
    """Whether a scenario must name a mitigation path: one of the risky ones, or one of them with more behind a dash."""
    return F.coalesce(reduce(lambda a, b: a | b, [(hint == h) | hint.startswith(f"{h}-") for h in RISKY_HINTS]), F.lit(False))


def mitigation_path(hint: Column) -> Column:
    return F.when(needs_mitigation(hint), "upgrade_env")


def positive_int(value: Column) -> Column:
    """A whole number above 0, else null."""
    n = value.try_cast("int")
    return F.when(n > 0, n)


def describe_capability(value: Column, yes: Column | str, no: Column | str, unknown: Column | str) -> Column:
    """One of three texts for a capability."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(value, text(yes)).when(~value, text(no)).otherwise(text(unknown))


def setting(value: Column) -> Column:
    """A setting as it is; what is blank or stands for nothing is unknown."""
    v = F.trim(value.cast("string"))
    return F.when(v.isNull() | (v == "") | F.lower(v).isin("none", "null", "unknown"), "unknown").otherwise(v)


def is_overflow_risk(bits: Column) -> Column:
    return bits == 32


def is_narrowing_only(bits: Column) -> Column:
    return bits == 64


def parse_config_id(value: Column) -> Column:
    """Struct of model, sign and bits of an id; null for what is none."""
    pattern = r"^(?i)(ilp32|lp64)_(signed|unsigned)_(32|64)bit$"
    v = F.trim(value)
    made = F.struct(F.upper(F.regexp_extract(v, pattern, 1)).alias("hardware_model"), F.lower(F.regexp_extract(v, pattern, 2)).alias("time_t_signed"), F.regexp_extract(v, pattern, 3).cast("int").alias("time_t_size_bits"))
    return F.when(v.rlike(pattern), made)


def expand_config_id(value: Column) -> Column:
    """Struct of a whole environment from an id: what the id does not establish is unknown. Null for what is no id."""
    c, cid = parse_config_id(value), F.lower(F.trim(value))
    notes = F.element_at(F.create_map(*[F.lit(x) for (m, s, b), t in CONFIG_NOTES.items() for x in (f"{m.lower()}_{s}_{b}bit", t)]), cid)
    bits = c["time_t_size_bits"]
    row = F.struct(
        cid.alias("config_id"), c["hardware_model"].alias("hardware_model"), bits.alias("time_t_size_bits"), c["time_t_signed"].alias("time_t_signed"), F.lit(None).cast("boolean").alias("time64_functions_available"),
        F.lit(None).cast("boolean").alias("d_time_bits_supported"), F.lit("unknown").alias("d_time_bits_setting"), F.lit("other").alias("c_library"), F.lit("unspecified (derived from config id)").alias("c_library_other_text"), F.lit("unspecified").alias("os_or_rtos"),
        F.concat(notes, F.lit(". Derived from config id "), cid, F.lit("; C library, OS/RTOS, time64 entry points and _TIME_BITS support are not established by the config id.")).alias("notes"),
        F.concat(c["hardware_model"], F.lit("-"), bits.cast("string"), F.lit("bit-"), c["time_t_signed"], F.lit("-time64_unknown")).alias("scenario_hint"), F.when(bits == 32, "upgrade_env").alias("mitigation_path"),
    )
    return F.when(c.isNotNull(), row)


def recommended_id(recommended: Column) -> Column:
    """The id in a recommendation (config_id, or hardware_model, time_t_signed and time_t_size_bits); null unless it is one of the eight."""
    own = F.lower(F.trim(recommended["config_id"]))
    made = F.concat_ws("_", F.lower(recommended["hardware_model"]), F.lower(recommended["time_t_signed"]), F.concat(recommended["time_t_size_bits"].cast("string"), F.lit("bit")))
    return F.when(parse_config_id(own).isNotNull(), own).when(parse_config_id(made).isNotNull(), made)


def config_error(model: Column, sign: Column, bits: Column) -> Column:
    """Struct of whether a configuration is valid, its id and what is wrong."""
    missing = F.concat_ws(", ", F.when(model.isNull(), "hardware_model"), F.when(bits.isNull(), "time_t_size_bits"), F.when(sign.isNull(), "time_t_signed"))
    cid = config_id(model, sign, bits)
    error = F.when(missing != "", F.concat(F.lit("Missing required fields: "), missing)).when(cid.isNull(), "Invalid configuration combination")
    return F.struct(error.isNull().alias("ok"), cid.alias("config_id"), error.alias("error"))


def scenario_summary(c: Column) -> Column:
    """One line about an environment, given as a struct."""
    kept = setting(c["d_time_bits_setting"])
    support = describe_capability(c["d_time_bits_supported"], F.concat(F.lit("supported:"), kept), "not_supported", F.concat(F.lit("support_unknown:"), kept))
    other = F.when((c["c_library"] == "other") & (F.coalesce(c["c_library_other_text"], F.lit("")) != ""), F.concat(c["c_library"], F.lit("("), c["c_library_other_text"], F.lit(")"))).otherwise(F.coalesce(c["c_library"], F.lit("unknown")))
    return F.concat(
        F.coalesce(c["hardware_model"], F.lit("unknown")), F.lit(", time_t="), F.coalesce(c["time_t_size_bits"], F.lit(0)).cast("string"), F.lit(" "), F.coalesce(c["time_t_signed"], F.lit("unknown")), F.lit(", time64="), capability_suffix(c["time64_functions_available"]),
        F.lit(", _TIME_BITS="), support, F.lit(", c_lib="), other,
    )


def configurations(spark: SparkSession) -> DataFrame:
    """The eight valid configurations, with what they mean."""
    rows = [(m, s, b, f"{m.lower()}_{s}_{b}bit", CONFIG_NOTES[m, s, b]) for m in MODELS for s in SIGNS for b in BITS]
    literal = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("hardware_model", "time_t_signed", "time_t_size_bits", "config_id", "description"), row, strict=True)]) for row in rows])
    return spark.range(1, numPartitions=1).select(F.inline(literal))


def schema_version(text: Column) -> Column:
    """Major and minor as a struct; suffixes are ignored and a missing minor is 0; null for other texts."""
    core = F.element_at(F.split(F.element_at(F.split(F.trim(text), r"\+"), 1), "-"), 1)
    pattern = r"^(\d+)(?:\.(\d*)(?:\..*)?)?$"
    made = F.struct(F.regexp_extract(core, pattern, 1).cast("int").alias("major"), F.coalesce(F.regexp_extract(core, pattern, 2).try_cast("int"), F.lit(0)).alias("minor"))
    return F.when(core.rlike(pattern), made)


def supports_assessments(version: Column) -> Column:
    """Whether a document of this schema may have assessments: from 1.1 on."""
    v = schema_version(version)
    return F.coalesce((v["major"] > 1) | ((v["major"] == 1) & (v["minor"] >= 1)), F.lit(False))


def http_category(status: Column) -> Column:
    return (
        F.when(status.isin(401, 403), "auth").when(status.isin(400, 404, 405, 413), "client_error").when(status == 429, "rate_limit").when(status.between(500, 599), "server_error").otherwise("http_error")
    )


def http_retryable(status: Column) -> Column:
    """Everything but what asking again cannot change."""
    return ~status.isin(400, 401, 403, 404, 405, 413)

"""Environments as a model answers them: JSON texts to columns, with all that is wrong in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import BITS, MODELS, SIGNS, capability, needs_mitigation, setting
from .wire import FLAG, support_errors

# What an answer must have, the values that are known, and the form of a hint.
REQUIRED = ("hardware_model", "time_t_size_bits", "time_t_signed", "time64_functions_available", "d_time_bits_supported", "d_time_bits_setting", "c_library")
SETTINGS = ("unknown", "not_available", "not_set", "32", "64")
LIBRARIES = ("glibc", "newlib", "picolibc", "musl", "minimal", "libstdc++", "other")
PATHS = ("upgrade_env", "stay_and_patch")
HINT = r"^(ILP32|LP64)-(32|64)bit(-(signed|unsigned))?(-time64_(yes|no|unknown))?(-(N/A|_TIME_BITS_(32|64|not_set|unknown)))?$"
CAPABILITIES = ("time64_functions_available", "d_time_bits_supported")
TEXTS = ("os_or_rtos", "notes", "c_library_other_text")


def detected_environments(answers: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds to answers the environment in each, normalised, and ``errors``, all that is wrong in the answer as it was given.

    Numbers may come as texts, capabilities have three values, a setting that says nothing is unknown, flags that are no list are none, a blank system is null. An answer that is no JSON
    object, a null text among them, has null fields and one error.
    """
    # Parsed once: as an expression it would be parsed anew for every field and test.
    answers = answers.withColumn("__v", F.try_parse_json(F.col(text_col)))
    v = F.col("__v")
    part = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    kind = lambda name: F.schema_of_variant(part(name, "variant"))
    text = lambda name: part(name, "string")
    is_text, is_list = lambda name: kind(name) == "STRING", lambda name: kind(name).startswith("ARRAY")

    def wrong(name: str, right: Column) -> Column:
        """An error where a value is given that is not right; a value of JSON null is given."""
        return F.when(part(name, "variant").isNotNull() & ~F.coalesce(right, F.lit(False)), F.concat(F.lit("wrong "), F.lit(name)))

    none = kind("mitigation_path") == "VOID"
    flags = part("toolchain_flags", "array<string>")
    other = (text("c_library") == "other") & ~F.coalesce(is_text("c_library_other_text") & (F.length(text("c_library_other_text")) > 0), F.lit(False))
    schema = [F.when(part(n, "variant").isNull(), F.concat(F.lit("missing "), F.lit(n))) for n in REQUIRED] + [
        wrong("hardware_model", is_text("hardware_model") & text("hardware_model").isin(*MODELS)),
        wrong("time_t_size_bits", kind("time_t_size_bits").isin("BIGINT") & part("time_t_size_bits", "int").isin(*BITS)),
        wrong("time_t_signed", is_text("time_t_signed") & text("time_t_signed").isin(*SIGNS)),
        *[wrong(n, kind(n).isin("BOOLEAN", "VOID")) for n in CAPABILITIES],
        wrong("d_time_bits_setting", is_text("d_time_bits_setting") & text("d_time_bits_setting").isin(*SETTINGS)),
        wrong("c_library", is_text("c_library") & text("c_library").isin(*LIBRARIES)),
        *[wrong(n, is_text(n)) for n in TEXTS],
        wrong("toolchain_flags", kind("toolchain_flags").isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(flags, lambda f: F.coalesce(f.rlike(FLAG), F.lit(False)))),
        wrong("scenario_hint", is_text("scenario_hint") & text("scenario_hint").rlike(HINT)),
        wrong("mitigation_path", none | (is_text("mitigation_path") & text("mitigation_path").isin(*PATHS))),
        F.when(other, "c_library_other_text must say which library"),
        F.when(needs_mitigation(text("scenario_hint")) & F.coalesce(none, F.lit(True)), "mitigation_path must be given for a risky scenario"),
    ]
    rules = [*support_errors(capability(text("d_time_bits_supported")), text("d_time_bits_setting")), F.when(~F.coalesce(is_list("toolchain_flags"), F.lit(True)), "toolchain_flags must be a list")]
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    fields = {
        "hardware_model": text("hardware_model"), "time_t_size_bits": text("time_t_size_bits").try_cast("int"), "time_t_signed": text("time_t_signed"), **{n: capability(text(n)) for n in CAPABILITIES},
        "d_time_bits_setting": F.when(part("d_time_bits_setting", "variant").isNotNull(), setting(text("d_time_bits_setting"))), "c_library": text("c_library"), "c_library_other_text": text("c_library_other_text"),
        "os_or_rtos": F.when(text("os_or_rtos") != "", text("os_or_rtos")), "notes": text("notes"),
        "toolchain_flags": F.when(part("toolchain_flags", "variant").isNotNull(), F.when(is_list("toolchain_flags"), flags).otherwise(F.array().cast("array<string>"))),
    }
    errors = F.when(is_object, F.array_compact(F.array(*schema, *rules))).otherwise(F.array(F.lit("not a JSON object")))
    return answers.withColumns({n: F.when(is_object, c) for n, c in fields.items()} | {"errors": errors}).drop("__v")

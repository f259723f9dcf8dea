"""I/O boundaries: calls that write or read a time in a form that a change of its type breaks, scored; and the migration risks of lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Calls by kind, the weights of the score, and the default threshold.
FORMATTED = ("printf", "fprintf", "sprintf", "snprintf", "vprintf", "vfprintf", "vsprintf", "vsnprintf", "scanf", "fscanf", "sscanf", "vscanf", "vfscanf", "vsscanf")
RAW = ("read", "write", "pread", "pwrite", "recv", "send", "recvfrom", "sendto", "fread", "fwrite", "memcpy", "memmove")
EXTERNAL = ("ioctl",)
WEIGHTS = {
    "io_function_hit": 1.0, "direct_time_t": 2.0, "sizeof_time_t": 2.0, "struct_time_field": 3.0, "explicit_cast": 3.0, "format_mismatch": 3.0, "external_boundary": 4.0,
    "safe_serialization": -2.0, "explicit_safe_conversion": -2.0,
}
THRESHOLD, VARIABLE_FORMAT_SCORE, HEAD_CHARS = 6.0, 2.0, 8192
CATEGORIES = {"formatted_io_mismatch": "manual_code_review", "raw_representation_risk": "manual_interface_review_required", "external_interface_risk": "manual_interface_review_required"}
# What tells of time in a line whose migration is judged, and the integer types of 32 bits.
MIGRATION_CALLS = ("time", "gettimeofday", "clock_gettime", "localtime", "gmtime", "mktime")
NARROW_CAST = r"(?i)\(int32_t\)|\(uint32_t\)|\(int\)|\(unsigned\s+int\)|\(long\)\s*(?!\s*long)"
NARROW_SIZEOF = r"(?i)sizeof\s*\(\s*(?:int32_t|uint32_t|int|unsigned\s+int|long)\s*\)"
LITERAL_FOUR = r"(?:read|write|fread|fwrite|memcpy|memmove)\s*\([^,]+,\s*[^,]+,\s*4\s*\)"
SIGN_CHECK = r"<\s*0|>\s*-1|==\s*-1|!=\s*-1|<=?\s*-1|>=?\s*-1"
NUMBER_GIVEN = r"=\s*-?\d+"
IO_FIELDS = "io_function string, io_category string, score double, reasoning string"


@dataclass(frozen=True)
class Abi:
    """What is known of the platform."""

    model: str = "LP64"
    bits: int = 64
    signed: bool = True

    @property
    def sign(self) -> str:
        return "signed" if self.signed else "unsigned"


def score(flags: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of what is seen at a call; -1 where none of it is a time."""
    w = WEIGHTS if weights is None else weights
    add = lambda k: F.when(flags[k], w[k]).otherwise(0.0)
    total = F.lit(w["io_function_hit"])
    for k in flags:
        total = total + add(k)
    context = F.lit(False)
    for k in ("direct_time_t", "sizeof_time_t", "struct_time_field"):
        if k in flags:
            context = context | flags[k]
    return F.when(context, total).otherwise(-1.0)


def confidence_band(value: Column) -> Column:
    return F.when(value >= 8, "high_confidence").when(value >= 5, "medium_confidence").otherwise("low_confidence")


def format_specs(text: Column, model: str = "LP64") -> Column:
    """Integer conversions of a format string as an array of structs: spec, position, bits (null where unknown), signed."""
    pattern = r"%[-+0 #]*\d*\.?\d*([hl]*)([diuoxX])"
    long_bits = 32 if model == "ILP32" else 64

    def spec(x: Column, i: Column) -> Column:
        length, kind = F.regexp_extract(x, pattern, 1), F.lower(F.regexp_extract(x, pattern, 2))
        length = F.when(length.isin("h", "l", "ll"), length).otherwise("")
        bits = F.when(kind != "o", F.when(length == "", 32).when(length == "l", long_bits).when(length == "ll", 64))
        return F.struct(F.concat(F.lit("%"), length, kind).alias("spec"), i.alias("position"), bits.alias("bits"), (kind.isin("d", "i") & (length != "h")).alias("signed"))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spec)


def width_differs(bits: Column, time_bits: int) -> Column:
    return F.coalesce(bits != time_bits, F.lit(False))


def spec_problem(spec: Column, abi: Abi) -> Column:
    """Why a conversion does not fit the time type; null where it does or its width is unknown."""
    width, sign = spec["bits"] != abi.bits, spec["signed"] != abi.signed
    size = F.concat(spec["bits"].cast("string"), F.lit(f"-bit specifier vs {abi.bits}-bit time_t"))
    kind = F.when(spec["signed"], "signed").otherwise("unsigned")
    return (
        F.when(spec["bits"].isNull(), None).when(width & sign, F.concat(F.lit("Width mismatch ("), size, F.lit(") and sign mismatch"))).when(width, F.concat(F.lit("Width mismatch ("), size, F.lit(")")))
        .when(sign, F.concat(F.lit("Sign mismatch ("), kind, F.lit(f" specifier vs {abi.sign} time_t)")))
    )


def _calls(names: tuple[str, ...]) -> Column:
    """The calls of these names on a line, once each: name and the text behind the first opening parenthesis."""
    listed = ", ".join(f"'{n}'" for n in names)
    return F.expr(
        rf"transform(filter(array({listed}), f -> regexp_like(__line, concat(r'(?i)\b', f, r'\s*\('))), f -> named_struct('name', f, 'tail', regexp_extract(__line, concat(r'(?i)\b', f, r'\s*\((.*)$'), 1)))"
    )


def _any_call(names: tuple[str, ...]) -> Column:
    return F.regexp_like("__line", F.lit(rf"(?i)\b(?:{'|'.join(names)})\s*\("))


def format_literal(tail: Column) -> Column:
    """The first quoted text behind a call; null if there is none."""
    quoted = r"""["']([^"']*)["']"""
    return F.when(tail.rlike(quoted), F.regexp_extract(tail, quoted, 1))


def formatted_hits(line: Column, variables: Column, abi: Abi) -> Column:
    """Rows of calls with a format, as an array of structs of ``IO_FIELDS``; ``__line`` must be a column."""
    mismatch = WEIGHTS["io_function_hit"] + WEIGHTS["direct_time_t"] + WEIGHTS["format_mismatch"]
    made = lambda name, value, reason: F.struct(name.alias("io_function"), F.lit("formatted_io_mismatch").alias("io_category"), F.lit(value).alias("score"), reason.alias("reasoning"))

    def rows(call: Column) -> Column:
        literal, bearing = format_literal(call["tail"]), F.arrays_overlap(F.regexp_extract_all(call["tail"], F.lit(r"\b([A-Za-z_]\w*)\b"), 1), variables)
        problems = F.filter(F.transform(format_specs(F.coalesce(literal, F.lit("")), abi.model), lambda s: spec_problem(s, abi)), lambda p: p.isNotNull())
        of_literal = F.transform(problems, lambda p: made(call["name"], mismatch, F.concat(F.lit("Format specifier mismatch: "), p)))
        variable = F.array(made(call["name"], VARIABLE_FORMAT_SCORE, F.lit("Variable format string with time-bearing argument")))
        none = F.array().cast(of_type)
        return F.when(~bearing, none).when(literal.isNotNull(), of_literal).otherwise(variable)

    of_type = "array<struct<io_function:string,io_category:string,score:double,reasoning:string>>"
    return F.when(_any_call(FORMATTED), F.flatten(F.transform(_calls(FORMATTED), rows)))


def size_argument(tail: Column, aliases: Column, abi: Abi) -> Column:
    """Struct of whether the size behind a call is that of the time type, and the bytes where it is given as a number."""
    inside = F.trim(F.regexp_extract(tail, r"sizeof\s*\(([^)]+)\)", 1))
    named = (inside != "") & (F.contains(inside, F.lit("time_t")) | F.exists(aliases, lambda a: F.contains(inside, a)))
    digit = F.regexp_extract(tail, r"\b([48])\b", 1)
    fits = ~named & (digit == str(abi.bits // 8))
    return F.struct((named | fits).alias("is_time"), F.when(fits, digit.cast("int")).alias("bytes"))


def raw_hits(line: Column, variables: Column, aliases: Column, abi: Abi) -> Column:
    """Rows of calls that move the bytes of a time variable, as an array of structs of ``IO_FIELDS``; ``__line`` must be a column."""
    addressed = F.arrays_overlap(F.regexp_extract_all(line, F.lit(r"&\s*(\w+)"), 1), variables)
    direct = F.regexp_like(line, F.concat(F.lit(r"\b(?:"), F.array_join(F.concat(F.array(F.lit("time_t")), aliases), "|"), F.lit(r")\s+\w+")))
    cast = line.rlike(r"\([^)]+\*?\)\s*\w+")

    def row(call: Column) -> Column:
        size = size_argument(call["tail"], aliases, abi)
        value = score({"direct_time_t": direct, "sizeof_time_t": size["is_time"], "explicit_cast": cast})
        sized = F.when(size["bytes"].isNotNull(), F.concat(F.lit("Size argument is "), size["bytes"].cast("string"), F.lit(" bytes (matches time_t width)"))).otherwise("Size argument is sizeof(time_t) or sizeof(alias)")
        reasons = F.concat_ws("; ", F.when(direct, "Direct time_t or alias variable"), F.when(size["is_time"], sized))
        reason = F.when(reasons == "", "Time-bearing variable in I/O operation").otherwise(reasons)
        return F.struct(call["name"].alias("io_function"), F.lit("raw_representation_risk").alias("io_category"), value.alias("score"), reason.alias("reasoning"))

    return F.when(_any_call(RAW) & addressed, F.filter(F.transform(_calls(RAW), row), lambda x: x["score"] > 0))


def io_files(lines: DataFrame) -> DataFrame:
    """Files whose first ``HEAD_CHARS`` characters call an I/O function; the reach is part of the rule."""
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.select("path", "text", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).alias("at")).filter(F.col("at") < HEAD_CHARS)
    head = F.substring("text", F.lit(1), (HEAD_CHARS - F.col("at")).cast("int"))
    return placed.filter(F.regexp_like(head, F.lit(rf"(?i)\b(?:{'|'.join((*FORMATTED, *RAW, *EXTERNAL))})\s*\("))).select("path").distinct()


def scan_io(known: DataFrame, abi: Abi = Abi(), threshold: float = THRESHOLD) -> DataFrame:
    """Calls at or above the threshold, over lines with context (aliases, assigned).

    path, line, text, io_function, io_category, score, reasoning, io_confidence, remediation_class, affected_symbols and the platform assumed.
    """
    rows = known.withColumn("__line", F.trim("text")).filter("__line <> '' and not startswith(__line, '//') and not startswith(__line, '/*')")
    line, variables = F.col("__line"), F.array_union("assigned", "aliases")
    empty = F.array().cast("array<struct<io_function:string,io_category:string,score:double,reasoning:string>>")
    hits = F.concat(F.coalesce(formatted_hits(line, variables, abi), empty), F.coalesce(raw_hits(line, variables, F.col("aliases"), abi), empty))
    found = rows.filter(_any_call((*FORMATTED, *RAW)) & (F.size(variables) > 0)).select("path", "line", "text", "aliases", F.inline(hits)).filter(F.col("score") >= threshold)
    classes = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return found.withColumns({
        "io_confidence": confidence_band(F.col("score")), "remediation_class": F.element_at(classes, F.col("io_category")),
        "affected_symbols": F.array_sort(F.array_intersect("aliases", F.regexp_extract_all("text", F.lit(r"\b(\w+)\b"), 1))),
        "abi": F.struct(F.lit(abi.model).alias("hardware_model"), F.lit(abi.bits).alias("time_t_size_bits"), F.lit(abi.sign).alias("time_t_signed")),
    }).drop("aliases")


def io_candidates(io: DataFrame) -> DataFrame:
    """I/O rows in the columns of line candidates; equal ones once."""
    return io.select("path", "line", "text", F.col("io_function").alias("symbol"), F.lit("medium").alias("risk"), F.concat(F.lit("I/O-boundary risk: "), "io_category").alias("description"), F.lit("io_boundary").alias("discovery_method")).distinct()


def io_metadata(io: DataFrame) -> DataFrame:
    """What is kept of a place's I/O: of several rows of a line the one with the highest score, then by name."""
    best = F.max_by(F.struct("io_category", "io_function", F.col("score").alias("io_score"), "io_confidence", "remediation_class", "affected_symbols", "abi", "reasoning"), F.struct("score", "io_category", "io_function", "reasoning"))
    return io.groupBy("path", "line").agg(best.alias("m")).select("path", "line", "m.*")


# ---- migration


def migration_tests(code: Column, before: Abi, after: Abi) -> list[Column]:
    """Structs of type, severity, description and remediation for each assumption that a change of platform breaks; null where it does not stand."""
    made = lambda kind, severity, text, advice: F.struct(F.lit(kind).alias("risk_type"), F.lit(severity).alias("severity"), F.lit(text).alias("description"), F.lit(advice).alias("remediation"))
    tests = []
    if before.bits != after.bits and before.bits == 32:
        tests += [
            F.when(code.rlike(NARROW_CAST), made("width_assumption", "blocker", f"Explicit cast to 32-bit type assumes {before.bits}-bit time_t", f"Remove cast or use explicit conversion to {after.bits}-bit type")),
            F.when(code.rlike(NARROW_SIZEOF), made("width_assumption", "high_risk", f"sizeof() assumes 32-bit type, migration to {after.bits}-bit would break", f"Use sizeof(time_t) or explicit {after.bits}-bit type")),
        ]
        if after.bits == 64:
            tests.append(F.when(code.rlike(LITERAL_FOUR), made("io_size_mismatch", "blocker", f"Literal 4-byte assumption in I/O operation, migration to {after.bits}-bit would break", "Use sizeof(time_t) instead of literal 4")))
    if before.signed and not after.signed:
        tests += [
            F.when(code.rlike(SIGN_CHECK), made("signedness_assumption", "blocker", f"Sign check assumes {before.sign} time_t, migration to {after.sign} would break", "Remove sign check or use unsigned-safe comparison")),
            F.when(code.rlike(NUMBER_GIVEN), made("signedness_assumption", "blocker", f"Negative constant assumes {before.sign} time_t, migration to {after.sign} would break", "Use unsigned-safe constant or remove negative value")),
        ]
    if (before.model, after.model) == ("ILP32", "LP64"):
        tests.append(F.when(code.rlike(r"\(long\)\s*(?!long)"), made("architecture_assumption", "medium_risk", "long type cast assumes ILP32 (32-bit), migration to LP64 (64-bit long) would change behavior", "Use explicit int32_t or int64_t instead of long")))
    return tests


def _inline(rows: DataFrame, tests: list[Column], *columns: str) -> DataFrame:
    if not tests:
        return rows.select(*columns, F.lit("").alias("risk_type"), F.lit("").alias("severity"), F.lit("").alias("description"), F.lit("").alias("remediation")).filter(F.lit(False))
    return rows.select(*columns, F.inline(F.array_compact(F.array(*tests))))


def migration_risks(candidates: DataFrame, before: Abi, after: Abi, aliases: DataFrame | None = None) -> DataFrame:
    """Risks of candidates (path, line, symbol, snippet) that tell of time: path, line, symbol, risk_type, severity, description, remediation."""
    code = F.col("snippet")
    if aliases is None:
        rows = candidates.withColumn("__aliases", F.array().cast("array<string>"))
    else:
        own = aliases.groupBy(F.col("tu").alias("path")).agg(F.collect_set("alias").alias("__aliases"))
        rows = candidates.join(own, "path", "left").withColumn("__aliases", F.coalesce("__aliases", F.array().cast("array<string>")))
    bearing = F.array_contains("__aliases", F.col("symbol")) | F.arrays_overlap(F.regexp_extract_all(code, F.lit(r"\b(\w+)\b"), 1), F.array_append("__aliases", F.lit("time_t"))) | code.rlike(rf"\b(?:{'|'.join(MIGRATION_CALLS)})\s*\(")
    return _inline(rows.filter(bearing), migration_tests(code, before, after), "path", "line", "symbol")


def io_migration_risks(metadata: DataFrame, before: Abi, after: Abi) -> DataFrame:
    """Risks of I/O places (path, line, io_category, io_function) by a change of width or sign."""
    c, tests = F.col("io_category"), []
    made = lambda kind, severity, text, advice: F.struct(F.lit(kind).alias("risk_type"), F.lit(severity).alias("severity"), F.lit(text).alias("description"), F.lit(advice).alias("remediation"))
    if before.bits != after.bits:
        tests += [
            F.when(c == "formatted_io_mismatch", made("io_format_mismatch", "high_risk" if before.bits == 32 else "medium_risk", f"Format specifier assumes {before.bits}-bit, migration to {after.bits}-bit would break", f"Update format specifier for {after.bits}-bit time_t")),
            F.when(c.isin("raw_representation_risk", "external_interface_risk"), made("io_size_mismatch", "blocker", f"Raw I/O assumes {before.bits}-bit time_t, migration to {after.bits}-bit would break", "Use explicit conversion or schema-defined wire format")),
        ]
    if before.signed != after.signed:
        tests.append(F.when(c == "formatted_io_mismatch", made("signedness_assumption", "high_risk", f"Format specifier assumes {before.sign} time_t, migration to {after.sign} would break", f"Update format specifier for {after.sign} time_t")))
    return _inline(metadata.withColumn("symbol", F.col("io_function")), tests, "path", "line", "symbol")


def migration_candidates(risks: DataFrame, candidates: DataFrame) -> DataFrame:
    """A candidate for each place with a risk where none stands yet, in the columns of line candidates."""
    kinds = risks.groupBy("path", "line").agg(F.min_by("risk_type", F.struct("severity", "risk_type")).alias("risk_type"))
    fresh = kinds.join(candidates.select("path", "line").distinct(), ["path", "line"], "left_anti")
    return fresh.select("path", "line", F.lit("").alias("text"), F.lit("migration_risk").alias("symbol"), F.lit("high").alias("risk"), F.concat(F.lit("Migration risk: "), "risk_type").alias("description"), F.lit("migration").alias("discovery_method"))


def with_io_metadata(findings: DataFrame, metadata: DataFrame, risks: DataFrame) -> DataFrame:
    """Findings (path, line) with the I/O of their place, else with the first migration risk there."""
    order = F.struct(F.when(F.col("severity") == "blocker", 0).when(F.col("severity") == "high_risk", 1).when(F.col("severity") == "medium_risk", 2).otherwise(3), "risk_type", "description")
    first = risks.groupBy("path", "line").agg(F.min_by(F.struct("risk_type", "severity", F.col("description").alias("impact"), "remediation"), order).alias("r"))
    joined = findings.join(metadata.select("path", "line", "io_category", "io_function", "remediation_class"), ["path", "line"], "left").join(first, ["path", "line"], "left")
    other = lambda f: F.when(F.col("io_category").isNull(), F.col(f"r.{f}"))
    return joined.select(*findings.columns, "io_category", "io_function", "remediation_class", other("risk_type").alias("migration_risk_type"), other("severity").alias("migration_severity"), other("impact").alias("migration_impact"), other("remediation").alias("migration_remediation"))

"""Build files to environment likelihoods: flags, votes, the eight configurations and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.config import config_id, configurations, expand_config_id, setting

# Names and places of build files, and the variables that hold flags.
MAKE_NAMES = ("Makefile", "makefile", "GNUmakefile", "Makefile.in")
MAKE_FOLDERS = ("src", "lib", "drivers", "kernel", "arch")
FLAG_VARIABLES = ("CFLAGS", "CPPFLAGS", "LDFLAGS", "EXTRA_CFLAGS")
MAKE_VARIABLE = r"(?m)^(\w+)[ \t]*[+:]?=[ \t]*(.+)$"
MAKE_INLINE = r"-[mD]\w+(?:=\w+)?"
CMAKE_SET = r"(?is)set\s*\(\s*(\w+)\s+(.+?)\s*\)"
CMAKE_DEFINITIONS = r"(?is)add_(?:compile_)?definitions\s*\((.+?)\)"
DEFINE = r"-D(\w+(?:=\w+)?)"
BUILD_FILES = 10


def make_files(files: DataFrame, project: str = "project") -> DataFrame:
    """The Makefiles of each project (project, path, content): those at its root by name, then those in the usual folders; the first ten."""
    parts = F.split("path", "/")
    root = F.array_position(F.array(*map(F.lit, MAKE_NAMES)), F.col("path"))
    below = (F.element_at(parts, -1) == "Makefile") & (F.size(parts) > 1) & F.arrays_overlap(F.slice(parts, 1, 3), F.array(*map(F.lit, MAKE_FOLDERS)))
    order = Window.partitionBy(project).orderBy(F.when(root > 0, root).otherwise(len(MAKE_NAMES) + 1), "path")
    return files.filter((root > 0) | below).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= BUILD_FILES)


def cmake_files(files: DataFrame, project: str = "project") -> DataFrame:
    """The CMake files of each project, the one at its root first, up to four steps deep; the first ten."""
    parts = F.split("path", "/")
    order = Window.partitionBy(project).orderBy(F.size(parts) > 1, "path")
    return files.filter((F.element_at(parts, -1) == "CMakeLists.txt") & (F.size(parts) <= 4)).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= BUILD_FILES)


def _pairs(pattern: str) -> Column:
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.upper(F.regexp_extract(x, pattern, 1)).alias("name"), F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(x, pattern, 2)), r"^[\"']|[\"']$", ""), r"(?m)#.*$", "")).alias("value")))


def _facts(rows: DataFrame, variables: Column, flags: Column, defines: Column, tool: str, keep_other: bool) -> DataFrame:
    """project, n (the file's place), variables, flags, defines and toolchain of each file."""
    value = F.get(F.filter(variables, lambda v: v["name"] == tool), F.lit(0))["value"]
    prefix = F.regexp_extract(value, r"^([\w-]+)-gcc", 1)
    chain = F.when(prefix != "", prefix).when(F.lit(keep_other), value)
    return rows.select("project", "n", variables.alias("variables"), F.array_distinct(flags).alias("flags"), F.array_distinct(defines).alias("defines"), F.nullif(chain, F.lit("")).alias("toolchain"))


def _flags_of(variables: Column, wanted) -> Column:
    words = F.transform(F.filter(variables, wanted), lambda v: F.filter(F.split(v["value"], r"\s+"), lambda w: w != ""))
    return F.flatten(words)


def make_facts(files: DataFrame) -> DataFrame:
    """What the Makefiles of ``make_files`` say."""
    rows = files.withColumn("v", _pairs(MAKE_VARIABLE))
    own = _flags_of(F.col("v"), lambda v: v["name"].isin(*FLAG_VARIABLES))
    flags = F.concat(own, F.regexp_extract_all("content", F.lit(MAKE_INLINE), F.lit(0)))
    return _facts(rows, F.col("v"), flags, F.regexp_extract_all(F.array_join(flags, " "), F.lit(DEFINE), F.lit(1)), "CC", True)


def cmake_facts(files: DataFrame) -> DataFrame:
    """What the files of ``cmake_files`` say."""
    rows = files.withColumn("v", _pairs(CMAKE_SET))
    zephyr = F.when(F.regexp_like("content", F.lit(r"(?i)find_package\s*\(\s*Zephyr")), F.array(F.struct(F.lit("ZEPHYR").alias("name"), F.lit("true").alias("value"))))
    variables = F.concat("v", F.coalesce(zephyr, F.array().cast("array<struct<name:string,value:string>>")))
    flags = _flags_of(F.col("v"), lambda v: F.contains(v["name"], F.lit("CMAKE_C_FLAGS")) | F.contains(v["name"], F.lit("CMAKE_CXX_FLAGS")))
    defines = F.regexp_extract_all(F.array_join(F.regexp_extract_all("content", F.lit(CMAKE_DEFINITIONS), F.lit(1)), " "), F.lit(DEFINE), F.lit(1))
    return _facts(rows, variables, flags, defines, "CMAKE_C_COMPILER", False)


def build_info(facts: DataFrame) -> DataFrame:
    """All facts of a project: flags and defines united, of a variable the last value, of toolchains the first. project, flags, defines, variables, toolchain, n_files."""
    united = facts.groupBy("project").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("defines")))).alias("defines"),
        F.min_by("toolchain", F.when(F.col("toolchain").isNotNull(), F.col("n"))).alias("toolchain"), F.count(F.lit(1)).alias("n_files"),
    )
    last = facts.select("project", "n", F.posexplode("variables").alias("i", "v")).groupBy("project", F.col("v.name").alias("name")).agg(F.max_by(F.col("v.value"), F.struct("n", "i")).alias("value"))
    variables = last.groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("variables"))
    return united.join(variables, "project", "left").withColumn("variables", F.coalesce("variables", F.create_map().cast("map<string,string>")))


def project_info(files: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per project: that of its CMake files, else that of its Makefiles, else an empty one, with the source."""
    cmake = build_info(cmake_facts(cmake_files(files))).withColumn("source", F.lit("cmake"))
    make = build_info(make_facts(make_files(files))).withColumn("source", F.lit("makefile"))
    best = cmake.unionByName(make.join(cmake.select("project"), "project", "left_anti"))
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast("array<string>") if t == "a" else F.create_map().cast("map<string,string>"))
    return projects.select("project").distinct().join(best, "project", "left").select(
        "project", empty("flags", "a").alias("flags"), empty("defines", "a").alias("defines"), empty("variables", "m").alias("variables"), "toolchain", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("source", F.lit("none")).alias("source")
    )


# ---- what is read from the facts


def _vote(arch: str, confidence: float) -> Column:
    return F.struct(F.lit(arch).alias("arch"), F.lit(confidence).alias("conf"))


def march_vote(flag: Column) -> Column:
    """What an -march flag says of the data model, with a confidence; null where it says nothing."""
    a = F.lower(F.regexp_extract(flag, r"-march=([\w-]+)", 1))
    return (
        F.when(a.rlike("armv7|armv6|armv5|armv4"), _vote("ILP32", 0.85)).when(a.isin("i386", "i686"), _vote("ILP32", 0.85)).when(a.isin("x86_64", "amd64"), _vote("LP64", 0.95))
        .when(a.rlike("armv8|aarch64"), _vote("LP64", 0.90)).when(a.startswith("mips64"), _vote("LP64", 0.85))
    )


def toolchain_vote(name: Column) -> Column:
    t = F.lower(name)
    return (
        F.when(t.rlike("arm-none-eabi|arm-eabi"), _vote("ILP32", 0.85)).when(t.startswith("arm-"), _vote("ILP32", 0.80)).when(t.rlike("mips32"), _vote("ILP32", 0.80))
        .when(t.rlike("aarch64"), _vote("LP64", 0.90)).when(t.rlike("x86_64|amd64"), _vote("LP64", 0.90)).when(t.rlike("mips64"), _vote("LP64", 0.85))
    )


def processor_vote(name: Column) -> Column:
    p = F.lower(name)
    return (
        F.when(p.isin("arm", "armv7", "armv6", "armv5"), _vote("ILP32", 0.80)).when(p.isin("i386", "i686"), _vote("ILP32", 0.80)).when(p.rlike("mips32"), _vote("ILP32", 0.75))
        .when(p.isin("aarch64", "arm64", "armv8"), _vote("LP64", 0.85)).when(p.isin("x86_64", "amd64"), _vote("LP64", 0.90)).when(p.rlike("mips64"), _vote("LP64", 0.80))
    )


def architecture(flags: Column, toolchain: Column, variables: Column) -> Column:
    """Struct of data model, confidence and number of votes: the model with the strongest vote, at nine tenths where both have votes; a tie goes to LP64."""
    of_flag = lambda f: F.when(f == "-m32", _vote("ILP32", 0.95)).when(f == "-m64", _vote("LP64", 0.95)).when(f.startswith("-march="), march_vote(f))
    votes = F.array_compact(F.concat(F.transform(flags, of_flag), F.array(toolchain_vote(toolchain), processor_vote(F.element_at(variables, F.lit("CMAKE_SYSTEM_PROCESSOR"))))))
    best = lambda arch: F.array_max(F.transform(F.filter(votes, lambda v: v["arch"] == arch), lambda v: v["conf"]))
    low, high = best("ILP32"), best("LP64")
    both = low.isNotNull() & high.isNotNull()
    model = F.when(both, F.when(low > high, "ILP32").otherwise("LP64")).when(low.isNotNull(), "ILP32").when(high.isNotNull(), "LP64")
    confidence = F.round(F.when(both, F.greatest(low, high) * 0.9).otherwise(F.coalesce(low, high, F.lit(0.0))), 6)
    return F.struct(model.alias("architecture"), confidence.alias("arch_conf"), F.size(votes).alias("arch_votes"))


def time_type(flags: Column, defines: Column, arch: Column) -> Column:
    """Struct of bits and sign of the time type with confidences: an explicit flag, else what the data model suggests; signed unless said otherwise."""
    explicit = F.coalesce(
        F.get(F.filter(F.transform(flags, lambda f: F.regexp_extract(f, r"-D_TIME_BITS=(\d+)", 1)), lambda x: x != ""), F.lit(0)),
        F.get(F.filter(F.transform(defines, lambda d: F.regexp_extract(d, r"^TIME_BITS=(\d+)$", 1)), lambda x: x != ""), F.lit(0)),
    ).cast("int")
    unsigned = F.exists(defines, lambda d: F.contains(F.upper(d), F.lit("TIME_T_UNSIGNED"))) | F.exists(flags, lambda f: f.rlike("-D_TIME_T_UNSIGNED|-DCONFIG_TIME_T_UNSIGNED"))
    bits = F.when(explicit.isNotNull(), explicit).when(arch == "LP64", 64).when(arch == "ILP32", 32)
    sure = F.when(explicit.isNotNull(), 0.95).when(arch == "LP64", 0.70).when(arch == "ILP32", 0.65).otherwise(0.0)
    return F.struct(bits.alias("bits"), sure.alias("bits_conf"), F.when(unsigned, "unsigned").otherwise("signed").alias("sign"), F.when(unsigned, 0.85).otherwise(0.5).alias("sign_conf"))


def detect(info: DataFrame) -> DataFrame:
    """What the facts of each project say: architecture, bits and sign, with confidences. Adds a column for each."""
    found = info.withColumn("a", architecture(F.col("flags"), F.col("toolchain"), F.col("variables")))
    return found.withColumn("t", time_type(F.col("flags"), F.col("defines"), F.col("a.architecture"))).select(*info.columns, "a.*", "t.*")


def field_confidence(found: DataFrame) -> DataFrame:
    """How sure each field of a detection is; what is not looked at at all has a third."""
    return found.select(
        "project", F.col("arch_conf").alias("hardware_model"), F.col("bits_conf").alias("time_t_size_bits"), F.col("sign_conf").alias("time_t_signed"), *[F.lit(0.3).alias(c) for c in ("c_library", "time64_functions_available", "d_time_bits_supported")],
        F.col("bits_conf").alias("d_time_bits_setting"),
    )


CONFIDENCE_FIELDS = ("hardware_model", "time_t_size_bits", "time_t_signed", "c_library", "time64_functions_available", "d_time_bits_supported", "d_time_bits_setting")


def needs_model(threshold: float = 0.7, force: bool = False, keywords_only: bool = False) -> Column:
    """Whether a model should look at a project: unless told otherwise, where any field is less sure than the threshold."""
    if keywords_only or force:
        return F.lit(force and not keywords_only)
    return F.least(*CONFIDENCE_FIELDS) < threshold


def combine(keywords: DataFrame, model: DataFrame) -> DataFrame:
    """The model's fields, with those of the keywords where they are sure (0.9 or more). Projects without a model's answer keep the keywords' own."""
    m = model.select("project", *[F.col(c).alias(f"m_{c}") for c in ("hardware_model", "time_t_size_bits", "time_t_signed", "d_time_bits_supported", "d_time_bits_setting", "c_library")])
    joined = keywords.join(m, "project", "left")
    pick = lambda own, conf, theirs: F.when(F.col(own).isNotNull() & (F.col(conf) >= 0.9), F.col(own)).otherwise(F.coalesce(theirs, own))
    fields = joined.select(
        "project", pick("architecture", "arch_conf", "m_hardware_model").alias("hardware_model"), pick("bits", "bits_conf", "m_time_t_size_bits").alias("time_t_size_bits"), pick("sign", "sign_conf", "m_time_t_signed").alias("time_t_signed"),
        F.col("m_d_time_bits_supported").alias("d_time_bits_supported"), repaired_setting(F.col("m_d_time_bits_supported"), setting(F.col("m_d_time_bits_setting"))).alias("d_time_bits_setting"), F.coalesce("m_c_library", F.lit("unknown")).alias("c_library"), F.col("m_hardware_model").isNotNull().alias("by_model"),
    )
    return fields.withColumn("config_id", config_id(F.col("hardware_model"), F.col("time_t_signed"), F.col("time_t_size_bits")))


def repaired_setting(supported: Column, value: Column) -> Column:
    """A setting that does not contradict the support: not available where it is known to be missing, and not set where that was said without cause."""
    return F.when(~supported, "not_available").when(F.coalesce(supported, F.lit(True)) & (value == "not_available"), "not_set").otherwise(value)


def hybrid(spark: SparkSession, info: DataFrame, model: DataFrame | None = None, threshold: float = 0.7, force: bool = False) -> DataFrame:
    """Keyword detection, with a model's answers for the projects that need them: project, method and the final fields."""
    found = detect(info)
    asked = field_confidence(found).filter(needs_model(threshold, force, model is None)).select("project")
    if model is None:
        best = best_config(likelihoods(spark, found.withColumnRenamed("project", "key"))).withColumnRenamed("key", "project")
        return found.select("project").join(best, "project", "left").select("project", F.lit("keyword-based").alias("method"), "config_id", expand_config_id(F.col("config_id")).alias("environment"))
    mixed = combine(found, model.join(asked, "project", "left_semi"))
    return mixed.select("project", F.when(F.col("by_model"), "hybrid").otherwise("keyword-based").alias("method"), "config_id", expand_config_id(F.col("config_id")).alias("environment"))


def likelihoods(spark: SparkSession, evidence: DataFrame) -> DataFrame:
    """Eight rows for each evidence row (key, architecture, arch_conf, bits, bits_conf, sign, sign_conf), null where not known.

    A configuration that contradicts the evidence is ruled out; each vote for the data model adds three tenths of its confidence to an eighth, a size two tenths
    and a sign 0.15, up to 1. ``arch_votes``, where there, is the number of votes. The confidence is the mean of what is known, by weight.
    """
    rows = evidence.crossJoin(F.broadcast(configurations(spark)))  # eight rows
    c = F.col
    differs = lambda a, b: F.coalesce(c(a) != c(b), F.lit(False))
    said = lambda what, of, want: F.concat(F.lit(what), of.cast("string"), F.lit(", not "), want.cast("string"))
    reason = (
        F.when(differs("architecture", "hardware_model"), said("Architecture is ", c("architecture"), c("hardware_model")))
        .when(differs("bits", "time_t_size_bits"), F.concat(said("time_t is ", F.concat(c("bits").cast("string"), F.lit("-bit")), c("time_t_size_bits")), F.lit("-bit"))).when(differs("sign", "time_t_signed"), said("time_t is ", c("sign"), c("time_t_signed")))
    )
    part = lambda col, value: F.when(c(col).isNotNull(), value).otherwise(0.0)
    votes = c("arch_votes") if "arch_votes" in evidence.columns else F.lit(1)
    score = F.least(F.lit(1.0), F.lit(0.125) + part("architecture", F.lit(0.3) * c("arch_conf") * votes) + part("bits", F.lit(0.2) * c("bits_conf")) + part("sign", F.lit(0.15) * c("sign_conf")))
    weight = part("architecture", F.lit(0.4)) + part("bits", F.lit(0.4)) + part("sign", F.lit(0.2))
    mean = (part("architecture", F.lit(0.4) * c("arch_conf")) + part("bits", F.lit(0.4) * c("bits_conf")) + part("sign", F.lit(0.2) * c("sign_conf"))) / weight
    ruled = reason.isNotNull()
    own = F.when(differs("architecture", "hardware_model"), c("arch_conf")).when(differs("bits", "time_t_size_bits"), c("bits_conf")).when(ruled, c("sign_conf")).when(weight > 0, F.round(mean, 6)).otherwise(0.3)
    return rows.select("key", "config_id", F.when(ruled, 0.0).otherwise(F.round(score, 6)).alias("likelihood"), own.alias("confidence"), ruled.alias("ruled_out"), reason.alias("ruled_out_reason"))


def ranked_configs(scored: DataFrame) -> DataFrame:
    """The eight configurations of a project as they are shown: an eighth each where nothing is known or all that fit are alike and weak, an eighth for zeros,
    a label, and the first marked as recommended above 0.7."""
    w = Window.partitionBy("key")
    positive = F.when(F.col("likelihood") > 0, F.round("likelihood", 2))
    unsure = (F.max(positive).over(w) == F.min(positive).over(w)) & (F.max("likelihood").over(w) < 0.3)
    value = F.when(F.coalesce(unsure, F.lit(True)) | (F.col("likelihood") == 0), 0.125).otherwise(F.col("likelihood"))
    rows = scored.withColumn("likelihood", value)
    order = w.orderBy(F.desc("likelihood"), "config_id")
    label = F.when(F.col("likelihood") > 0.7, "high").when(F.col("likelihood") > 0.3, "medium").otherwise("low")
    numbered = rows.withColumn("rank", F.row_number().over(order))
    return numbered.select("key", "rank", "config_id", "likelihood", label.alias("label"), ((F.col("rank") == 1) & (F.col("likelihood") > 0.7)).alias("recommended"))


def likelihood_json(scored: DataFrame) -> DataFrame:
    """One JSON text per project: all configurations, the likeliest, those above one half and those ruled out."""
    row = F.struct("config_id", "likelihood", "confidence", "ruled_out", "ruled_out_reason")
    lists = scored.groupBy("key").agg(F.array_sort(F.collect_list(row)).alias("configurations"))
    best = best_config(scored).select("key", F.col("config_id").alias("most_likely"))
    names = lambda test: F.transform(F.filter("configurations", test), lambda x: x["config_id"])
    summary = F.struct("most_likely", names(lambda x: ~x["ruled_out"] & (x["likelihood"] > 0.5)).alias("recommended_configs"), names(lambda x: x["ruled_out"]).alias("ruled_out_configs"))
    return lists.join(best, "key", "left").select("key", F.to_json(F.struct(F.col("key").alias("project_path"), "configurations", summary.alias("summary"))).alias("document"))


def likelihood_text(scored: DataFrame) -> DataFrame:
    """One table in plain text per project."""
    percent = F.concat((F.col("likelihood") * 100).cast("int").cast("string"), F.lit("%"))
    level = F.when(F.col("confidence") > 0.8, "High").when(F.col("confidence") > 0.5, "Medium").otherwise("Low")
    mark = F.when(F.col("ruled_out"), "x").when(F.col("likelihood") > 0.7, "+").when(F.col("likelihood") > 0.3, "~").otherwise("o")
    said = F.when(F.col("ruled_out"), F.concat(F.lit("(Ruled out: "), "ruled_out_reason", F.lit(")"))).otherwise(F.concat(F.lit("("), level, F.lit(" confidence)")))
    line = F.concat(F.lit("  "), mark, F.lit(" "), F.rpad("config_id", 25, " "), F.lit(" "), F.lpad(percent, 4, " "), F.lit(" "), said)
    lists = scored.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("config_id", line.alias("t")))).alias("l"))
    best = best_config(scored).select("key", F.col("config_id").alias("b"))
    body = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    return lists.join(best, "key", "left").select("key", F.concat(F.lit("Configuration Detection Results\n\nProject: "), F.col("key").cast("string"), F.lit("\nLikelihood Scores:\n"), body, F.coalesce(F.concat(F.lit("\n\nRecommendation: Use "), "b", F.lit(" configuration")), F.lit(""))).alias("text"))


def best_config(scored: DataFrame) -> DataFrame:
    """The likeliest configuration that is not ruled out; of equal ones the first by name."""
    ok = scored.filter("not ruled_out")
    return ok.groupBy("key").agg(F.min_by("config_id", F.struct((-F.col("likelihood")).alias("l"), "config_id")).alias("config_id"), F.max("likelihood").alias("likelihood"))


def effective_config(explicit, detected, confidence, fallback, least: float = 0.7):
    """Struct of the id used and why: explicit, detected with enough confidence, else the fallback."""
    return F.when(explicit.isNotNull(), F.struct(explicit.alias("config_id"), F.lit("explicit").alias("source"))).when(detected.isNotNull() & (confidence >= least), F.struct(detected.alias("config_id"), F.lit("detected").alias("source"))).otherwise(F.struct(fallback.alias("config_id"), F.lit("fallback").alias("source")))

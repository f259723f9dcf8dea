"""Work over many repositories: identities, roll-ups; and checks of rule catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ref_label, sanitize_token



def repo_identity(url: Column) -> Column:
    """Host, owner and name from an https or scp-style URL; owner and name are the last two parts of the path."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"/+$", ""), r"\.git$", "")
    pattern = r"^(?:[A-Za-z][\w+.-]*://(?:[^/@]+@)?|[^/@\s]+@)([^/:]+)(?::\d+)?[:/](?:.*/)?([^/]+)/([^/]+)$"
    return F.struct(F.lower(F.regexp_extract(plain, pattern, 1)).alias("host"), F.regexp_extract(plain, pattern, 2).alias("owner"), F.regexp_extract(plain, pattern, 3).alias("repo"))


def host_label(host: Column) -> Column:
    """A known host's name, else the host as a token."""
    return F.when(F.contains(F.lower(host), F.lit("github")), "github").otherwise(sanitize_token(F.coalesce(F.nullif(F.lower(F.trim(host)), F.lit("")), F.lit("source"))))


def repo_key(url: Column, ref: Column) -> Column:
    who = repo_identity(url)
    return F.concat_ws("__", host_label(who["host"]), sanitize_token(who["owner"]), sanitize_token(who["repo"]), ref_label(F.coalesce(F.nullif(F.trim(ref), F.lit("")), F.lit("default"))))


def matches_terms(terms: list[str], *columns: str) -> Column:
    """Whether any term stands in the columns, in any case; without terms all do."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(hay, F.lower(t))) if terms else F.lit(True)


def repo_rollup(candidates: DataFrame, repo: Column) -> DataFrame:
    """Counts by repository and risk, by repository, and overall."""
    return candidates.withColumn("repo", repo).rollup("repo", "risk").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_files"), F.grouping_id().alias("level"))


def duplicate_rules(rules: DataFrame, retired: DataFrame, prefix: str = "RULE") -> DataFrame:
    """Problems of a catalog: ids or symbols used twice, malformed, missing and retired ids."""
    two = lambda c, p: rules.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(p).alias("problem"), "value", "n")
    one = lambda df, p: df.groupBy(F.coalesce("rule_id", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("problem"), "value", "n")
    bad = rules.filter(F.col("rule_id").isNotNull() & ~F.regexp_like("rule_id", F.lit(rf"^{prefix}-\d{{4}}$")))
    gone = rules.join(retired.select("rule_id"), "rule_id", "left_semi")
    return two("rule_id", "duplicate id").unionByName(two("symbol", "duplicate symbol")).unionByName(one(bad, "malformed id")).unionByName(one(rules.filter("rule_id is null"), "missing id")).unionByName(one(gone, "retired id"))


def assign_rule_ids(rules: DataFrame, retired: DataFrame, order: str = "pos", prefix: str = "RULE") -> DataFrame:
    """Free numbers, the smallest first, for rules without an id, in order; used and retired numbers are skipped.

    A number has four digits, so there are at most 9,999 of them and as many rules that can get one: that bound lets one task number them.
    """
    number = F.regexp_extract("rule_id", r"(\d{4})$", 1).try_cast("int")
    used = rules.select(number.alias("n")).unionByName(retired.select(number.alias("n"))).filter("n is not null").distinct()
    need = rules.filter("rule_id is null").orderBy(order).limit(9_999).withColumn("k", F.row_number().over(Window.orderBy(order)))
    free = rules.sparkSession.range(1, 10_000).select(F.col("id").cast("int").alias("n")).join(used, "n", "left_anti").withColumn("k", F.row_number().over(Window.orderBy("n")))
    given = need.join(free, "k").withColumn("rule_id", F.format_string(f"{prefix}-%04d", "n")).drop("k", "n")
    left = rules.filter("rule_id is null").join(given.select(order), order, "left_anti")
    return rules.filter("rule_id is not null").unionByName(given).unionByName(left)


def next_free(rules: DataFrame, retired: DataFrame) -> DataFrame:
    """The smallest number that is neither used nor retired."""
    number = F.regexp_extract("rule_id", r"(\d{4})$", 1).try_cast("int")
    used = rules.select(number.alias("n")).unionByName(retired.select(number.alias("n"))).filter("n is not null").distinct()
    return rules.sparkSession.range(1, 10_000).select(F.col("id").cast("int").alias("n")).join(used, "n", "left_anti").agg(F.min("n").alias("n"))


def check_catalog(rules: DataFrame, retired: DataFrame, strict: bool = True, prefix: str = "RULE") -> None:
    """Raise on the first problem of a catalog; without ``strict`` symbols may occur more than once and ids may be missing."""
    problems = duplicate_rules(rules, retired, prefix)
    if not strict:
        problems = problems.filter("problem not in ('duplicate symbol', 'missing id')")
    first = problems.orderBy("problem", "value").head(1)
    if first:
        raise ValueError(f"{first[0]['problem']}: {first[0]['value']}")

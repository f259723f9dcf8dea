"""Catalog matching: tokens of lines joined with rules, guards, grouping by line, tallies."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.config import risk_rank
from ..functions.text import bigrams, blank_to_null, is_called, words
from ..sources.files import normalize_rules

# A small catalog of our own, as no catalog ships with the reference data: symbol, risk, category, description.
CATALOG = (
    ("time", "high", "function", "reads the clock"),
    ("gettimeofday", "high", "function", "reads the clock"),
    ("localtime", "medium", "function", "converts a time"),
    ("mktime", "medium", "function", "converts a time"),
    ("time_t", "high", "simple type", "the time type"),
    ("struct timeval", "medium", "structure", "holds a time"),
    ("fwrite", "low", "function", "writes raw bytes"),
    ("#define", "low", "macro", "switches the define scan on"),
)


#: Rules, without the files that they are scoped to, that are sent to all tasks.
BROADCAST_RULES = 50_000
#: Rules without a scope, up to which a catalog is one expression over a line, and no row is made for what no rule asks for.
FEW_RULES = 64
#: What a symbol must look like to be a token or a bigram.
_SYMBOL = re.compile(r"[_A-Za-z][_A-Za-z0-9]*(?: [_A-Za-z][_A-Za-z0-9]*)?")


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [(s, r, c, d, f"RULE-{i:04d}") for i, (s, r, c, d) in enumerate(CATALOG, 1)]
    rules = spark.createDataFrame(rows, "symbol string, risk string, category string, description string, rule_id string")
    return normalize_rules(rules.selectExpr("*", "cast(null as boolean) needs_paren", "cast(null as array<string>) scope_files", "false type_use_only", "false discovered", "cast(null as string) name"))


def line_terms(lines: DataFrame) -> DataFrame:
    """Distinct tokens and bigrams of each cleaned line: path, line, text, clean, term."""
    tokens = words(F.col("clean"))
    return lines.withColumn("__w", tokens).withColumn("term", F.explode(F.array_distinct(F.concat(F.col("__w"), bigrams(F.col("__w")))))).drop("__w")


def with_min_risk(rules: DataFrame, floor: str) -> DataFrame:
    return rules.filter(risk_rank(F.col("risk")) >= risk_rank(F.lit(floor)))


def few_rules(rules: DataFrame, min_risk: str = "low") -> list[Row] | None:
    """The rules of a small catalog without scopes that can match at all; none if it is larger or has scopes."""
    found = with_min_risk(rules, min_risk).select("symbol", "risk", "category", "description", "rule_id", "call_required", "type_use_only", "scope_files").limit(FEW_RULES + 1).collect()
    if len(found) > FEW_RULES or any(r["scope_files"] is not None for r in found):
        return None
    return [r for r in found if _SYMBOL.fullmatch(r["symbol"])]


def with_terms(lines: DataFrame, rules: list[Row]) -> DataFrame:
    """Adds ``__terms``: the tokens of a line that holds all words of a rule, with a blank before and after each; null for other lines."""
    words_of = sorted({tuple(r["symbol"].split(" ")) for r in rules})
    may = reduce(Column.__or__, [reduce(Column.__and__, [F.contains("clean", F.lit(w)) for w in ws]) for ws in words_of], F.lit(False))
    return lines.withColumn("__terms", F.when(may, F.concat(F.lit(" "), F.array_join(words(F.col("clean")), " "), F.lit(" "))))


def rule_hits(rules: list[Row], made) -> Column:
    """Array with ``made(rule)`` for each rule that matches and null for others, over lines of ``with_terms``; null where no rule can match."""

    def hit(r: Row) -> Column:
        # Neighbours in the text of tokens are neighbours in the list of tokens.
        test = F.contains("__terms", F.lit(f" {r['symbol']} "))
        if r["call_required"] is not False:
            test &= is_called(F.col("clean"), F.lit(r["symbol"]))
        if r["type_use_only"]:
            test &= ~is_called(F.col("clean"), F.lit(r["symbol"]))
        return F.when(test, made(r))

    return F.when(F.col("__terms").isNotNull(), F.array(*map(hit, rules)))


def _match_few(lines: DataFrame, rules: list[Row]) -> DataFrame:
    names = ["symbol", "risk", "category", "description", "rule_id"]
    made = lambda r: F.struct(*[F.lit(r[n]).cast("string").alias(n) for n in names])
    none = F.array().cast(f"array<struct<{','.join(f'{n}:string' for n in names)}>>")
    hits = F.coalesce(rule_hits(rules, made), none) if rules else none
    hit = with_terms(lines, rules).select("path", "line", "text", F.inline(hits)).filter("symbol is not null")
    return hit.select("path", "line", "text", *names, F.lit("catalog_symbol_match").alias("discovery_method"))


def match_rules(lines: DataFrame, rules: DataFrame, min_risk: str = "low") -> DataFrame:
    """One row per line and rule whose symbol stands in the cleaned line.

    A rule that needs a call matches only before a parenthesis; a type-only rule only elsewhere; a scoped rule only in its files.
    """
    few = few_rules(rules, min_risk)
    if few is not None:
        return _match_few(lines, few)
    names = ["symbol", "risk", "category", "description", "rule_id", "call_required", "type_use_only", "discovered"]
    kept = with_min_risk(rules, min_risk).select(*names, "scope_files", F.xxhash64(*names, "scope_files").alias("__rule"))
    bare = lambda f: ~F.contains(f, F.lit("/"))
    n, scoped, by_base = kept.agg(F.count(F.lit(1)), F.coalesce(F.bool_or(F.col("scope_files").isNotNull()), F.lit(False)), F.coalesce(F.bool_or(F.exists("scope_files", bare)), F.lit(False))).first()
    small = kept.select(*names, "__rule", F.col("scope_files").isNull().alias("__free"))
    # The estimate for a local table is boundless, so Spark would deal all terms of all lines by term.
    hit = line_terms(lines).join(F.broadcast(small) if n <= BROADCAST_RULES else small, F.col("term") == F.col("symbol"))
    called = is_called(F.col("clean"), F.col("symbol"))
    hit = hit.filter((~F.col("call_required") | called) & ~(F.coalesce("type_use_only", F.lit(False)) & called))
    if scoped:
        # Per file the rules that are scoped to it: a rule's own list is as long as the files that see it.
        scopes = kept.select(F.explode("scope_files").alias("__file"), "__rule").groupBy("__file").agg(F.collect_set("__rule").alias("__in"))
        hit = hit.join(scopes.withColumnRenamed("__file", "path"), "path", "left")
        inside = F.col("__free") | F.coalesce(F.array_contains("__in", F.col("__rule")), F.lit(False))
        if by_base:
            hit = hit.withColumn("__base", F.element_at(F.split("path", "/"), -1)).join(scopes.filter(bare(F.col("__file"))).select(F.col("__file").alias("__base"), F.col("__in").alias("__in_base")), "__base", "left")
            inside = inside | F.coalesce(F.array_contains("__in_base", F.col("__rule")), F.lit(False))
        hit = hit.filter(inside)
    return hit.select("path", "line", "text", "symbol", "risk", "category", "description", "rule_id", F.lit("catalog_symbol_match").alias("discovery_method"))


def group_by_line(matches: DataFrame) -> DataFrame:
    """One row per line: its distinct matches in order, their number, the highest risk and the line's text."""
    match = F.struct("symbol", "risk", "description", "discovery_method", "rule_id")
    return matches.groupBy("path", "line").agg(
        F.array_sort(F.collect_set(match)).alias("matches"),
        F.max_by("risk", F.struct(risk_rank(F.col("risk")), "symbol")).alias("line_max_risk"),
        F.min(blank_to_null(F.col("text"))).alias("line_text"),
    ).withColumn("match_count", F.size("matches"))


def tallies(matches: DataFrame) -> DataFrame:
    """Counts by symbol, by risk and overall in one pass."""
    return matches.groupingSets([["symbol"], ["risk"], []], "symbol", "risk").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_files"))


def code_metrics(lines: DataFrame) -> DataFrame:
    """Files, lines, characters, words, and largest and mean sizes."""
    n_words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    per_file = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(n_words).alias("words"), F.max(F.length("text")).alias("longest"))
    return per_file.agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.max("longest").alias("longest_line"), F.max("n").alias("longest_file"),
        F.round(F.sum("chars") / F.sum("n"), 4).alias("mean_line"), F.round(F.sum("n") / F.count(F.lit(1)), 4).alias("mean_file"),
    )


def structural_skip(text: Column) -> Column:
    """Lines that the structural filter drops: comments, warnings, errors, pragmas, macros without parameters, type definitions."""
    t = F.trim(text)
    return t.rlike(r"^(?://|/\*|#warning|#error|#pragma|typedef)") | (t.startswith("#define") & ~F.contains(t, F.lit("(")))


def symbol_role(text: Column) -> Column:
    """What a line is, by its first characters; the first test that holds decides."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^(?://|/\*)"), "comment").when(t.rlike(r"^#(?:warning|error|pragma)"), "preprocessor_directive").when(t.rlike(r"^#(?:define|if)"), "macro").when(t.rlike(r"^(?:typedef|struct)"), "type")
        .when(F.contains(t, F.lit("(")) & F.contains(t, F.lit(")")), "call").when(F.contains(t, F.lit("=")) & ~t.rlike(r"^(?:if|while)"), "assignment").otherwise("unknown")
    )


def structural_filter(candidates: DataFrame, enabled: bool = False) -> DataFrame:
    """Candidates with the role of their line, without those that the filter drops; all of them, without a role, where it is off."""
    if not enabled:
        return candidates.withColumn("symbol_role", F.lit(None).cast("string"))
    return candidates.withColumn("symbol_role", symbol_role(F.col("snippet"))).filter(~structural_skip(F.col("snippet")))

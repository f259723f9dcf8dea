"""Records of lines and their matches as other tools write them: in the present form, with an array of matches, and in the older one with parallel lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import risk_rank
from ..functions.text import blank_to_null, normalize_newlines
from .wire import column_problem

MATCH = "symbol:string,risk:string,description:string,discovery_method:string,rule_id:string,line:int,col_start:int,col_end:int"
SCHEMA = (
    "file string, line int, lineText string, one_line_snippet string, symbol string, symbols array<string>, discovery_method string, discovery_methods array<string>, rule_id string, rule_ids array<string>, "
    f"risk string, description string, col_start int, col_end int, matches array<struct<{MATCH}>>, match_count int, line_max_risk string"
)


def read_records(spark, path: str) -> DataFrame:
    """Records from JSON lines or arrays."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def as_match(hit: Column) -> Column:
    """One match, with blanks as nulls and plain line ends."""
    f = lambda n: hit[n]
    return F.struct(
        F.coalesce(f("symbol"), F.lit("")).alias("symbol"), F.coalesce(f("risk"), F.lit("")).alias("risk"), F.coalesce(normalize_newlines(f("description")), F.lit("")).alias("description"), blank_to_null(f("discovery_method")).alias("discovery_method"),
        blank_to_null(f("rule_id")).alias("rule_id"), F.coalesce(f("line"), F.lit(0)).alias("line"), f("col_start").alias("col_start"), f("col_end").alias("col_end"),
    )


def sort_key(match: Column) -> Column:
    """The order of matches inside a line; missing columns come first."""
    m = lambda n, default: F.coalesce(match[n], F.lit(default)).alias(n)
    return F.struct(m("symbol", ""), m("discovery_method", ""), m("rule_id", ""), m("risk", ""), m("description", ""), m("col_start", -1), m("col_end", -1), match.alias("m"))


def in_order(matches: Column) -> Column:
    return F.transform(F.array_sort(F.transform(matches, sort_key)), lambda x: x["m"])


def max_risk(matches: Column) -> Column:
    """The highest risk among matches; empty without any."""
    best = F.array_max(F.transform(matches, lambda m: F.struct(risk_rank(m["risk"]).alias("r"), m["risk"].alias("risk"))))
    return F.coalesce(F.when(best["r"] >= 0, best["risk"]), F.lit(""))


def _listed(one: str, many: str) -> Column:
    return F.when(F.col("symbols").isNotNull(), F.coalesce(many, F.array().cast("array<string>"))).otherwise(F.array(one))


def _unequal(symbols: Column) -> Column:
    wrong = lambda a: ~F.size(a).isin(0) & (F.size(a) != F.size(symbols))
    return F.when(wrong(F.col("__methods")), "unequal methods").when(wrong(F.col("__rules")), "unequal rule ids")


def judge_records(records: DataFrame) -> DataFrame:
    """Adds ``all_matches`` in order and ``problem``, null for a record that can be used.

    A record with matches must agree with whatever else it says: its line, count, highest risk and any of the older fields. An older record is used only
    where it has one symbol and a risk.
    """
    c = F.col
    older = c("symbols").isNotNull() | c("symbol").isNotNull()
    symbols = F.when(c("symbols").isNotNull(), c("symbols")).when(c("symbol").isNotNull(), F.array("symbol")).otherwise(F.array().cast("array<string>"))
    rows = records.withColumns({"__symbols": symbols, "__methods": _listed("discovery_method", "discovery_methods"), "__rules": _listed("rule_id", "rule_ids")})
    placed = F.transform("matches", lambda m: as_match(m.withField("line", F.coalesce(m["line"], c("line")))))
    single = as_match(F.struct(F.get("__symbols", F.lit(0)).alias("symbol"), "risk", "description", F.coalesce(F.get("__methods", F.lit(0)), c("discovery_method")).alias("discovery_method"), F.coalesce(F.get("__rules", F.lit(0)), c("rule_id")).alias("rule_id"), "line", "col_start", "col_end"))
    rows = rows.withColumn("all_matches", F.when(c("matches").isNotNull(), in_order(placed)).otherwise(F.array(single)))
    m = c("all_matches")
    of = lambda f: F.transform(m, lambda x: x[f])
    blank = lambda a: F.transform(a, blank_to_null)
    columns = F.get(F.array_compact(F.transform(m, lambda x: column_problem(x["col_start"], x["col_end"]))), F.lit(0))
    differs = lambda a, b: ~a.eqNullSafe(b)
    present = (
        F.when(F.size("matches") == 0, "no matches").when(F.exists(m, lambda x: x["line"] != c("line")), "line").when(columns.isNotNull(), columns)
        .when(c("match_count") != F.size(m), "count").when(c("line_max_risk") != max_risk(m), "risk")
        .when(older & (F.size("__symbols") > 0) & _unequal(c("__symbols")).isNotNull(), _unequal(c("__symbols")))
        .when(older & (F.size("__symbols") > 0) & differs(c("__symbols"), of("symbol")), "symbols").when(c("symbols").isNotNull() & (F.size("__methods") > 0) & differs(blank(c("__methods")), of("discovery_method")), "methods")
        .when(c("symbols").isNotNull() & (F.size("__rules") > 0) & differs(blank(c("__rules")), of("rule_id")), "rule ids")
        .when(c("risk").isNotNull() & ((F.size(m) > 1) | (c("risk") != F.get(m, F.lit(0))["risk"])), "scalar risk")
        .when((c("description") != "") & ((F.size(m) > 1) | (normalize_newlines(c("description")) != F.get(m, F.lit(0))["description"])), "scalar description")
    )
    alone = (
        F.when(~older, "no matches").when(_unequal(c("__symbols")).isNotNull(), _unequal(c("__symbols"))).when(F.size("__symbols") == 0, "no symbols").when(F.size("__symbols") > 1, "ambiguous")
        .when(blank_to_null(c("risk")).isNull(), "no risk").when(columns.isNotNull(), columns)
    )
    return rows.withColumn("problem", F.when(c("matches").isNotNull(), present).otherwise(alone)).drop("__symbols", "__methods", "__rules")


def match_rows(judged: DataFrame) -> DataFrame:
    """A row for each match of the records without a problem, in the columns of detector rows."""
    text = F.coalesce(blank_to_null(F.col("lineText")), F.col("one_line_snippet"), F.lit(""))
    return judged.filter("problem is null").select(F.col("file").alias("path"), text.alias("text"), F.inline("all_matches"))


def write_form(matches: DataFrame) -> DataFrame:
    """Line records in the present form from single hits (path, line, text, symbol, risk, description, discovery_method, rule_id, col_start, col_end)."""
    hit = as_match(F.struct("symbol", "risk", "description", "discovery_method", "rule_id", "line", "col_start", "col_end"))
    rows = matches.groupBy("path", "line").agg(F.collect_set(hit).alias("m"), F.min(blank_to_null(F.col("text"))).alias("lineText"))
    return rows.select(F.col("path").alias("file"), "line", F.coalesce("lineText", F.lit("")).alias("lineText"), in_order(F.col("m")).alias("matches"), F.size("m").alias("match_count"), max_risk(F.col("m")).alias("line_max_risk"))

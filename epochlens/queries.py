"""Queries of the engine's own operators over the driver's tables, each with DuckDB SQL where SQL can express it.

Source lines are made from ``lineitem`` by one projection that runs in both engines; see ``sources.lines``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import config as K
from .functions import paths as H
from .functions import text as X
from .functions.tables import register_table_functions
from .operators import artifacts as Z
from .operators import assessments as A
from .operators import batches as T
from .operators import boundaries as B
from .operators import candidates as C
from .operators import closure as G
from .operators import cparse as P
from .operators import detected as DE
from .operators import detectors as D
from .operators import environments as E
from .operators import findings as N
from .operators import matching as M
from .operators import models as O
from .operators import prompts as Q
from .operators import provenance as V
from .operators import records as I
from .operators import reports as R
from .operators import repositories as S
from .operators import statements as Y
from .operators import wire as W
from .plans.passes import Asking, run_passes
from .plans.publication import publish, published
from .plans.scan import Options, document_parts, found_rows, result_document, scan, scan_files
from .session import ensure_checkpoints, scratch_folder
from .sources.documents import piece
from .sources.documents import write_documents as write_long_documents
from .sources.files import list_tree
from .sources.lines import SYNTHETIC_SQL, split_lines, synthetic_lines, with_clean_ranges, with_clean_text
from .sources.trees import read_ranges, write_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Pieces of the DuckDB side.
_LINES = f"lines AS ({SYNTHETIC_SQL})"
_CLEAN = _LINES + r""", cl AS (SELECT *, regexp_replace(text, '"(?:\\.|[^"\\])*"?|''(?:\\.|[^''\\])*''?|//.*$', ' ', 'g') AS clean FROM lines)"""
_RULES = "rules(symbol, risk, category, description, rule_id, call_required) AS (VALUES " + ", ".join(
    f"('{s}', '{r}', '{c}', '{d}', 'RULE-{i:04d}', {c not in K.NON_CALLABLE})" for i, (s, r, c, d) in enumerate(M.CATALOG, 1)
) + ")"
_TERMS = _CLEAN + r""", tok AS (SELECT *, regexp_extract_all(clean, '\b([_A-Za-z]\w*)\b', 1) AS w FROM cl),
terms AS (SELECT DISTINCT path, line, text, clean, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tok)"""
_MATCH = f"""{_TERMS}, {_RULES}, m AS (SELECT path, line, text, symbol, risk, category, description, rule_id FROM terms JOIN rules ON term = symbol
WHERE NOT call_required OR regexp_matches(clean, '\\b' || symbol || '\\b\\s*\\('))"""
_RANK = "CASE risk WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END"
_SIMPLE = r"""regexp_replace(regexp_replace(regexp_replace(text, '//.*$', ''), '"[^"]*"', '""', 'g'), '''[^'']*''', '''''', 'g')"""
def _any(words) -> str:
    return "|".join(map(str, words))


_VARS = _LINES + rf""", vars AS (SELECT DISTINCT path, v AS var FROM (SELECT path, unnest(regexp_extract_all(text, '{D.DECLARED}', 1)) AS t, unnest(regexp_extract_all(text, '{D.DECLARED}', 2)) AS v FROM lines) WHERE lower(t) IN {D.TIME_TYPES})"""
_OPS = ", ".join(f"unnest(regexp_extract_all(code, '{D.OPERATION}', {i})) AS {n}" for i, n in enumerate(("var", "operator", "comp", "raw"), 1))
_NUMBER = r"regexp_extract(operand, '-?\d+')"
_ARITH = _VARS + rf""", ops AS (SELECT path, line, text, code, {_OPS} FROM (SELECT *, {_SIMPLE} AS code FROM lines)), tr AS (SELECT *, trim(raw) AS operand FROM ops),
own AS (SELECT o.* FROM tr o LEFT JOIN vars v ON o.path = v.path AND o.var = v.var WHERE v.var IS NOT NULL OR regexp_matches(code, '(?i)\b(?:{_any(D.TIME_TYPES)})\s+' || o.var || '\b')),
rk AS (SELECT *, abs(try_cast({_NUMBER} AS HUGEINT)) AS n FROM own),
ar AS (SELECT path, line, text, var, operator, comp = '=' AS is_compound, operand,
 CASE WHEN regexp_matches(operand, '{D.LARGE_NUMBERS}') THEN CASE WHEN operator IN ('+', '*') THEN 'high 0.9' ELSE 'medium 0.7' END WHEN regexp_matches(operand, '-\s*\d+') AND operator IN ('+', '-') THEN 'medium 0.7'
 WHEN {_NUMBER} <> '' AND n >= 1073741824 THEN CASE WHEN operator IN ('+', '*') THEN 'high 0.9' ELSE 'medium 0.7' END WHEN {_NUMBER} <> '' AND n >= 1048576 THEN 'medium 0.7'
 WHEN operator IN ('+', '-') AND regexp_matches(operand, '^-?\d+$') THEN 'low 0.5' ELSE 'medium 0.6' END AS r FROM rk),
arith AS (SELECT * EXCLUDE r, split_part(r, ' ', 1) AS risk, split_part(r, ' ', 2)::DOUBLE AS confidence FROM ar WHERE r <> 'low 0.5')"""
_DEFINES = _LINES + rf""", df AS (SELECT path, line, text, regexp_extract(text, '{D.DEFINE}', 1) AS macro, trim(regexp_extract(text, '{D.DEFINE}', 2)) AS value FROM lines),
dk AS (SELECT *, CASE WHEN regexp_matches(lower(value), '{D.whole_words(D.DEFINE_TYPES)}') THEN 'time_type_alias' WHEN regexp_matches(lower(value), '{D.DEFINE_CALLS}') THEN 'time_function_alias' WHEN regexp_matches(lower(value), '\bstruct\s+{D.whole_words(D.DEFINE_STRUCTS)}') THEN 'time_struct_alias'
 WHEN regexp_matches(lower(value), '{D.whole_words(D.TIME_CONSTANTS)}') AND regexp_matches(replace(lower(macro), '_', ' '), '{D.whole_words(D.CONSTANT_NAMES)}') THEN 'time_constant' END AS kind FROM df WHERE macro <> '' AND value <> ''),
defs AS (SELECT path, line, text, macro, value, kind, CASE kind WHEN 'time_constant' THEN 0.8 WHEN 'time_function_alias' THEN 0.9 ELSE 0.95 END::DOUBLE AS confidence, kind <> 'time_constant' AS needs_followup FROM dk
 WHERE kind IS NOT NULL AND NOT regexp_matches(lower(macro), '{D.whole_words(D.HARDWARE_WORDS)}') AND NOT regexp_matches(lower(value), '{D.whole_words(D.HARDWARE_WORDS)}') AND NOT regexp_matches(value, '0x[0-9a-fA-F]+') AND NOT regexp_matches(lower(text), '{D.whole_words(D.HARDWARE_LINE_WORDS)}'))"""
# The one cast that begins a line's first match is enough here: no line made from an order line has two.
_CALL_CAST, _NAME_CAST = D.CAST_OF_CALL, r"\(\s*((?:unsigned\s+|signed\s+)?\w+(?:\s+\w+)?)\s*\)\s*(\w+)"
_HOLDS = f"regexp_matches(lower({{}}), '{_any(D.TIME_NAMES)}')"
_CASTS_OF_CLEAN = rf"""cc AS (SELECT *, regexp_extract(clean, '{_CALL_CAST}', 1) AS t1, regexp_extract(clean, '{_CALL_CAST}', 2) AS s1, regexp_extract(clean, '{_NAME_CAST}', 1) AS t2, regexp_extract(clean, '{_NAME_CAST}', 2) AS s2,
 regexp_extract(clean, '{D.ASSIGNMENT}', 1) AS t3, regexp_extract(clean, '{D.ASSIGNMENT}', 3) AS s3 FROM cl),
casts AS (SELECT path, line, text, k[1] AS symbol, k[2] AS risk, k[3] AS kind, k[4] AS to_type, k[5] AS source, k[6] AS said FROM (SELECT *, CASE WHEN t1 NOT IN ('', 'time_t', 'void') THEN ['cast_from_' || s1, 'high', 'cast_call', t1, s1, 'Cast from time_t function ' || s1 || '() to ' || t1]
 WHEN t2 NOT IN ('', 'time_t', 'void') AND {_HOLDS.format('s2')} THEN ['cast_from_time_var', 'high', 'cast_var', t2, s2, 'Cast from time_t variable ' || s2 || ' to ' || t2]
 WHEN t3 NOT IN ('', 'time_t') AND {_HOLDS.format('s3')} THEN ['implicit_cast_from_time', 'medium', 'implicit', t3, s3, 'Possible implicit cast from time_t variable ' || s3 || ' to ' || t3] END AS k FROM cc) WHERE k IS NOT NULL)"""


def _tail(cte: str) -> str:
    """A CTE chain without its first table, to be put after another chain that has it."""
    return cte[len(_LINES):]


_UNITED = f"""{_MATCH}{_tail(_DEFINES)}{_tail(_ARITH)}, {_CASTS_OF_CLEAN},
united AS (SELECT path, line, symbol, risk, text, description, 'catalog_symbol_match' AS discovery_method, rule_id FROM m
 UNION ALL SELECT path, line, macro, CASE WHEN kind IN ('time_type_alias', 'time_struct_alias') THEN 'high' ELSE 'medium' END, text, kind || ': ' || macro || ' -> ' || value, 'define_scanner', NULL FROM defs
 UNION ALL SELECT path, line, 'arithmetic_' || operator || CASE WHEN is_compound THEN '=' ELSE '' END, risk, text, 'Arithmetic operation on time_t: ' || var || ' ' || operator || CASE WHEN is_compound THEN '=' ELSE '' END || ' ' || operand, 'arithmetic_scanner', NULL FROM arith
 UNION ALL SELECT path, line, symbol, risk, text, said, 'time_t_cast', NULL FROM casts),
cand AS (SELECT path, line, symbol, risk, min(left(trim(text), 240)) AS snippet, min(description) AS description, min(discovery_method) AS discovery_method, min(rule_id) AS rule_id, count(*) AS n_rows,
 greatest(count(DISTINCT description), count(DISTINCT discovery_method), count(DISTINCT rule_id)) > 1 AS conflict, concat_ws(':', path, line::VARCHAR, '0', '0', risk, symbol) AS candidate_id FROM united GROUP BY path, line, symbol, risk)"""
_SPANS = """sp AS (SELECT path, 'fn' || CAST(floor((line - 1) / 20) AS BIGINT)::VARCHAR AS name, min(line) AS start_line, max(line) AS end_line FROM lines GROUP BY path, floor((line - 1) / 20)),
fns AS (SELECT * FROM sp WHERE right(name, 1) NOT IN ('3', '7'))"""
_EVIDENCE = f"""{_UNITED}, {_SPANS}, ev AS (SELECT c.*, f.path || '@' || f.name || ':' || f.start_line || '-' || f.end_line AS function_id FROM cand c LEFT JOIN fns f ON c.path = f.path AND c.line BETWEEN f.start_line AND f.end_line)"""


def query(sql: str | None = None):
    """Register the query under its function's name."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return with_clean_text(synthetic_lines(spark, sf))


def _matches(spark: SparkSession, sf: str, floor: str = "low") -> DataFrame:
    return M.match_rules(_clean(spark, sf), M.default_rules(spark), floor)


def _scan(spark: SparkSession, sf: str):
    return scan(synthetic_lines(spark, sf), M.default_rules(spark))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-ins for function spans: runs of twenty lines, some left out."""
    block = F.floor((F.col("line") - 1) / 20)
    every = synthetic_lines(spark, sf).groupBy("path", block.alias("b")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).withColumn("name", F.concat(F.lit("fn"), F.col("b").cast("string")))
    return every.filter(~F.right("name", F.lit(1)).isin("3", "7")).drop("b")


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return C.join_functions(_scan(spark, sf).candidates, _spans(spark, sf))


@query(f"WITH {_UNITED} SELECT candidate_id, snippet, description, discovery_method, rule_id, n_rows FROM cand")
def scan_candidates(spark, sf):
    return _scan(spark, sf).candidates.select("candidate_id", "snippet", "description", "discovery_method", "rule_id", "n_rows")


@query(f"WITH {_CLEAN} SELECT path, line, text, clean FROM cl")
def scan_lines(spark, sf):
    return _clean(spark, sf).select("path", "line", "text", "clean")


@query(r"""WITH parts AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS p FROM documents),
l AS (SELECT doc_id, generate_subscripts(p, 1) AS line, unnest(p) AS text, len(p) AS n FROM parts) SELECT 'doc' || doc_id AS path, line::INT AS line, md5(text) AS digest FROM l WHERE line < n OR text <> ''""")
def document_lines(spark, sf):
    files = _t(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return split_lines(files).select("path", "line", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {_LINES}, f AS (SELECT path, count(*) AS n, sum(length(text)) AS chars, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS words, max(length(text)) AS longest FROM lines GROUP BY path) "
       "SELECT count(*) AS files, sum(n)::BIGINT AS lines, sum(chars)::BIGINT AS chars, sum(words)::BIGINT AS words, max(longest)::INT AS longest_line, max(n) AS longest_file, round(sum(chars) / sum(n), 4) AS mean_line, round(sum(n) / count(*), 4) AS mean_file FROM f")
def code_metrics(spark, sf):
    return M.code_metrics(synthetic_lines(spark, sf))


@query(f"WITH {_TERMS} SELECT path, line, term FROM terms")
def token_terms(spark, sf):
    return M.line_terms(_clean(spark, sf)).select("path", "line", "term")


@query(f"WITH {_MATCH} SELECT path, line, symbol, risk, rule_id FROM m")
def token_match(spark, sf):
    return _matches(spark, sf).select("path", "line", "symbol", "risk", "rule_id")


@query(f"WITH {_MATCH} SELECT path, line, symbol, risk FROM m WHERE {_RANK} >= 1")
def min_risk(spark, sf):
    return _matches(spark, sf, "medium").select("path", "line", "symbol", "risk")


@query(f"WITH {_MATCH} SELECT path, line, count(*)::INT AS match_count, string_agg(symbol, ',' ORDER BY symbol) AS symbols, arg_max(risk, {_RANK}) AS line_max_risk, min(nullif(trim(text), '')) AS line_text FROM m GROUP BY path, line")
def group_by_line(spark, sf):
    return M.group_by_line(_matches(spark, sf)).select("path", "line", "match_count", F.array_join(F.transform("matches", lambda x: x["symbol"]), ",").alias("symbols"), "line_max_risk", "line_text")


@query(f"WITH {_MATCH} SELECT symbol, risk, count(*) AS n, count(DISTINCT path) AS n_files FROM m GROUP BY GROUPING SETS ((symbol), (risk), ())")
def symbol_tally(spark, sf):
    return M.tallies(_matches(spark, sf))


@query(f"WITH {_TERMS}, r AS (SELECT 'alias' || i || '_t' AS symbol, 'src/f' || i || '.c' AS scope FROM range(6) t(i)) SELECT path, line, symbol FROM terms JOIN r ON term = symbol AND path = scope WHERE NOT regexp_matches(clean, '\\b' || symbol || '\\b\\s*\\(')")
def scoped_rules(spark, sf):
    rules = spark.range(6).selectExpr("concat('alias', id, '_t') symbol", "'medium' risk", "'simple type' category", "'alias' description", "cast(null as string) rule_id", "false call_required", "array(concat('f', id, '.c')) scope_files", "true type_use_only", "true discovered")
    return M.match_rules(_clean(spark, sf), rules).select("path", "line", "symbol")


@query(f"WITH {_DEFINES} SELECT path, line, macro, value, kind, confidence, needs_followup FROM defs")
def define_subcheck(spark, sf):
    return D.scan_defines(synthetic_lines(spark, sf)).drop("text")


@query(f"WITH {_DEFINES} SELECT kind, macro, value, count(*) AS n FROM defs GROUP BY ALL")
def define_tally(spark, sf):
    return D.define_tally(D.scan_defines(synthetic_lines(spark, sf)))


@query(f"WITH {_ARITH} SELECT path, line, var, operator, is_compound, operand, risk, confidence FROM arith")
def arith_ops(spark, sf):
    return D.scan_arithmetic(synthetic_lines(spark, sf)).drop("text")


@query(f"WITH {_ARITH} SELECT risk, count(*) AS n FROM arith GROUP BY risk")
def arith_tally(spark, sf):
    return D.risk_tally(D.scan_arithmetic(synthetic_lines(spark, sf)))


@query(f"WITH {_CLEAN}, {_CASTS_OF_CLEAN} SELECT path, line, symbol, risk, kind, to_type, source FROM casts")
def cast_rows(spark, sf):
    return D.scan_casts(_clean(spark, sf)).drop("text")


_ASSIGNED = f"asg AS (SELECT DISTINCT path, regexp_extract(text, '{D.TIME_ASSIGNMENT}', 1) AS var FROM lines WHERE regexp_matches(text, '{D.TIME_ASSIGNMENT}')), av AS (SELECT path, list(var) AS vs FROM asg GROUP BY path)"


@query(f"WITH {_LINES}, {_ASSIGNED} SELECT path, var FROM asg")
def time_assign(spark, sf):
    return D.time_assignments(synthetic_lines(spark, sf))


# Formatted calls of the synthetic lines print one variable, raw ones copy one; both at the end of a line.
_IO = f"""{_LINES}, {_ASSIGNED}, io AS (SELECT path, line, text, 'printf' AS io_function, 'formatted_io_mismatch' AS io_category, 'Format specifier mismatch: Width mismatch (32-bit specifier vs 64-bit time_t)' AS reasoning FROM lines JOIN av USING (path) WHERE list_contains(vs, regexp_extract(text, '^printf\\("%d %s", (\\w+)\\)', 1))
 UNION ALL SELECT path, line, text, 'memcpy', 'raw_representation_risk', 'Size argument is sizeof(time_t) or sizeof(alias)' FROM lines JOIN av USING (path) WHERE list_contains(vs, regexp_extract(text, '^memcpy\\(.*&(\\w+), sizeof\\(time_t\\)\\)', 1)))"""


def _io(spark, sf) -> DataFrame:
    lines = synthetic_lines(spark, sf)
    return B.scan_io(D.with_context(lines, D.file_context(lines)))


@query(f"WITH {_IO} SELECT path, line, io_function, io_category, 6.0::DOUBLE AS score, reasoning, 'medium_confidence' AS io_confidence, CASE io_function WHEN 'printf' THEN 'manual_code_review' ELSE 'manual_interface_review_required' END AS remediation_class FROM io")
def io_boundaries(spark, sf):
    return _io(spark, sf).select("path", "line", "io_function", "io_category", "score", "reasoning", "io_confidence", "remediation_class")


@query(f"WITH {_IO} SELECT path, line, io_function AS symbol, 'medium' AS risk, 'I/O-boundary risk: ' || io_category AS description, 'io_boundary' AS discovery_method FROM io")
def io_union(spark, sf):
    return B.io_candidates(_io(spark, sf)).drop("text")


@query(f"WITH {_LINES}, o AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lines) SELECT DISTINCT path FROM o WHERE coalesce(before, 0) < 8192 AND regexp_matches(left(text, (8192 - coalesce(before, 0))::BIGINT), '(?i)\\b({_any((*B.FORMATTED, *B.RAW, *B.EXTERNAL))})\\s*\\(')")
def io_files(spark, sf):
    return B.io_files(synthetic_lines(spark, sf))


@query(r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, i::INT AS position, spec, CASE WHEN bits <> 64 AND NOT signed THEN 'Width mismatch (' || bits || '-bit specifier vs 64-bit time_t) and sign mismatch' WHEN bits <> 64 THEN 'Width mismatch (' || bits || '-bit specifier vs 64-bit time_t)' WHEN bits = 64 AND NOT signed THEN 'Sign mismatch (unsigned specifier vs signed time_t)' END AS problem
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([0, 1]) AS i, unnest(CASE l_partkey % 6 WHEN 0 THEN ['%d', '%lx'] WHEN 1 THEN ['%lld', '%u'] WHEN 2 THEN ['%hd', '%o'] WHEN 3 THEN ['%lu', '%li'] WHEN 4 THEN ['%x', '%llu'] ELSE ['%i', '%ld'] END) AS spec FROM lineitem),
LATERAL (SELECT CASE WHEN spec IN ('%hd', '%o') THEN NULL WHEN contains(spec, 'l') THEN 64 ELSE 32 END AS bits, right(spec, 1) IN ('d', 'i') AS signed)""")
def format_checks(spark, sf):
    text = F.get(F.array(*map(F.lit, ("a %d b %-8lx", "%lld%u", "%hd %o", "%5lu %li", "%X %llu", "%i%ld"))), (F.col("l_partkey") % 6).cast("int"))
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.inline(B.format_specs(text)))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("position").cast("int").alias("position"), "spec", B.spec_problem(F.struct("bits", "signed"), B.Abi()).alias("problem"))


_NARROW = "\\(int32_t\\)|\\(uint32_t\\)|\\(int\\)|\\(unsigned\\s+int\\)|\\(long\\)"
_MIGRATE = f"""{_UNITED}, b AS (SELECT path, line, symbol, snippet AS code FROM cand WHERE regexp_matches(snippet, '\\btime_t\\b|\\b(?:{_any(B.MIGRATION_CALLS)})\\s*\\(')),
risks AS (SELECT path, line, symbol, 'width_assumption' AS risk_type, 'blocker' AS severity FROM b WHERE regexp_matches(code, '(?i){_NARROW}') UNION ALL SELECT path, line, symbol, 'width_assumption', 'high_risk' FROM b WHERE regexp_matches(code, '{B.NARROW_SIZEOF}') UNION ALL SELECT path, line, symbol, 'io_size_mismatch', 'blocker' FROM b WHERE regexp_matches(code, '{B.LITERAL_FOUR}')
 UNION ALL SELECT path, line, symbol, 'signedness_assumption', 'blocker' FROM b WHERE regexp_matches(code, '{B.SIGN_CHECK}') UNION ALL SELECT path, line, symbol, 'signedness_assumption', 'blocker' FROM b WHERE regexp_matches(code, '{B.NUMBER_GIVEN}') UNION ALL SELECT path, line, symbol, 'architecture_assumption', 'medium_risk' FROM b WHERE regexp_matches(code, '\\(long\\)'))"""
_BEFORE, _AFTER = B.Abi("ILP32", 32, True), B.Abi("LP64", 64, False)


@query(f"WITH {_MIGRATE} SELECT path, line, symbol, risk_type, severity FROM risks")
def migration_risks(spark, sf):
    return B.migration_risks(_scan(spark, sf).candidates, _BEFORE, _AFTER).select("path", "line", "symbol", "risk_type", "severity")


@query(f"WITH {_IO} SELECT path, line, io_function AS symbol, 'io_format_mismatch' AS risk_type, 'high_risk' AS severity FROM io WHERE io_function = 'printf' UNION ALL SELECT path, line, io_function, 'signedness_assumption', 'high_risk' FROM io WHERE io_function = 'printf' UNION ALL SELECT path, line, io_function, 'io_size_mismatch', 'blocker' FROM io WHERE io_function = 'memcpy'")
def io_migration(spark, sf):
    return B.io_migration_risks(B.io_metadata(_io(spark, sf)), _BEFORE, _AFTER).select("path", "line", "symbol", "risk_type", "severity")


@query(f"WITH {_UNITED}, t AS (SELECT candidate_id, trim(snippet) AS t FROM cand) SELECT candidate_id, CASE WHEN starts_with(t, '#define') THEN 'macro' WHEN starts_with(t, 'struct') THEN 'type' WHEN contains(t, '(') AND contains(t, ')') THEN 'call' WHEN contains(t, '=') THEN 'assignment' ELSE 'unknown' END AS symbol_role FROM t WHERE NOT starts_with(t, 'typedef') AND NOT (starts_with(t, '#define') AND NOT contains(t, '('))")
def structural_roles(spark, sf):
    return M.structural_filter(_scan(spark, sf).candidates, True).select("candidate_id", "symbol_role")


@query(f"WITH {_UNITED} SELECT candidate_id, n_rows FROM cand WHERE conflict")
def dedupe_conflicts(spark, sf):
    return _scan(spark, sf).conflicts


# Detectors that name what they found by the line's first word meet at one identity with different methods and descriptions.
@query(f"""WITH {_UNITED}, u AS (SELECT path, line, regexp_extract(trim(text), '^\\w+') AS symbol, 'medium' AS risk, nullif(trim(description), '') AS description, discovery_method, rule_id FROM united),
e AS (SELECT path, line, symbol, risk, discovery_method, rule_id, description, count(*) AS n FROM u GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY path, line, symbol ORDER BY (rule_id IS NULL)::INT + (description IS NULL)::INT, list_position({list(C.METHODS)}, discovery_method), discovery_method, coalesce(rule_id, ''), coalesce(description, '')) AS r FROM e),
g AS (SELECT path, line, symbol, risk, sum(n)::BIGINT AS n_rows, count(DISTINCT discovery_method) > 1 AS m, count(DISTINCT rule_id) > 1 AS i, count(DISTINCT description) > 1 AS d, min(discovery_method) AS m0, min(rule_id) AS i0, min(description) AS d0 FROM e GROUP BY ALL)
SELECT concat_ws(':', path, line::VARCHAR, '0', '0', risk, symbol) AS candidate_id, CASE WHEN m OR i OR d THEN discovery_method ELSE m0 END AS discovery_method, CASE WHEN m OR i OR d THEN rule_id ELSE i0 END AS rule_id, CASE WHEN m OR i OR d THEN description ELSE d0 END AS description,
n_rows, n AS n_won, m OR i OR d AS conflict, concat_ws(',', CASE WHEN m THEN 'discovery_method' END, CASE WHEN i THEN 'rule_id' END, CASE WHEN d THEN 'description' END) AS contradicted FROM g JOIN o USING (path, line, symbol, risk) WHERE r = 1""")
def provenance_merge(spark, sf):
    known = D.with_context(_clean(spark, sf), D.file_context(synthetic_lines(spark, sf)))
    rows = found_rows(known, M.default_rules(spark))
    merged = V.merge_provenance(rows.withColumn("symbol", F.regexp_extract("snippet", r"^\w+", 0)).withColumn("risk", F.lit("medium")))
    return merged.select("candidate_id", *V.FIELDS, "n_rows", "n_won", "conflict", F.array_join("contradicted", ",").alias("contradicted"))


@query(f"WITH {_EVIDENCE} SELECT candidate_id, function_id, CASE WHEN function_id IS NULL THEN 'ungrouped' ELSE 'grouped' END AS analysis_coverage FROM ev")
def fn_interval_join(spark, sf):
    return _evidence(spark, sf).select("candidate_id", "function_id", "analysis_coverage")


@query(f"WITH {_EVIDENCE} SELECT count(*) AS total, count(function_id) AS grouped, count(*) - count(function_id) AS ungrouped, count(DISTINCT function_id) AS functions FROM ev")
def evidence_summary(spark, sf):
    return C.summarize(_evidence(spark, sf))


@query(f"WITH {_EVIDENCE}, f AS (SELECT function_id, path, string_agg(DISTINCT line::VARCHAR, ',' ORDER BY line::VARCHAR) AS lines, count(*) AS n FROM ev WHERE function_id IS NOT NULL GROUP BY ALL) SELECT function_id, lines, n::INT AS n, floor((row_number() OVER (PARTITION BY path ORDER BY function_id) - 1) / 2)::INT AS batch FROM f")
def fn_batches(spark, sf):
    found = C.batches(C.function_candidates(_evidence(spark, sf)), 2)
    return found.select("function_id", F.array_join(F.array_sort(F.transform("candidate_lines", lambda x: x.cast("string"))), ",").alias("lines"), F.size("candidate_ids").alias("n"), "batch")


@query(f"WITH {_UNITED}, t AS (SELECT DISTINCT path, line AS target FROM cand) SELECT l.path, target, string_agg(CASE WHEN l.line = target THEN '>>> ' ELSE '    ' END || l.line || ': ' || text, chr(10) ORDER BY l.line) AS frame FROM t JOIN lines l ON l.path = t.path AND l.line BETWEEN target - 5 AND target + 5 GROUP BY l.path, target")
def line_frame(spark, sf):
    return C.line_frames(synthetic_lines(spark, sf), _scan(spark, sf).candidates)


@query(f"""WITH RECURSIVE {_LINES}, l AS (SELECT path, line, length(text) + 1 AS n, sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line) AS upto FROM lines),
nx AS (SELECT a.path, a.line, least(max(b.line) + 1, a.line + 100) AS nxt FROM l a JOIN l b ON a.path = b.path AND b.line >= a.line AND (b.line = a.line OR b.upto - a.upto + a.n <= 2000) GROUP BY a.path, a.line),
s AS (SELECT DISTINCT path, 1 AS line, 1 AS part FROM l UNION ALL SELECT s.path, nxt, part + 1 FROM s JOIN nx ON nx.path = s.path AND nx.line = s.line JOIN l ON l.path = s.path AND l.line = nxt),
p AS (SELECT l.path, l.line, l.n, count(s.line) OVER (PARTITION BY l.path ORDER BY l.line) AS part FROM l LEFT JOIN s ON l.path = s.path AND l.line = s.line)
SELECT path, part::INT AS part, min(line) AS first, max(line) AS last, sum(n)::BIGINT AS chars FROM p GROUP BY path, part""")
def split_parts(spark, sf):
    return C.split_parts(synthetic_lines(spark, sf), 100, 2000)


@query(f"WITH {_LINES} SELECT DISTINCT path AS src, 'src/' || 'f' || (hash_n) || '.c' AS dst FROM (SELECT path, TRY_CAST(regexp_extract(text, '#include \"h(\\d)', 1) AS INT) AS hash_n FROM lines) WHERE 'src/f' || hash_n || '.c' <> path AND 'src/f' || hash_n || '.c' IN (SELECT path FROM lines)")
def include_edges(spark, sf):
    lines = _include_lines(spark, sf)
    return G.include_edges(lines, lines.select("path"))


def _include_lines(spark, sf) -> DataFrame:
    """The synthetic lines with headers renamed to files that exist."""
    return synthetic_lines(spark, sf).withColumn("text", F.regexp_replace("text", r'#include "h(\d)\.h"', '#include "f$1.c"'))


_INCLUDED = f"{_LINES}, e AS (SELECT DISTINCT path AS src, 'src/f' || n || '.c' AS dst FROM (SELECT path, TRY_CAST(regexp_extract(text, '#include \"h(\\d)', 1) AS INT) AS n FROM lines) WHERE 'src/f' || n || '.c' <> path AND 'src/f' || n || '.c' IN (SELECT path FROM lines)), c AS (SELECT DISTINCT path AS tu, path AS visible FROM lines UNION SELECT tu, dst FROM c JOIN e ON visible = src)"


def _graph(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, files and include edges of the synthetic files."""
    lines = _include_lines(spark, sf)
    files = lines.select("path").distinct()
    return lines, files, G.include_edges(lines, files)


@query(f"WITH RECURSIVE {_INCLUDED} SELECT tu, visible FROM c")
def include_closure(spark, sf):
    _, files, edges = _graph(spark, sf)
    return G.include_closure(files, edges)


_ALIASES = f"RECURSIVE {_INCLUDED}, td AS (SELECT DISTINCT path, regexp_extract(text, '^typedef (\\w+) (\\w+);', 2) AS alias, regexp_extract(text, '^typedef (\\w+) (\\w+);', 1) AS word FROM lines WHERE regexp_matches(text, '^typedef ')), v AS (SELECT DISTINCT tu, alias, word FROM c JOIN td ON visible = path), h AS (SELECT tu, alias, 1 AS hop FROM v WHERE word = 'time_t' UNION SELECT v.tu, v.alias, hop + 1 FROM h JOIN v ON v.tu = h.tu AND v.word = h.alias WHERE hop < 5), hop AS (SELECT tu, alias, min(hop)::INT AS hop FROM h GROUP BY tu, alias)"


def _alias_scope(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Aliases of each file, the include edges and the type definitions."""
    lines, _, edges = _graph(spark, sf)
    typedefs = G.typedef_lines(lines)
    return G.reached_aliases(typedefs, edges), edges, typedefs


@query(f"WITH {_ALIASES} SELECT tu, alias, hop FROM hop")
def alias_bfs(spark, sf):
    return _alias_scope(spark, sf)[0]


@query(f"WITH {_ALIASES} SELECT alias, count(DISTINCT tu) AS n_files, min(hop)::INT AS hop FROM hop GROUP BY alias")
def alias_flatten(spark, sf):
    return G.flatten_aliases(_alias_scope(spark, sf)[0])


@query(f"WITH {_ALIASES} SELECT tu AS path, string_agg(alias, ',' ORDER BY alias) AS aliases FROM hop GROUP BY tu")
def alias_payload(spark, sf):
    return G.alias_payload(_alias_scope(spark, sf)[0]).withColumn("aliases", F.array_join("aliases", ","))


@query(f"WITH {_ALIASES}, d AS (SELECT DISTINCT c.tu, alias, path || ':' || line || ': ' || text AS d FROM c JOIN (SELECT path, line, text, regexp_extract(text, '^typedef (\\w+) (\\w+);', 2) AS alias FROM lines WHERE regexp_matches(text, '^typedef ')) ON visible = path JOIN hop USING (tu, alias)) SELECT alias AS symbol, count(DISTINCT tu)::INT AS n_files, count(DISTINCT d)::INT AS n_definitions, 'Typedef alias for time_t (discovered: ' || count(DISTINCT d) || ' definitions)' AS description FROM d GROUP BY alias")
def alias_rules(spark, sf):
    lines, _, _ = _graph(spark, sf)
    aliases, edges, typedefs = _alias_scope(spark, sf)
    rules = G.alias_rules(G.reached_definitions(aliases, typedefs.join(lines.select("path", "line", "text"), ["path", "line"]), edges))
    return rules.select("symbol", F.size("scope_files").alias("n_files"), F.size("definitions").alias("n_definitions"), "description")


@query("SELECT 'h' || (l_partkey % 9) || '.h' AS base, 'd0/h' || (l_partkey % 9) || '.h' AS path FROM lineitem WHERE l_partkey % 9 > 2 GROUP BY ALL")
def unique_basename(spark, sf):
    """Names with a remainder under three lie in three folders, the others in one."""
    k = F.col("l_partkey") % 9
    folder = F.when(k < 3, F.col("l_suppkey") % 3).otherwise(0)
    return G.unique_basenames(_t(spark, sf, "lineitem").select(F.concat(F.lit("d"), folder.cast("string"), F.lit("/h"), k.cast("string"), F.lit(".h")).alias("path")))


_RESPONSES = """req AS (SELECT doc_id::VARCHAR AS id FROM documents), lab AS (SELECT *, CASE WHEN doc_id % 5 = 4 THEN 'old' ELSE '' END || doc_id AS id FROM labels), resp AS (SELECT id, CASE WHEN doc_id % 11 = 0 THEN 'maybe' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS summary FROM lab UNION ALL SELECT id, 'abstain' FROM lab WHERE doc_id % 7 = 0),
ans AS (SELECT id, count(*) AS n, min(summary) AS summary FROM resp GROUP BY id), al AS (SELECT coalesce(req.id, ans.id) AS id, CASE WHEN req.id IS NULL THEN 'unknown_id' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN summary NOT IN ('yes', 'no', 'abstain') THEN 'invalid' ELSE 'completed' END AS status, summary FROM req FULL JOIN ans ON req.id = ans.id),
asg AS (SELECT 'fn' || id AS function_id, status, CASE WHEN status = 'completed' THEN summary END AS verdict FROM al)"""


def _aligned(spark, sf) -> DataFrame:
    """Every document asked about; every label an answer, some to ids that nobody asked for and some given twice."""
    asked = _t(spark, sf, "documents").select(F.concat(F.lit("fn"), F.col("doc_id").cast("string")).alias("function_id"))
    labels = _t(spark, sf, "labels")
    name = F.concat(F.lit("fn"), F.when(F.col("doc_id") % 5 == 4, "old").otherwise(""), F.col("doc_id").cast("string")).alias("function_id")
    first = labels.select(name, F.when(F.col("doc_id") % 11 == 0, "maybe").when(F.col("quality") == 1, "yes").otherwise("no").alias("summary"))
    more = labels.filter("doc_id % 7 = 0").select(name, F.lit("abstain").alias("summary"))
    return A.align(asked, first.unionByName(more).withColumn("confidence", F.lit("0.8")).withColumn("reason", F.lit(" as  labelled ")))


@query(f"WITH {_RESPONSES} SELECT *, CASE WHEN status = 'completed' THEN 0.8::DOUBLE END AS confidence, CASE WHEN status = 'completed' THEN 'as labelled' END AS reason FROM asg")
def response_align(spark, sf):
    return _aligned(spark, sf)


@query(f"WITH {_RESPONSES} SELECT count(*) AS total, count_if(status = 'completed')::BIGINT AS completed, count_if(status <> 'completed')::BIGINT AS errors, count_if(verdict = 'yes')::BIGINT AS yes, count_if(verdict = 'no')::BIGINT AS no, count_if(verdict = 'abstain')::BIGINT AS abstain FROM asg")
def assessment_summary(spark, sf):
    return A.summary(_aligned(spark, sf))


@query(f"WITH {_RESPONSES} SELECT CASE WHEN count_if(status <> 'completed') = 0 THEN 'complete' WHEN count_if(status = 'completed') = 0 THEN 'failed' ELSE 'partial' END AS run_status FROM asg")
def run_status(spark, sf):
    return A.run_status(_aligned(spark, sf))


@query("SELECT 'fn' || user_id AS function_id, max(event_id) AS pass_no, arg_max(event_type, event_id) AS verdict FROM events GROUP BY user_id")
def assessment_upsert(spark, sf):
    rows = _t(spark, sf, "events").select(F.concat(F.lit("fn"), F.col("user_id").cast("string")).alias("function_id"), F.col("event_id").alias("pass_no"), F.col("event_type").alias("verdict"))
    return A.upsert(rows)


@query(f"WITH {_RESPONSES}, f AS (SELECT function_id, verdict, CASE WHEN function_id LIKE '%3' THEN 'yes' ELSE 'no' END AS y2106 FROM asg WHERE verdict IS NOT NULL) SELECT * FROM f WHERE verdict <> 'no' OR y2106 = 'yes'")
def output_filter(spark, sf):
    rows = _aligned(spark, sf).filter("verdict is not null").select("function_id", "verdict", F.when(F.col("function_id").endswith("3"), "yes").otherwise("no").alias("y2106"))
    return A.output_filter(rows, False, True)


_RAW = """raw AS (SELECT 'F' || l_orderkey || '-' || l_linenumber AS finding_id, 'src/d' || (l_suppkey % 4) || '/f' || (l_orderkey % 10) || '.c' AS file, 's' || (l_partkey % 5) AS symbol, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'time-rule ' || (l_partkey % 4) END AS rule,
 CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'odd' END AS verdict, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 10 END AS confidence, CASE WHEN l_linenumber % 2 = 0 THEN 'High' END AS severity, l_linenumber, l_suppkey FROM lineitem),
nf AS (SELECT finding_id, file, symbol, CASE WHEN rule IS NULL THEN upper(symbol) ELSE replace(replace(upper(rule), '-', '_'), ' ', '_') END AS rule_id, CASE WHEN verdict IN ('yes', 'no') THEN verdict ELSE 'unknown' END AS issue_class, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence::DOUBLE END AS confidence, severity, l_linenumber::INT AS start_line, (l_linenumber + l_suppkey % 5)::INT AS end_line FROM raw),
n AS (SELECT * EXCLUDE severity, CASE WHEN severity IS NOT NULL THEN 'high' WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.75 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN severity IS NOT NULL THEN 'severity' WHEN confidence IS NULL THEN 'none' ELSE 'derived' END AS risk_source FROM nf)"""


def _findings(spark, sf) -> DataFrame:
    c = F.col
    s = lambda x: x.cast("string")
    raw = _t(spark, sf, "lineitem").select(
        F.concat(F.lit("F"), s(c("l_orderkey")), F.lit("-"), s(c("l_linenumber"))).alias("finding_id"), F.concat(F.lit("src/d"), s(c("l_suppkey") % 4), F.lit("/f"), s(c("l_orderkey") % 10), F.lit(".c")).alias("file"), F.concat(F.lit("s"), s(c("l_partkey") % 5)).alias("symbol"),
        F.when(c("l_partkey") % 3 != 0, F.concat(F.lit("time-rule "), s(c("l_partkey") % 4))).alias("rule_id"), F.when(c("l_returnflag") == "A", "yes").when(c("l_returnflag") == "R", "no").otherwise("odd").alias("verdict"),
        F.when(c("l_linenumber") != 7, c("l_discount") * 10).alias("confidence"), F.when(c("l_linenumber") % 2 == 0, "High").alias("severity"), F.sequence(c("l_linenumber").cast("int"), (c("l_linenumber") + c("l_suppkey") % 5).cast("int")).alias("lines"),
    )
    return R.normalize_findings(raw).select("finding_id", "file", "symbol", "rule_id", "issue_class", "confidence", "risk", "risk_source", "start_line", "end_line")


@query(f"WITH {_RAW} SELECT * FROM n")
def report_normalize(spark, sf):
    return _findings(spark, sf)


@query(f"WITH {_RAW} SELECT * FROM n WHERE issue_class = 'yes' AND confidence >= 0.5 AND file LIKE 'src/d1/%' AND rule_id IN ('TIME_RULE_1', 'S2')")
def report_filter(spark, sf):
    return R.apply_filters(_findings(spark, sf), "yes", 0.5, ["src/d1/*"], ["TIME_RULE_1", "S2"])


_ORDERS = {
    "line": "start_line NULLS LAST, file, finding_id, rule_id, confidence NULLS LAST, end_line",
    "risk": "CASE risk WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END DESC, coalesce(nullif(confidence, 0), -1) DESC, file, start_line NULLS LAST, finding_id, rule_id, confidence NULLS LAST, end_line",
    "confidence": "coalesce(confidence, -1) DESC, file, start_line NULLS LAST, finding_id, rule_id, confidence NULLS LAST, end_line",
    "file": "file, start_line NULLS LAST, finding_id, rule_id, confidence NULLS LAST, end_line",
}


def _report_sort(by: str) -> None:
    def run(spark, sf):
        return R.top(_findings(spark, sf), by, 100).select("rank", "finding_id", "file", "start_line", "risk", "confidence")

    run.__name__ = f"report_sort_{by}"
    query(f"WITH {_RAW} SELECT row_number() OVER (ORDER BY {_ORDERS[by]})::INT AS rank, finding_id, file, start_line, risk, confidence FROM n QUALIFY rank <= 100")(run)


for _by in _ORDERS:
    _report_sort(_by)


@query(f"WITH {_RAW} SELECT rule_id, count(*) AS n, count_if(issue_class = 'yes')::BIGINT AS n_yes, max(confidence) AS top_confidence, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM n GROUP BY rule_id")
def report_group_rule(spark, sf):
    return R.group_findings(_findings(spark, sf)).withColumn("files", F.array_join("files", ","))


@query(f"WITH {_RAW} SELECT issue_class, count(*) AS n FROM n GROUP BY issue_class")
def report_class_counts(spark, sf):
    return R.class_counts(_findings(spark, sf))


@query("SELECT 'd' || doc_id AS finding_id, (i + doc_id % 7)::INT AS line_no, md5(t) AS digest, (i + doc_id % 7) % 3 = 0 AND (i + doc_id % 7) <= 30 AS is_affected FROM (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))")
def snippet_lines(spark, sf):
    rows = _t(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("finding_id"), F.col("text").alias("snippet"), (F.col("doc_id") % 7).cast("int").alias("base_line"), F.array(*[F.lit(i) for i in range(0, 31, 3)]).alias("affected"))
    return R.snippet_lines(rows).select("finding_id", "line_no", F.md5(F.col("text").cast("binary")).alias("digest"), "is_affected")


@query(f"WITH {_UNITED}, r AS (SELECT *, 'repo' || (CAST(regexp_extract(path, '(\\d+)', 1) AS INT) % 4) AS repo FROM cand) SELECT repo, risk, count(*) AS n, count(DISTINCT path) AS n_files, grouping(repo, risk)::BIGINT AS level FROM r GROUP BY ROLLUP (repo, risk)")
def repo_rollup(spark, sf):
    return S.repo_rollup(_scan(spark, sf).candidates, F.concat(F.lit("repo"), (F.regexp_extract("path", r"(\d+)", 1).cast("int") % 4).cast("string")))


@query("SELECT s_suppkey, 'github__own' || (s_nationkey % 3) || '__r_' || s_suppkey || '__' || CASE WHEN s_suppkey % 2 = 0 THEN 'feature_x' ELSE '0123456789ab' END AS repo_key, 'https://***@github.com/own' || (s_nationkey % 3) || '/r ' || s_suppkey || '.git' AS safe_url, s_suppkey % 10 = 3 AS wanted FROM supplier")
def repo_keys(spark, sf):
    k = F.col("s_suppkey").cast("string")
    url = F.concat(F.lit("https://me:pw@github.com/own"), (F.col("s_nationkey") % 3).cast("string"), F.lit("/r "), k, F.lit(".git"))
    ref = F.when(F.col("s_suppkey") % 2 == 0, "feature/x").otherwise("0123456789ABCDEF01234567")
    rows = _t(spark, sf, "supplier").select("s_suppkey", url.alias("url"), ref.alias("ref"))
    return rows.select("s_suppkey", S.repo_key(F.col("url"), F.col("ref")).alias("repo_key"), X.redact_credentials(F.col("url")).alias("safe_url"), S.matches_terms(["3.GIT"], "url").alias("wanted"))


_CAT = "cat AS (SELECT p_partkey AS pos, 'sym' || (p_partkey % 150) AS symbol, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'BAD-' || p_partkey ELSE 'RULE-' || lpad((p_partkey % 190)::VARCHAR, 4, '0') END AS rule_id FROM part), ret AS (SELECT 'RULE-' || lpad(i::VARCHAR, 4, '0') AS rule_id FROM range(5, 50, 9) t(i))"


def _catalog(spark, sf) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    rules = _t(spark, sf, "part").select(k.alias("pos"), F.concat(F.lit("sym"), (k % 150).cast("string")).alias("symbol"), F.when(k % 10 == 0, None).when(k % 17 == 0, F.concat(F.lit("BAD-"), k.cast("string"))).otherwise(F.format_string("RULE-%04d", (k % 190).cast("long"))).alias("rule_id"))
    return rules, spark.range(5, 50, 9).select(F.format_string("RULE-%04d", "id").alias("rule_id"))


@query(f"WITH {_CAT} SELECT 'duplicate id' AS problem, rule_id AS value, count(*) AS n FROM cat WHERE rule_id IS NOT NULL GROUP BY rule_id HAVING count(*) > 1 UNION ALL SELECT 'duplicate symbol', symbol, count(*) FROM cat GROUP BY symbol HAVING count(*) > 1 UNION ALL SELECT 'malformed id', rule_id, count(*) FROM cat WHERE NOT regexp_matches(rule_id, '^RULE-\\d{{4}}$') GROUP BY rule_id UNION ALL SELECT 'missing id', '', count(*) FROM cat WHERE rule_id IS NULL HAVING count(*) > 0 UNION ALL SELECT 'retired id', rule_id, count(*) FROM cat WHERE rule_id IN (SELECT rule_id FROM ret) GROUP BY rule_id")
def catalog_duplicates(spark, sf):
    return S.duplicate_rules(*_catalog(spark, sf))


@query(f"WITH {_CAT}, used AS (SELECT DISTINCT try_cast(regexp_extract(rule_id, '(\\d{{4}})$', 1) AS INT) AS n FROM (SELECT rule_id FROM cat UNION ALL SELECT rule_id FROM ret)), need AS (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM cat WHERE rule_id IS NULL), free AS (SELECT i AS n, row_number() OVER (ORDER BY i) AS k FROM range(1, 10000) t(i) WHERE i NOT IN (SELECT n FROM used WHERE n IS NOT NULL)) SELECT pos, symbol, 'RULE-' || lpad(free.n::VARCHAR, 4, '0') AS rule_id FROM need LEFT JOIN free USING (k) UNION ALL SELECT pos, symbol, rule_id FROM cat WHERE rule_id IS NOT NULL")
def next_rule_id(spark, sf):
    rules, retired = _catalog(spark, sf)
    return S.assign_rule_ids(rules, retired).select("pos", "symbol", "rule_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 > 0 THEN concat_ws('_', CASE WHEN p_partkey % 4 = 0 THEN 'ilp32' ELSE 'lp64' END, CASE p_size % 3 WHEN 1 THEN 'signed' ELSE 'unsigned' END, '32bit') END AS config_id FROM part".replace("p_size", "(p_partkey // 7)"))
def config_ids(spark, sf):
    k = F.col("p_partkey")
    size = F.floor(k / 7) % 3
    rows = _t(spark, sf, "part").select("p_partkey", F.when(k % 4 == 0, " ilp32").otherwise("LP64").alias("m"), F.when(size == 1, "Signed").when(size == 2, "unsigned").otherwise("other").alias("s"), F.when(k % 2 == 0, 32).otherwise(16).alias("b"))
    return rows.select("p_partkey", K.config_id(F.col("m"), F.col("s"), F.col("b")).alias("config_id"))


_EVD = """ev AS (SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'ILP32' WHEN 1 THEN 'LP64' END AS architecture, 0.9::DOUBLE AS arch_conf, CASE c_custkey % 5 WHEN 0 THEN 32 WHEN 1 THEN 64 END AS bits, 0.5::DOUBLE AS bits_conf, CASE WHEN c_custkey % 7 = 0 THEN 'signed' END AS sign, 1.0::DOUBLE AS sign_conf FROM customer),
cf AS (SELECT m, s, b, lower(m) || '_' || s || '_' || b || 'bit' AS config_id FROM (VALUES ('ILP32'), ('LP64')) a(m), (VALUES ('signed'), ('unsigned')) c(s), (VALUES (32), (64)) d(b)),
lk AS (SELECT *, coalesce(architecture <> m, false) AS a_out, coalesce(bits <> b, false) AS b_out, coalesce(sign <> s, false) AS s_out, CASE WHEN architecture IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN bits IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN sign IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END AS w,
 round(least(1.0::DOUBLE, 0.125::DOUBLE + CASE WHEN architecture IS NOT NULL THEN 0.3::DOUBLE * arch_conf ELSE 0 END + CASE WHEN bits IS NOT NULL THEN 0.2::DOUBLE * bits_conf ELSE 0 END + CASE WHEN sign IS NOT NULL THEN 0.15::DOUBLE * sign_conf ELSE 0 END), 6) AS sc,
 CASE WHEN architecture IS NOT NULL THEN 0.4::DOUBLE * arch_conf ELSE 0 END + CASE WHEN bits IS NOT NULL THEN 0.4::DOUBLE * bits_conf ELSE 0 END + CASE WHEN sign IS NOT NULL THEN 0.2::DOUBLE * sign_conf ELSE 0 END AS ws FROM ev, cf),
sc AS (SELECT key, config_id, CASE WHEN a_out OR b_out OR s_out THEN 0.0::DOUBLE ELSE sc END AS likelihood, CASE WHEN a_out THEN arch_conf WHEN b_out THEN bits_conf WHEN s_out THEN sign_conf WHEN w > 0 THEN round(ws / w, 6) ELSE 0.3::DOUBLE END AS confidence, a_out OR b_out OR s_out AS ruled_out,
 CASE WHEN a_out THEN 'Architecture is ' || architecture || ', not ' || m WHEN b_out THEN 'time_t is ' || bits || '-bit, not ' || b || '-bit' WHEN s_out THEN 'time_t is ' || sign || ', not ' || s END AS ruled_out_reason FROM lk)"""


def _likely(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    ev = _t(spark, sf, "customer").select(k.alias("key"), F.when(k % 3 == 0, "ILP32").when(k % 3 == 1, "LP64").alias("architecture"), F.lit(0.9).alias("arch_conf"), F.when(k % 5 == 0, 32).when(k % 5 == 1, 64).alias("bits"), F.lit(0.5).alias("bits_conf"), F.when(k % 7 == 0, "signed").alias("sign"), F.lit(1.0).alias("sign_conf"))
    return E.likelihoods(spark, ev)


@query(f"WITH {_EVD} SELECT * FROM sc")
def config_likelihood(spark, sf):
    return _likely(spark, sf)


@query(f"WITH {_EVD}, u AS (SELECT *, max(nullif(round(likelihood, 2), 0)) OVER w = min(nullif(round(likelihood, 2), 0)) OVER w AND max(likelihood) OVER w < 0.3 AS unsure FROM sc WINDOW w AS (PARTITION BY key)), v AS (SELECT key, config_id, CASE WHEN unsure OR likelihood = 0 THEN 0.125 ELSE likelihood END::DOUBLE AS likelihood FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY likelihood DESC, config_id)::INT AS rank FROM v) SELECT key, rank, config_id, likelihood, CASE WHEN likelihood > 0.7 THEN 'high' WHEN likelihood > 0.3 THEN 'medium' ELSE 'low' END AS label, rank = 1 AND likelihood > 0.7 AS recommended FROM r")
def config_ranking(spark, sf):
    return E.ranked_configs(_likely(spark, sf))


@query(f"WITH {_EVD} SELECT key, arg_min(config_id, struct_pack(l := -likelihood, c := config_id)) AS config_id, max(likelihood) AS likelihood FROM sc WHERE NOT ruled_out GROUP BY key")
def config_argmax(spark, sf):
    return E.best_config(_likely(spark, sf))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'LP64-64bit-N/A' WHEN c_custkey % 3 = 0 THEN 'ILP32-64bit-N/A' ELSE 'ILP32-32bit-' || CASE WHEN c_custkey % 5 = 0 THEN 'unsigned' ELSE 'signed' END || '-time64_' || CASE c_custkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END END AS hint, c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS mitigate FROM customer")
def scenario_hints(spark, sf):
    k = F.col("c_custkey")
    hint = K.scenario_hint(F.when(k % 2 == 0, "LP64").otherwise("ILP32"), F.when(k % 3 == 0, 64).otherwise(32), F.when(k % 5 == 0, "unsigned").otherwise("signed"), K.capability(F.when(k % 7 == 0, "Yes").when(k % 7 == 1, " no ")))
    return _t(spark, sf, "customer").select("c_custkey", hint.alias("hint"), K.needs_mitigation(hint).alias("mitigate"))


@query("SELECT event_id, CASE WHEN status IN (401, 403) THEN 'auth' WHEN status IN (400, 404, 405, 413) THEN 'client_error' WHEN status = 429 THEN 'rate_limit' WHEN status BETWEEN 500 AND 599 THEN 'server_error' ELSE 'http_error' END AS category, status NOT IN (400, 401, 403, 404, 405, 413) AS retryable FROM (SELECT event_id, 395 + event_id % 120 AS status FROM events)")
def http_status(spark, sf):
    found = O.request_errors(_t(spark, sf, "events").select("event_id", (395 + F.col("event_id") % 120).alias("status")))
    return found.select("event_id", "category", "retryable")


@query("SELECT doc_id, CASE WHEN length(t) > 240 THEN left(t, 237) || '...' ELSE t END AS snippet, CASE WHEN length(r) > 200 THEN left(r, 197) || '...' ELSE r END AS reason FROM (SELECT doc_id, trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS t, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS r FROM documents)")
def bounded_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.bound_snippet(F.col("text")).alias("snippet"), X.bound_reason(F.col("text")).alias("reason"))


@query()
def truncated_utf8(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.truncate_utf8(F.col("text"), 100).alias("text"))


@query()
def result_documents(spark, sf):
    """The whole result document of every file, with stand-ins for functions."""
    spans = _spans(spark, sf)
    return result_document(C.join_functions(_scan(spark, sf).candidates, spans), spans, timestamp="-")


# Thirty lines and the two around them are a function of a wrapped file.
_WRAPPED = f"WITH {_LINES}, w AS (SELECT path, floor((line - 1) / 30)::INT AS b, count(*) AS n FROM lines GROUP BY ALL)"


@query(f"{_WRAPPED} SELECT path, 'fn' || b AS name, b * 32 + 1 AS start_line, (b * 32 + n + 2)::INT AS end_line FROM w")
def function_spans(spark, sf):
    """Each file's lines wrapped into functions of thirty lines, then found again."""
    return P.scan_functions(_wrapped_files(spark, sf))


@query(f"{_WRAPPED} SELECT path, 'fn' || b AS name, b * 32 + 1 AS start_line, (b * 32 + n + 2)::INT AS end_line FROM w")
def spans_in_sql(spark, sf):
    """Function spans by a table function in SQL, over a text column."""
    register_table_functions(spark)
    return spark.sql("SELECT path, s.* FROM {files} AS f, LATERAL spans(f.content) AS s", files=_wrapped_files(spark, sf))


@query(f"{_WRAPPED} SELECT path, 'fn' || b AS name, b * 32 + 1 AS start_line, (b * 32 + n + 2)::INT AS end_line FROM w")
def line_spans_in_sql(spark, sf):
    """The same by a table function that takes lines, partitioned by file."""
    register_table_functions(spark)
    return spark.sql("SELECT * FROM line_spans(TABLE(SELECT path, line, text FROM {lines}))", lines=split_lines(_wrapped_files(spark, sf)))


def _broken_lines(spark, sf) -> DataFrame:
    """The synthetic lines, each broken in two after its first parenthesis."""
    at = F.instr("text", "(")
    pieces = F.when(at > 0, F.array(F.left("text", at), F.substring("text", at + 1, F.length("text")))).otherwise(F.array("text"))
    return synthetic_lines(spark, sf).select("path", "line", F.posexplode(pieces).alias("i", "text")).select("path", (F.col("line") * 2 - 1 + F.col("i")).alias("line"), "text")


@query(f"WITH {_LINES} SELECT path, line * 2 - 1 AS line, line * 2 - CASE WHEN contains(text, '(') THEN 0 ELSE 1 END AS last_line, trim(regexp_replace(regexp_replace(text, '\\(', '( '), '//.*$', '')) AS text FROM lines WHERE text <> ''")
def statements(spark, sf):
    return Y.statements(_broken_lines(spark, sf)).drop("parts")


@query(f"WITH {_CLEAN}, {_CASTS_OF_CLEAN} SELECT path, line * 2 - 1 AS line, line * 2 - CASE WHEN contains(text, '(') AND instr(text, source) > instr(text, '(') THEN 0 ELSE 1 END AS place, symbol, risk, kind, to_type, source FROM casts")
def statement_casts(spark, sf):
    """Casts in statements over several lines, with the line in which the value stands."""
    whole = Y.statements(_broken_lines(spark, sf))
    found = D.scan_casts(with_clean_text(whole.select("path", "line", "text", "parts")), keep=("parts",))
    return found.select("path", "line", Y.place_of(F.col("parts"), F.instr(F.col("text"), F.col("source")) - 1).alias("place"), "symbol", "risk", "kind", "to_type", "source")


@query()
def typedef_scan(spark, sf):
    files = synthetic_lines(spark, sf).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return P.scan_typedefs(files)


# ---- responses, findings, artifacts

_WIRE = """w AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '{"function_id": 5, "y2038_summary": "yes", "confidence": 0.5, "issues": [], "needs_more_context": false, "needs": []}'
 WHEN 1 THEN '{"function_id": "f", "y2038_summary": "maybe", "confidence": 0.5, "issues": [], "needs_more_context": false, "needs": []}' WHEN 2 THEN '{"function_id": "f", "y2038_summary": "no", "confidence": "0.5", "issues": [], "needs_more_context": false, "needs": []}'
 WHEN 3 THEN '{"function_id": "f", "y2038_summary": "no", "confidence": 0.5, "issues": [], "needs_more_context": false}' WHEN 4 THEN '{"function_id": "f", "y2038_summary": "no", "confidence": 0.5, "issues": [], "needs_more_context": false, "needs": ["x"]}'
 WHEN 5 THEN '{"function_id": "f", "y2038_summary": "no", "confidence": 1.5, "issues": [], "needs_more_context": false, "needs": ["macros"]}' WHEN 6 THEN '3' WHEN 7 THEN '{"function_id": "f", "y2038_summary": "no", "confidence": 0.5, "issues": [], "needs_more_context": 0, "needs": [], "more": 1}'
 ELSE '{"function_id": "f", "y2038_summary": "no", "confidence": 1, "issues": [{"type": "t", "line": 3, "description": "d"}], "needs_more_context": true, "needs": ["macros"]}' END AS body FROM documents)"""


@query("SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'function_id' WHEN 1 THEN 'summary' WHEN 2 THEN 'confidence' WHEN 3 THEN 'missing field' WHEN 4 THEN 'needs' WHEN 5 THEN 'confidence' WHEN 6 THEN 'not an object' WHEN 7 THEN 'extra field' END AS problem, CASE WHEN doc_id % 9 = 8 THEN 1.0::DOUBLE END AS confidence FROM documents")
def wire_check(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id")
    docs.createOrReplaceTempView("_wire_documents")
    body = spark.sql(f"WITH {_WIRE.replace('FROM documents', 'FROM _wire_documents')} SELECT doc_id, concat('[', body, ']') AS body FROM w")
    return W.judge_items(W.parse_items(body)).select("doc_id", "problem", "confidence")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (l_partkey % 4 = 0) <> (l_suppkey % 5 = 0) THEN 'one missing' WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 7 - 1 < 0 THEN 'negative' WHEN l_partkey % 7 - 1 > l_suppkey % 9 THEN 'out of order' END AS problem FROM lineitem")
def column_check(spark, sf):
    rows = _t(spark, sf, "lineitem")
    start, end = F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey") % 7 - 1), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 9)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", W.column_problem(start, end).alias("problem"))


@query(f"WITH {_MATCH}, g AS (SELECT path, line, count(*) AS n, max({_RANK}) AS top FROM m GROUP BY path, line) SELECT path, line, CASE WHEN line % 3 = 0 THEN 'count' WHEN top <> 2 THEN 'risk' END AS problem FROM g")
def line_record_check(spark, sf):
    match = F.struct("line", "symbol", "risk")
    records = _matches(spark, sf).groupBy("path", "line").agg(F.collect_set(match).alias("matches"))
    count = F.size("matches") + F.when(F.col("line") % 3 == 0, 1).otherwise(0)
    return records.select("path", "line", W.summary_problem(F.col("matches"), count, F.lit("high")).alias("problem"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'missing c_library' END, CASE WHEN c_custkey % 5 = 0 THEN 'hardware_model' END, CASE WHEN c_custkey % 7 = 0 THEN 'time_t_size_bits' END, CASE WHEN c_custkey % 3 = 1 THEN 'c_library_other_text' END, CASE c_custkey % 4 WHEN 0 THEN 'd_time_bits_setting must be not_available where d_time_bits_supported is false' WHEN 1 THEN 'd_time_bits_setting cannot be not_available where d_time_bits_supported is true' WHEN 2 THEN 'd_time_bits_setting cannot be not_available where d_time_bits_supported is unknown' END, CASE WHEN c_custkey % 13 = 0 THEN 'mitigation_path' END, CASE WHEN c_custkey % 11 = 0 THEN 'toolchain_flags' END) AS errors FROM customer")
def environment_check(spark, sf):
    k = F.col("c_custkey")
    rows = _t(spark, sf, "customer").select(
        k, F.when(k % 5 == 0, "X86").otherwise("lp64").alias("hardware_model"), F.lit("signed").alias("time_t_signed"), F.when(k % 7 == 0, 16).otherwise(64).alias("time_t_size_bits"), F.when(k % 3 == 1, "other").when(k % 3 == 2, "musl").alias("c_library"),
        F.lit(" ").alias("c_library_other_text"), F.when(k % 4 == 0, False).when(k % 4 == 1, True).alias("d_time_bits_supported"), F.when((k % 4).isin(1, 2), "not_available").otherwise("64").alias("d_time_bits_setting"), F.array(F.when(k % 11 == 0, "m32").otherwise("-m32")).alias("toolchain_flags"),
        F.when(k % 13 == 0, "ILP32-32bit-signed-time64_no").otherwise("LP64-64bit-N/A").alias("scenario_hint"), F.lit(None).cast("string").alias("mitigation_path"),
    )
    return W.environment_errors(rows).select("c_custkey", F.array_join("errors", ",").alias("errors"))


@query("SELECT c_custkey, hint AS scenario_hint, CASE WHEN hint IN ('ILP32-32bit-signed-time64_no', 'ILP32-32bit-signed-time64_unknown') THEN 'upgrade_env' END AS mitigation_path, lower(m) || '_' || s || '_' || b || 'bit' AS config_id, m || ', time_t=' || b || ' ' || s || ', time64=' || t || ', _TIME_BITS=' || CASE c_custkey % 4 WHEN 0 THEN 'supported:64' WHEN 1 THEN 'not_supported' ELSE 'support_unknown:unknown' END || ', c_lib=' || CASE WHEN c_custkey % 6 = 0 THEN 'other(own)' ELSE 'musl' END AS summary FROM (SELECT *, CASE WHEN m = 'LP64' THEN 'LP64-64bit-N/A' WHEN b = 64 THEN 'ILP32-64bit-N/A' ELSE 'ILP32-32bit-' || s || '-time64_' || t END AS hint FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'LP64' ELSE 'ILP32' END AS m, CASE WHEN c_custkey % 3 = 0 THEN 64 ELSE 32 END AS b, CASE WHEN c_custkey % 5 = 0 THEN 'unsigned' ELSE 'signed' END AS s, CASE c_custkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS t FROM customer))")
def environment_derive(spark, sf):
    k = F.col("c_custkey")
    rows = _t(spark, sf, "customer").select(
        k, F.when(k % 2 == 0, " lp64").otherwise("ilp32").alias("hardware_model"), F.when(k % 3 == 0, "64").otherwise("32").alias("time_t_size_bits"), F.when(k % 5 == 0, "Unsigned ").otherwise("signed").alias("time_t_signed"), F.when(k % 7 == 0, "Yes").when(k % 7 == 1, "no").alias("time64_functions_available"),
        F.when(k % 4 == 0, "true").when(k % 4 == 1, "false").otherwise("?").alias("d_time_bits_supported"), F.when(k % 4 < 2, "64").otherwise(" ").alias("d_time_bits_setting"), F.when(k % 6 == 0, "other").otherwise("musl").alias("c_library"), F.when(k % 6 == 0, "own").otherwise(" ").alias("c_library_other_text"),
    )
    return W.derive_environment(W.normalize_environment(rows)).select("c_custkey", "scenario_hint", "mitigation_path", "config_id", "summary")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 IN (10, 20, 31) THEN o_orderkey % 50 WHEN o_orderkey % 50 BETWEEN 8 AND 40 THEN o_orderkey % 50 WHEN o_orderkey % 50 <= 33 THEN 8 + greatest(o_orderkey % 50, 1) - 1 ELSE -1 END::INT AS focus, CASE WHEN o_orderkey % 50 <= 15 THEN 10 WHEN o_orderkey % 50 <= 25 THEN 20 ELSE 31 END::INT AS nearest FROM orders")
def focus_lines(spark, sf):
    lines = F.array(*map(F.lit, (10, 20, 31)))
    at = F.col("o_orderkey") % 50
    return _t(spark, sf, "orders").select("o_orderkey", F.coalesce(N.focus_line(at, lines, F.lit(8), F.lit(40)), F.lit(-1)).alias("focus"), N.nearest_line(lines, at.cast("int")).alias("nearest"))


@query("SELECT 'fn' || c_custkey || '#' || i AS finding_id, CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE 't' || i END AS issue_type, CASE WHEN c_custkey % 4 = 0 THEN 12 WHEN i = 0 THEN 12 ELSE 20 END::INT AS line, 12::INT AS start_line, 20::INT AS end_line FROM customer, (VALUES (0), (1)) v(i) WHERE c_custkey % 4 > 0 OR i = 0")
def issue_findings(spark, sf):
    k = F.col("c_custkey")
    none = F.lit("b")
    issues = F.array(*[F.struct(F.lit(f"t{i}").alias("type"), F.lit(n).alias("line"), none.alias("description")) for i, n in ((0, 3), (1, 19))])
    rows = _t(spark, sf, "customer").select(F.concat(F.lit("fn"), k.cast("string")).alias("function_id"), F.lit("f.c").alias("path"), F.lit(10).alias("start_line"), F.lit(30).alias("end_line"), F.array(F.lit(12), F.lit(20)).alias("candidate_lines"), F.lit("yes").alias("verdict"), F.lit(0.5).alias("confidence"), F.when(k % 4 != 0, issues).alias("issues"))
    return N.to_findings(rows).select("finding_id", "issue_type", "line", "start_line", "end_line")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
v AS (SELECT a.source, a.i, b.i AS j, b.n > 1000 OR a.n > 1000 OR b.i - a.i >= CASE WHEN a.n > 500 OR max(b.n) OVER w > 500 THEN 50 ELSE 100 END OR a.n + sum(b.n) OVER w > 50000 AS bad
 FROM d a JOIN d b ON a.source IS NOT DISTINCT FROM b.source AND b.i BETWEEN a.i + 1 AND a.i + 100 WINDOW w AS (PARTITION BY a.source, a.i ORDER BY b.i)),
nx AS (SELECT source, i, min(j) AS nxt FROM v WHERE bad GROUP BY ALL),
s AS (SELECT source, i, i AS begun FROM d WHERE i = 1 UNION ALL SELECT s.source, nxt, nxt FROM s JOIN nx ON s.source IS NOT DISTINCT FROM nx.source AND s.i = nx.i)
SELECT d.source, d.doc_id, (count(s.begun) OVER (PARTITION BY d.source ORDER BY d.i) - 1)::INT AS batch FROM d LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source AND d.i = s.i""")
def adaptive_batches(spark, sf):
    return N.adaptive_batches(_t(spark, sf, "documents"), "source", "doc_id", "text")


@query("SELECT 'k' || user_id AS key, arg_max(event_type, ts) AS value FROM events WHERE ts > TIMESTAMP '2024-01-15' - INTERVAL 10 DAY AND user_id % 3 = 0 GROUP BY user_id  -- the other users' keys are not in the cache")
def cache_read(spark, sf):
    rows = _t(spark, sf, "events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), "ts", "user_id")
    asked = rows.select(F.when(F.col("user_id") % 3 == 0, F.col("key")).otherwise(F.concat(F.lit("absent"), "key")).alias("key")).distinct()
    return Z.cache_read(rows.drop("user_id"), asked, F.lit("2024-01-15").cast("timestamp_ntz"), 10)


@query("SELECT event_id AS run_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50")
def newest_runs(spark, sf):
    rows = _t(spark, sf, "events").select(F.col("event_id").alias("run_id"), "ts")
    return Z.newest_runs(rows.filter("run_id % 2 = 0"), rows.filter("run_id % 2 = 1"))


@query(f"WITH {_RULES}, d AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'time_t' ELSE 'a' || n_nationkey END AS symbol FROM nation) SELECT symbol, false AS type_use_only FROM rules UNION ALL SELECT symbol, symbol = 'time_t' FROM d")
def merged_rules(spark, sf):
    found = _t(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 5 == 0, "time_t").otherwise(F.concat(F.lit("a"), F.col("n_nationkey").cast("string"))).alias("symbol"), F.lit(False).alias("type_use_only"))
    return Z.merge_catalog(M.default_rules(spark), found).select("symbol", "type_use_only")


@query("SELECT conv_id AS batch, count(*) AS n, count_if(role = 'user')::BIGINT AS n_yes, sum(strlen(text))::BIGINT AS bytes, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id")
def batch_digest(spark, sf):
    rows = _t(spark, sf, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"), F.col("text").alias("body"), F.when(F.col("role") == "user", "yes").otherwise("no").alias("verdict"))
    return Z.batch_digest(rows)


@query("SELECT event_type AS stage, sum(user_id)::BIGINT AS prompt_tokens, sum(event_id % 7)::BIGINT AS completion_tokens, sum(user_id + event_id % 7)::BIGINT AS total_tokens FROM events GROUP BY ROLLUP (event_type)")
def token_usage(spark, sf):
    return Z.usage(_t(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("prompt_tokens"), (F.col("event_id") % 7).cast("string").alias("completion_tokens")))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'lp64_signed_64bit' WHEN s_suppkey % 2 = 0 THEN 'ilp32_signed_32bit' ELSE 'lp64_signed_32bit' END AS config_id, CASE WHEN s_suppkey % 3 = 0 THEN 'explicit' WHEN s_suppkey % 2 = 0 THEN 'detected' ELSE 'fallback' END AS source FROM supplier")
def effective_config(spark, sf):
    k = F.col("s_suppkey")
    chosen = E.effective_config(F.when(k % 3 == 0, "lp64_signed_64bit"), F.lit("ilp32_signed_32bit"), F.when(k % 2 == 0, 0.8).otherwise(0.6), F.lit("lp64_signed_32bit"))
    return _t(spark, sf, "supplier").select("s_suppkey", chosen.alias("c")).select("s_suppkey", "c.config_id", "c.source")


@query("SELECT conv_id AS batch, turn AS pos, CASE WHEN turn % 4 = 3 THEN 'abstain' WHEN turn % 4 = 2 THEN 'no' WHEN conv_id % 2 = 0 THEN 'yes' ELSE 'abstain' END AS verdict, CASE WHEN turn % 4 = 3 THEN 0.0 WHEN turn % 4 = 2 THEN 1.0 WHEN conv_id % 2 = 0 THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence, CASE WHEN turn % 4 = 3 THEN 'no valid answer' ELSE 'r' END AS reason FROM conversations")
def positional_answers(spark, sf):
    asked = _t(spark, sf, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"))
    turn = F.col("pos") % 4
    answers = asked.select("batch", "pos", F.when(turn == 3, "what").when(turn == 2, "No").otherwise("yes").alias("summary"), F.when(turn == 2, 7.0).when(F.col("batch") % 2 == 0, 0.8).otherwise(0.3).alias("confidence"), F.lit(" r ").alias("reason"))
    return Q.positional_answers(asked, answers, 0.5)


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS text FROM documents")
def response_texts(spark, sf):
    bodies = ['{"choices":[{"message":{"content":"a"},"finish_reason":"stop"}]}', '{"response":"b"}', '{"content":[{"text":"c"}]}', '{"choices":[{"message":{"content":"a"},"finish_reason":"length"}]}', "{}"]
    return _t(spark, sf, "documents").select("doc_id", Q.response_text(F.get(F.array(*map(F.lit, bodies)), (F.col("doc_id") % 5).cast("int"))).alias("text"))


@query(f"WITH {_LINES} SELECT path, regexp_matches(left(string_agg(text, chr(10) ORDER BY line), 8192), '(?i)\\b({'|'.join(B.RAW)})\\s*\\(') AS mentions FROM lines GROUP BY path")
def io_prefilter(spark, sf):
    files = synthetic_lines(spark, sf).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return files.select("path", Q.mentions_io(F.col("content"), B.RAW).alias("mentions"))


@query()
def function_payloads(spark, sf):
    spans = C.batches(C.function_candidates(_evidence(spark, sf)), 15).select("function_id", "path", F.lit(1).alias("start_line"), F.lit(20).alias("end_line"), "candidate_lines", F.lit("body </script>").alias("body"), F.concat_ws("#", "path", F.col("batch").cast("string")).alias("batch"))
    return Q.function_payload(spans)


# ---- more of the engine: paths, documents, records, batches, answers


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'src/a.c' WHEN 1 THEN 'b.h' WHEN 2 THEN '/other/root/c.CPP' ELSE '.' END AS relative, CASE s_suppkey % 4 WHEN 0 THEN 'root/src/a.c' WHEN 1 THEN 'root/b.h' WHEN 2 THEN 'c.CPP' ELSE 'root' END AS display, s_suppkey % 4 <> 2 AS within, s_suppkey % 4 = 1 AS header, s_suppkey % 4 IN (0, 2) AS implementation FROM supplier")
def path_names(spark, sf):
    path = F.get(F.array(*map(F.lit, ("/data/root/src/a.c", "/data/root/b.h", "/other/root/c.CPP", "/data/root"))), (F.col("s_suppkey") % 4).cast("int"))
    rows = _t(spark, sf, "supplier").select("s_suppkey", path.alias("p"))
    p = F.col("p")
    return rows.select("s_suppkey", H.relative(p, "/data/root").alias("relative"), H.display(p, "/data").alias("display"), H.is_within(p, "/data/root").alias("within"), H.is_header(p).alias("header"), H.is_implementation(p).alias("implementation"))


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'api.host.com' WHEN 1 THEN '127.0.0.1' WHEN 2 THEN 'host.com' WHEN 3 THEN 'evilhost.com' ELSE 'evil.example' END AS host, s_suppkey % 5 IN (0, 2) AS own FROM supplier")
def host_names(spark, sf):
    url = F.get(F.array(*map(F.lit, ("https://API.host.com:443/v1", "127.0.0.1:11434", "host.com.", "http://evilhost.com/host.com", "https://host.com@evil.example/x"))), (F.col("s_suppkey") % 5).cast("int"))
    return _t(spark, sf, "supplier").select("s_suppkey", H.host_of(url).alias("host"), H.is_host_or_subdomain(url, "host.com").alias("own"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE -1 END::INT AS major, CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 10 ELSE -1 END::INT AS minor, event_id % 6 IN (0, 1, 3) AS assessed FROM events")
def schema_versions(spark, sf):
    text = F.get(F.array(*map(F.lit, ("1.2", " 2 ", "1.0-rc.1", "3.10.4+build", "x.1", ""))), (F.col("event_id") % 6).cast("int"))
    return _t(spark, sf, "events").select("event_id", F.coalesce(K.schema_version(text)["major"], F.lit(-1)).alias("major"), F.coalesce(K.schema_version(text)["minor"], F.lit(-1)).alias("minor"), K.supports_assessments(text).alias("assessed"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN m || '_' || s || '_' || b || 'bit' END AS config_id, CASE WHEN p_partkey % 3 < 2 THEN upper(m) || '-' || b || 'bit-' || s || '-time64_unknown' END AS hint, CASE WHEN p_partkey % 3 < 2 AND b = 32 THEN 'upgrade_env' END AS way, p_partkey % 3 < 2 AND b = 32 AS overflow, p_partkey % 3 < 2 AND b = 64 AS narrowing FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ilp32' ELSE 'lp64' END AS m, CASE WHEN p_partkey % 5 = 0 THEN 'unsigned' ELSE 'signed' END AS s, CASE WHEN p_partkey % 7 < 3 THEN 32 ELSE 64 END AS b FROM part)")
def config_expand(spark, sf):
    k = F.col("p_partkey")
    cid = F.concat(F.when(k % 2 == 0, "ILP32").otherwise("lp64"), F.lit("_"), F.when(k % 5 == 0, "unsigned").otherwise("signed"), F.lit("_"), F.when(k % 7 < 3, "32").otherwise("64"), F.when(k % 3 < 2, "bit ").otherwise("bits"))
    rows = _t(spark, sf, "part").select("p_partkey", K.expand_config_id(cid).alias("e"))
    return rows.select("p_partkey", "e.config_id", F.col("e.scenario_hint").alias("hint"), F.col("e.mitigation_path").alias("way"), F.coalesce(K.is_overflow_risk(F.col("e.time_t_size_bits")), F.lit(False)).alias("overflow"), F.coalesce(K.is_narrowing_only(F.col("e.time_t_size_bits")), F.lit(False)).alias("narrowing"))


_BUILD = "b AS (SELECT s_suppkey AS project, CASE s_suppkey % 4 WHEN 0 THEN ['-m32', '-O2'] WHEN 1 THEN ['-D_TIME_BITS=64', '-march=armv7', '-march=armv7-a'] WHEN 2 THEN ['-Wall'] ELSE [] END AS flags, CASE s_suppkey % 4 WHEN 0 THEN 'aarch64-linux-gnu' WHEN 2 THEN 'x86_64-linux' END AS tool, CASE WHEN s_suppkey % 4 = 3 THEN 'none' ELSE 'makefile' END AS source FROM supplier)"


def _projects(spark, sf) -> DataFrame:
    """Build files of one project for each supplier, and a project without any for every fourth."""
    k = F.col("s_suppkey")
    flags = F.when(k % 4 == 0, "-m32 -O2").when(k % 4 == 1, "-march=armv7-a -D_TIME_BITS=64").otherwise("-Wall")
    tool = F.when(k % 4 == 0, "aarch64-linux-gnu-gcc").when(k % 4 == 2, "x86_64-linux-gcc").otherwise("")
    text = F.concat(F.lit("CC := "), tool, F.lit("\nCFLAGS += "), flags, F.lit("  # more\nall:\n\tcc x.c\n"))
    files = _t(spark, sf, "supplier").select(k.alias("project"), F.when(k % 4 == 3, "notes.txt").when(k % 4 == 2, "src/deep/Makefile").otherwise("Makefile").alias("path"), text.alias("content"))
    return E.project_info(files, files)


@query(f"WITH {_BUILD} SELECT project, array_to_string(list_sort(flags), ' ') AS flags, tool AS toolchain, source FROM b")
def build_facts(spark, sf):
    return _projects(spark, sf).select("project", F.array_join("flags", " ").alias("flags"), "toolchain", "source")


_FOUND = f"""{_BUILD}, f AS (SELECT project, CASE project % 4 WHEN 0 THEN 'ILP32' WHEN 1 THEN 'ILP32' WHEN 2 THEN 'LP64' END AS architecture, CASE project % 4 WHEN 0 THEN 0.855 WHEN 1 THEN 0.85 WHEN 2 THEN 0.9 ELSE 0 END::DOUBLE AS arch_conf, CASE project % 4 WHEN 0 THEN 32 WHEN 1 THEN 64 WHEN 2 THEN 64 ELSE 0 END::INT AS bits, CASE project % 4 WHEN 0 THEN 0.65 WHEN 1 THEN 0.95 WHEN 2 THEN 0.7 ELSE 0 END::DOUBLE AS bits_conf, 'signed' AS sign, 0.5::DOUBLE AS sign_conf FROM b)"""


@query(f"WITH {_FOUND} SELECT * FROM f")
def config_detection(spark, sf):
    return E.detect(_projects(spark, sf)).select("project", "architecture", "arch_conf", F.coalesce("bits", F.lit(0)).alias("bits"), "bits_conf", "sign", "sign_conf")


@query(f"WITH {_FOUND} SELECT project, 'keyword-based' AS method, CASE project % 4 WHEN 0 THEN 'ilp32_signed_32bit' WHEN 1 THEN 'ilp32_signed_64bit' WHEN 2 THEN 'lp64_signed_64bit' ELSE 'ilp32_signed_32bit' END AS config_id FROM f")
def config_hybrid(spark, sf):
    return E.hybrid(spark, _projects(spark, sf)).select("project", "method", "config_id")


@query("SELECT 'github__own__r' || s_suppkey || '__default' AS repo_key, CASE s_suppkey % 4 WHEN 0 THEN 'dev' WHEN 1 THEN 'main' WHEN 2 THEN 'HEAD' END AS resolved_ref, CASE s_suppkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS resolved_sha FROM supplier")
def ref_choice(spark, sf):
    k = F.col("s_suppkey")
    repos = _t(spark, sf, "supplier").select(F.concat(F.lit("github__own__r"), k.cast("string"), F.lit("__default")).alias("repo_key"), F.when(k % 4 == 0, "dev").when(k % 4 == 3, "gone").alias("ref"), k)
    every = F.array(*[F.struct(F.lit(r).alias("ref"), F.lit(s).alias("sha")) for r, s in (("origin/main", "b"), ("origin/master", "d"), ("origin/dev", "a"), ("origin/HEAD", "c"))])
    refs = repos.select("repo_key", F.inline(F.slice(every, 1, F.when(k % 4 == 2, 4).otherwise(3))))
    return T.pick_ref(repos.drop("s_suppkey"), refs).select("repo_key", "resolved_ref", "resolved_sha")


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'R' THEN 'failed' ELSE 'timeout' END AS status, CASE WHEN l_linenumber % 2 = 0 THEN 'detected' ELSE 'fallback' END AS config_source, count(*) AS repos, sum(l_linenumber)::BIGINT AS total_files, sum(l_suppkey)::BIGINT AS total_lines, max(l_partkey)::BIGINT AS max_line_length, sum(l_linenumber)::BIGINT AS candidates, sum(CASE WHEN l_linenumber > 3 THEN l_linenumber END)::BIGINT AS io_candidates, sum(l_suppkey)::BIGINT AS total_tokens, grouping(CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'R' THEN 'failed' ELSE 'timeout' END, CASE WHEN l_linenumber % 2 = 0 THEN 'detected' ELSE 'fallback' END)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (1, 2)")
def batch_totals(spark, sf):
    c = F.col
    meta = F.to_json(F.struct(F.struct(c("l_linenumber").alias("total_files"), c("l_suppkey").alias("total_lines"), c("l_partkey").alias("max_line_length")).alias("metrics")))
    stats = F.to_json(F.struct(F.struct(c("l_linenumber").alias("candidates")).alias("ir"), F.struct(F.when(c("l_linenumber") > 3, c("l_linenumber")).alias("candidates")).alias("io_boundary"), F.struct(c("l_suppkey").alias("total_tokens")).alias("llm")))
    rows = _t(spark, sf, "lineitem").select(F.when(c("l_returnflag") == "A", "success").when(c("l_returnflag") == "R", "failed").otherwise("timeout").alias("status"), F.when(c("l_linenumber") % 2 == 0, "detected").otherwise("fallback").alias("config_source"), T.scan_metrics(meta).alias("metrics"), T.stage_counts(stats).alias("stages"))
    return T.batch_summary(rows)


@query("SELECT 'r' || o_custkey AS repo_key, count(*) AS total_findings, count_if(o_orderstatus = 'O')::BIGINT AS yes_findings, count_if(o_orderstatus = 'F')::BIGINT AS no_findings, count_if(o_orderstatus = 'P')::BIGINT AS abstain_findings FROM orders GROUP BY o_custkey")
def repo_findings(spark, sf):
    status = F.col("o_orderstatus")
    rows = _t(spark, sf, "orders").select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repo_key"), F.when(status == "O", " Yes").when(status == "F", "no").otherwise("ABSTAIN").alias("y2038_issue"))
    return T.findings_summary(rows)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'count' WHEN 2 THEN 'risk' WHEN 3 THEN 'no matches' WHEN 4 THEN NULL WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'unequal methods' WHEN 7 THEN 'symbols' ELSE 'no risk' END AS problem, CASE WHEN l_partkey % 9 = 0 THEN 'a,b' WHEN l_partkey % 9 = 4 THEN 's' END AS symbols FROM lineitem")
def record_forms(spark, sf):
    c = F.col
    kind = c("l_partkey") % 9
    none = lambda t: F.lit(None).cast(t)
    one = lambda s, r: F.struct(F.lit(s).alias("symbol"), F.lit(r).alias("risk"), F.lit("x\r\ny").alias("description"), F.lit("catalog_symbol_match").alias("discovery_method"), F.lit(" ").alias("rule_id"), none("int").alias("line"), F.lit(1).alias("col_start"), F.lit(2).alias("col_end"))
    matches = F.when(kind.isin(0, 1, 2, 7), F.array(one("b", "low"), one("a", "high"))).when(kind == 3, F.array().cast(f"array<struct<{I.MATCH}>>"))
    symbols = F.when(kind == 4, F.array(F.lit("s"))).when(kind.isin(5, 6), F.array(F.lit("s"), F.lit("t"))).when(kind == 7, F.array(F.lit("b"), F.lit("a"))).when(kind == 8, F.array(F.lit("s")))
    rows = _t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("f.c").alias("file"), c("l_linenumber").cast("int").alias("line"), F.lit("t").alias("lineText"), none("string").alias("one_line_snippet"), none("string").alias("symbol"), symbols.alias("symbols"), none("string").alias("discovery_method"),
        F.when(kind == 6, F.array(F.lit("m"))).alias("discovery_methods"), none("string").alias("rule_id"), none("array<string>").alias("rule_ids"), F.when(kind.isin(4, 5, 6), "high").alias("risk"), none("string").alias("description"), none("int").alias("col_start"), none("int").alias("col_end"),
        matches.cast(f"array<struct<{I.MATCH}>>").alias("matches"), F.when(kind == 1, 5).when(kind == 0, 2).alias("match_count"), F.when(kind == 2, "low").when(kind == 0, "high").alias("line_max_risk"),
    )
    judged = I.judge_records(rows)
    return judged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "problem", F.when(c("problem").isNull(), F.array_join(F.transform("all_matches", lambda m: m["symbol"]), ",")).alias("symbols"))


@query(f"WITH {_MATCH} SELECT path AS file, line, string_agg(symbol, ',' ORDER BY symbol) AS symbols, count(*)::INT AS match_count, arg_max(risk, {_RANK}) AS line_max_risk FROM m GROUP BY path, line")
def record_rows(spark, sf):
    none = F.lit(None).cast("int")
    made = I.write_form(_matches(spark, sf).withColumns({"col_start": none, "col_end": none}))
    return made.select("file", "line", F.array_join(F.transform("matches", lambda m: m["symbol"]), ",").alias("symbols"), "match_count", "line_max_risk")


@query("SELECT conv_id || ':' || turn AS candidate_id, CASE WHEN conv_id % 3 = 1 OR turn % 4 IN (2, 3) THEN 'abstain' WHEN turn % 4 = 1 THEN 'no' WHEN conv_id % 2 = 0 THEN 'yes' ELSE 'abstain' END AS verdict, CASE WHEN conv_id % 3 = 1 OR turn % 4 IN (2, 3) THEN 0.0 WHEN turn % 4 = 1 THEN 1.0 WHEN conv_id % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN conv_id % 3 = 1 THEN 'LLM response is not a JSON array' WHEN turn % 4 IN (2, 3) THEN 'Model item failed validation' WHEN turn % 4 = 0 AND conv_id % 2 = 1 THEN 'r (low confidence: 0.50, using abstain to avoid false positive)' ELSE 'r' END AS reason FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def line_answers(spark, sf):
    """An answer for each conversation, with an item for each of its turns."""
    asked = _t(spark, sf, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").cast("int").alias("pos")).distinct()
    item = F.when(F.col("pos") % 4 == 0, F.concat(F.lit('{"id": "a", "y2038_issue": "yes", "reason": "r", "confidence": '), F.when(F.col("batch") % 2 == 0, "0.9").otherwise("0.5"), F.lit("}"))).when(F.col("pos") % 4 == 1, '{"id": "a", "y2038_issue": "no", "confidence": 1, "reason": "r", "severity": null}').when(F.col("pos") % 4 == 2, '{"id": "a", "y2038_issue": "no", "confidence": 7, "reason": "r"}').otherwise('{"id": "a", "y2038_issue": "maybe", "confidence": 0.5, "reason": "r"}')
    whole = asked.groupBy("batch").agg(F.max("pos").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("pos", item.alias("j"))))).alias("items"))
    body = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), "n"), lambda i: F.coalesce(F.element_at("items", i), F.lit("0"))), ","), F.lit("]"))
    answers = whole.select("batch", X.strip_fence(F.when(F.col("batch") % 3 == 1, '{"no": "array"}').otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))).alias("text"))
    return O.line_answers(asked.withColumn("candidate_id", F.concat_ws(":", F.col("batch").cast("string"), F.col("pos").cast("string"))), answers)


_ITEMS = """it AS (SELECT c_custkey AS k, c_custkey % 8 AS kind FROM customer), al AS (SELECT 'fn' || k AS function_id, CASE WHEN kind IN (0, 6) THEN 'completed' ELSE 'analysis_error' END AS status, CASE kind WHEN 1 THEN 'duplicate_function_id' WHEN 2 THEN 'invalid_result_schema' WHEN 3 THEN 'missing_expected_result' WHEN 4 THEN 'missing_expected_result' WHEN 5 THEN 'missing_expected_result' WHEN 7 THEN 'invalid_result_schema' END AS issue_type, CASE kind WHEN 0 THEN 'yes' WHEN 6 THEN 'no' ELSE 'abstain' END AS summary, CASE kind WHEN 0 THEN 0.5 WHEN 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM it)"""


def _items(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A function for each customer and the judged items of an answer about it."""
    k = F.col("c_custkey")
    name = F.concat(F.lit('"fn'), k.cast("string"), F.lit('"'))
    tail = F.lit(', "issues": [{"type": "t", "line": 4.0, "description": "d"}], "needs_more_context": false, "needs": ["macros"], "y2106_summary": "no", "issue_type": "y2038"}')
    good = lambda summary, confidence: F.concat(F.lit('{"function_id": '), name, F.lit(f', "y2038_summary": "{summary}", "confidence": {confidence}'), tail)
    kind = k % 8
    body = (
        F.when(kind == 0, good("yes", "0.5")).when(kind == 1, F.concat(good("yes", "0.5"), F.lit(", "), good("no", "2"))).when(kind == 2, good("Yes", "0.5")).when(kind == 3, "").when(kind == 4, '{"y2038_summary": "yes"}, 3')
        .when(kind == 5, '{"function_id": 7}, {"function_id": "other"}').when(kind == 6, good("no", "1")).otherwise(F.replace(good("no", "1"), F.lit("4.0"), F.lit("true")))
    )
    rows = _t(spark, sf, "customer").select(k, F.concat(F.lit("["), body, F.lit("]")).alias("body"))
    requests = rows.select(F.concat(F.lit("fn"), k.cast("string")).alias("function_id"), F.lit(3).alias("start_line"))
    return requests, W.judge_items(W.parse_items(rows), True).filter("item is not null")


@query(f"WITH {_ITEMS} SELECT * FROM al")
def item_alignment(spark, sf):
    return A.align_items(*_items(spark, sf)).select("function_id", "status", "issue_type", "summary", "confidence")


@query(f"WITH {_ITEMS} SELECT count_if(kind = 5)::BIGINT AS unknown_function_id, count_if(kind = 1)::BIGINT AS duplicate_function_id, count_if(kind = 4)::BIGINT AS missing_function_id, (count_if(kind = 4) + count_if(kind = 5))::BIGINT AS invalid_item FROM it")
def item_diagnostics(spark, sf):
    """Ids that no function has are counted for each item; all of these are the same one, so it also occurs more than once."""
    requests, items = _items(spark, sf)
    other = F.when(F.col("function_id") == "other", F.concat(F.col("function_id"), F.col("c_custkey").cast("string"))).otherwise(F.col("function_id"))
    return A.item_diagnostics(requests, items.withColumn("function_id", other))


@query(f"WITH {_ITEMS} SELECT count_if(summary = 'yes' AND status = 'completed')::BIGINT AS yes, count_if(summary = 'no' AND status = 'completed')::BIGINT AS no, 0::BIGINT AS abstain, count_if(status <> 'completed')::BIGINT AS analysis_errors, count(*) AS total FROM al")
def execution_counts(spark, sf):
    return A.counts_by_execution(A.align_items(*_items(spark, sf)))


_VERDICTS = "f AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS finding_id, 'fn' || l_orderkey AS function_id, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'abstain' END AS verdict, l_linenumber AS line FROM lineitem)"


def _verdicts(spark, sf) -> DataFrame:
    c = F.col
    s = lambda n: c(n).cast("string")
    return _t(spark, sf, "lineitem").select(F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")).alias("finding_id"), F.concat(F.lit("fn"), s("l_orderkey")).alias("function_id"), F.when(c("l_returnflag") == "A", "yes").when(c("l_returnflag") == "R", "no").otherwise("abstain").alias("verdict"), c("l_linenumber").alias("line"), F.lit("p").alias("path"))


@query(f"WITH {_VERDICTS} SELECT count_if(verdict = 'yes')::BIGINT AS yes, count_if(verdict = 'no')::BIGINT AS no, count_if(verdict = 'abstain')::BIGINT AS abstain, count(*) AS total FROM f")
def finding_counts(spark, sf):
    return A.finding_counts(_verdicts(spark, sf))


@query(f"WITH {_VERDICTS}, g AS (SELECT function_id, arg_min(verdict, finding_id) AS verdict FROM f GROUP BY function_id) SELECT count_if(verdict = 'yes')::BIGINT AS yes, count_if(verdict = 'no')::BIGINT AS no, count_if(verdict = 'abstain')::BIGINT AS abstain, count(*) AS total FROM g")
def function_counts(spark, sf):
    return A.function_counts(_verdicts(spark, sf))


@query(f"WITH {_VERDICTS} SELECT finding_id, CASE WHEN verdict = 'yes' THEN 'yes' WHEN line % 3 = 0 THEN 'yes(y2106)' WHEN line % 3 = 1 AND CAST(substr(function_id, 3) AS BIGINT) % 2 = 0 THEN 'analysis_error' ELSE verdict END AS shown_class FROM f")
def shown_classes(spark, sf):
    rows = _verdicts(spark, sf).select("finding_id", F.when(F.col("line") % 3 == 1, F.col("function_id")).alias("function_id"), F.col("verdict").alias("issue_class"), F.when(F.col("line") % 3 == 0, "yes").alias("y2106_issue"))
    statuses = _t(spark, sf, "orders").select(F.concat(F.lit("fn"), F.col("o_orderkey").cast("string")).alias("function_id"), F.when(F.col("o_orderkey") % 2 == 0, "analysis_error").otherwise("completed").alias("execution_status"))
    return R.display_class(rows, A.statuses(statuses)).select("finding_id", "shown_class")


@query(f"WITH {_RAW} SELECT row_number() OVER (ORDER BY {_ORDERS['risk']}) AS rank, finding_id, file, rule_id FROM n")
def report_numbers(spark, sf):
    from .session import ensure_checkpoints

    ensure_checkpoints(spark)
    return R.numbered(_findings(spark, sf), "risk").select(F.col("rank").cast("long").alias("rank"), "finding_id", "file", "rule_id")


_DOCS = "d AS (SELECT c_custkey AS doc, c_custkey % 5 AS n, c_custkey % 3 = 0 AS given FROM customer)"


def _documents(spark, sf) -> DataFrame:
    """A result document for each customer, with counts in its meta for every third."""
    k = F.col("c_custkey")
    n = (k % 5).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    candidates = F.transform(numbers, lambda i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("candidate_id"), F.when(i % 2 == 0, "f").alias("function_id"), F.when(i % 2 == 0, "grouped").otherwise("ungrouped").alias("analysis_coverage")))
    assessments = F.transform(numbers, lambda i: F.struct(F.when(i == 1, "analysis_error").when(i == 2, "not_requested").otherwise("completed").alias("execution_status"), F.when(i == 3, "yes").otherwise("abstain").alias("verdict")))
    meta = F.when(k % 3 == 0, '{"analysis_status": "complete", "candidate_summary": {"total": 9, "grouped": 4, "ungrouped": 5, "functions_with_candidates": 2}, "assessment_summary": {"total": 7, "completed": 6, "yes": 1}}').otherwise("{}")
    return _t(spark, sf, "customer").select(k.alias("doc"), meta.alias("meta"), candidates.alias("candidates"), assessments.alias("assessments"), numbers.alias("findings"))


@query(f"WITH {_DOCS} SELECT doc, CASE WHEN given THEN 9 ELSE n END::BIGINT AS total, CASE WHEN given THEN 4 ELSE n // 2 END::BIGINT AS grouped, CASE WHEN given THEN 5 ELSE n - n // 2 END::BIGINT AS ungrouped, CASE WHEN given THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END::BIGINT AS functions_with_candidates, n::BIGINT AS findings FROM d")
def document_candidates(spark, sf):
    return R.candidate_counts(_documents(spark, sf))


@query(f"WITH {_DOCS} SELECT doc, CASE WHEN given THEN 7 ELSE n END::BIGINT AS total, CASE WHEN given THEN 6 ELSE greatest(n - 2, 0) END::BIGINT AS completed, CASE WHEN given OR n >= 3 THEN 1 ELSE 0 END::BIGINT AS yes, 0::BIGINT AS no, CASE WHEN given THEN 0 WHEN n >= 4 THEN 1 ELSE 0 END::BIGINT AS abstain, CASE WHEN given THEN 0 WHEN n >= 1 THEN 1 ELSE 0 END::BIGINT AS analysis_errors, CASE WHEN given THEN 0 WHEN n >= 2 THEN 1 ELSE 0 END::BIGINT AS not_requested, CASE WHEN given THEN 'complete' END AS analysis_status FROM d")
def document_assessments(spark, sf):
    return R.assessment_counts(_documents(spark, sf))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'No findings match the selected filters.' WHEN 1 THEN 'No deterministic candidates were found.' WHEN 2 THEN 'No model-retained findings were produced; 7 deterministic candidates were recorded for review.' WHEN 3 THEN '7 deterministic candidates were recorded, including 2 candidates not grouped into a recognized function.' ELSE '7 deterministic candidates were recorded.' END AS message FROM orders")
def empty_messages(spark, sf):
    k = F.col("o_orderkey") % 5
    message = R.empty_message(F.when(k == 1, 0).otherwise(7), F.when(k == 3, 2).otherwise(0), F.when(k < 3, 0).otherwise(4), k > 0)
    return _t(spark, sf, "orders").select("o_orderkey", message.alias("message"))


@query("SELECT 'sym' || (p_partkey % 150) AS symbol, min(p_partkey) AS pos, CASE max(CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk, arg_min('d' || p_partkey, p_partkey) FILTER (p_partkey % 4 > 0) AS description, count(*) AS n_rows, bool_or(p_partkey % 5 = 0) AS linux FROM part GROUP BY p_partkey % 150")
def rule_consolidation(spark, sf):
    k = F.col("p_partkey")
    rules = _t(spark, sf, "part").select(k.alias("pos"), F.concat(F.lit("sym"), (k % 150).cast("string")).alias("symbol"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("risk"), F.when(k % 4 > 0, F.concat(F.lit("d"), k.cast("string"))).otherwise(" ").alias("description"), F.create_map(F.lit("linux"), k % 5 == 0, F.lit("bsd"), F.lit(None).cast("boolean")).alias("os_support"))
    found = Z.consolidated_rules(rules)
    return found.select("symbol", "pos", "risk", "description", "n_rows", F.element_at("os_support", F.lit("linux")).alias("linux"))


@query(f"WITH {_UNITED}, t AS (SELECT DISTINCT path || ':' || line AS response_id, path, line FROM cand) SELECT response_id, min(candidate_id) AS candidate_id FROM t JOIN cand USING (path, line) GROUP BY response_id")
def place_lookup(spark, sf):
    ensure_checkpoints(spark)
    found = _scan(spark, sf).candidates.select("candidate_id", "path", "line").checkpoint()
    asked = found.select(F.concat_ws(":", F.regexp_replace("path", "/", "\\\\"), F.col("line").cast("string")).alias("r")).distinct()
    both = C.find_by_place(asked.withColumnRenamed("r", "response_id"), found)
    return both.select(F.replace(F.col("response_id"), F.lit("\\"), F.lit("/")).alias("response_id"), "candidate_id")


@query("SELECT s_suppkey AS key, s_suppkey % 3 <> 0 AS fresh, CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE 'new' END AS value FROM supplier")
def cache_update(spark, sf):
    k = F.col("s_suppkey")
    rows = _t(spark, sf, "supplier").select(k.alias("key"))
    old = rows.select("key", F.lit("old").alias("value"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    new = rows.filter("key % 3 <> 0").select("key", F.lit("new").alias("value"))
    found = Z.cache_write(old, new, F.lit("2024-02-01").cast("timestamp_ntz"))
    return found.select("key", (F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz")).alias("fresh"), "value")


@query("SELECT conv_id AS batch, count(*) AS response_item_count, (sum(strlen(text)) + count(*) - 1)::BIGINT AS response_bytes, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS response_sha256, count_if(role = 'user')::BIGINT AS n_yes FROM conversations GROUP BY conv_id")
def batch_outputs(spark, sf):
    rows = _t(spark, sf, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"), F.lit("f").alias("function_id"), F.lit("completed").alias("status"), F.when(F.col("role") == "user", "yes").otherwise("no").alias("summary"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("issues"), F.col("text").alias("body"))
    found = Z.batch_outputs(rows)
    return found.select("batch", "response_item_count", F.col("response_bytes").cast("long").alias("response_bytes"), "response_sha256", F.coalesce(F.element_at("summary_counts", F.lit("yes")), F.lit(0)).alias("n_yes"))


@query("SELECT o_custkey AS batch, sum(o_orderkey % 4)::BIGINT AS lines, max(o_orderkey % 4)::INT AS most, count_if(o_orderkey % 4 = 0)::BIGINT AS without FROM orders GROUP BY o_custkey")
def batch_lines(spark, sf):
    n = (F.col("o_orderkey") % 4).cast("int")
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")).alias("candidate_lines"))
    return Z.batch_stats(rows)


@query(f"WITH {_VERDICTS} SELECT finding_id, verdict FROM f WHERE verdict <> 'no' AND (verdict <> 'yes' OR line >= 4)")
def triage_survivors(spark, sf):
    rows = _verdicts(spark, sf).withColumn("confidence", F.col("line") / 10)
    return A.triage_survivors(rows, 0.4).select("finding_id", "verdict")


@query()
def block_contexts(spark, sf):
    """Each file's lines wrapped into functions; the block around every candidate."""
    lines = split_lines(_wrapped_files(spark, sf))
    return C.block_contexts(lines, scan(lines, M.default_rules(spark)).candidates)


def _wrapped_files(spark, sf) -> DataFrame:
    """The synthetic files with every thirty lines in a function."""
    block = F.floor((F.col("line") - 1) / 30).cast("int")
    body = synthetic_lines(spark, sf).groupBy("path", block.alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("body"))
    wrapped = F.concat(F.lit("static int fn"), F.col("b").cast("string"), F.lit("(time_t a, int b) {\n"), F.col("body"), F.lit("\n}\n"))
    return body.select("path", F.struct("b", wrapped.alias("t")).alias("s")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "").alias("content"))


@query()
def scan_documents(spark, sf):
    """The whole scan of the wrapped files, as one document for each of four repositories, in rows of bounded length: in order of section and key the texts of a repository are its document."""
    options = Options(migrate_to=_AFTER, abi=_BEFORE)
    run = scan_files(_wrapped_files(spark, sf), M.default_rules(spark), options)
    return document_parts(run, lambda path: F.concat(F.lit("repo"), (F.regexp_extract(path, r"(\d+)", 1).cast("int") % 4).cast("string")), options, timestamp="-")


@query(f"WITH {_CLEAN} SELECT path, line, text, clean FROM cl")
def range_lines(spark, sf):
    """The synthetic files, written as a tree by Spark, listed by tasks, and read by ranges of a kilobyte, so that most files are cut many times."""
    root = scratch_folder(spark, "tree")
    # As many files to a folder as a listing takes at once.
    folder = F.floor(F.regexp_extract("path", r"(\d+)", 1).cast("long") / 4096).cast("string")
    write_tree(synthetic_lines(spark, sf).select("path", "line", "text").withColumn("path", F.concat(folder, F.lit("/"), "path")), root)
    listed = list_tree(spark, root).filter(F.col("path").endswith(".c"))
    named = listed.select(F.regexp_replace("path", r"^\d+/", "").alias("path"), "uri", "length")
    return with_clean_ranges(read_ranges(named, size=1024)).select("path", "line", "text", "clean")


@query("""WITH p AS (SELECT coalesce(source, '_') AS d, printf('%012d', doc_id) AS k, '{"id":' || doc_id || ',"chars":' || length(coalesce(text, '')) || ',"lang":"' || coalesce(lang, '') || '"}' AS t FROM documents)
SELECT d AS document, count(*) AS n_items, strlen('[' || string_agg(t, ',' ORDER BY k) || ']') AS n_bytes, sha256('[' || string_agg(t, ',' ORDER BY k) || ']') AS sha256 FROM p GROUP BY d""")
def long_documents(spark, sf):
    """A JSON file for each source, written in fragments by many tasks, joined, and read back."""
    docs, path = _t(spark, sf, "documents"), scratch_folder(spark, "long")
    source = F.coalesce("source", F.lit("_"))
    text = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(',"chars":'), F.length(F.coalesce("text", F.lit(""))).cast("string"), F.lit(',"lang":"'), F.coalesce("lang", F.lit("")), F.lit('"}'))
    ends = docs.select(source.alias("s")).distinct()
    pieces = ends.select(*piece("s", 0, F.lit(""), F.lit("["))).unionByName(docs.select(*piece(source, 1, F.lpad(F.col("doc_id").cast("string"), 12, "0"), text, ","))).unionByName(ends.select(*piece("s", 2, F.lit(""), F.lit("]"))))
    written = write_long_documents(pieces, path).select("document", "file", "n_bytes")
    items = docs.groupBy(source.alias("document")).agg(F.count(F.lit(1)).alias("n_items"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    return written.join(files, "file").join(items, "document").select("document", "n_items", "n_bytes", "sha256")


@query("SELECT coalesce(lang, 'none') AS lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1")
def published_parts(spark, sf):
    """Documents published in two parts, one of which is published again and so replaced, read through the manifest."""
    docs, path = _t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), scratch_folder(spark, "runs")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    publish(spark, path, {"rows": docs.filter(even)}, part="a")
    publish(spark, path, {"rows": docs}, part="b")
    publish(spark, path, {"rows": docs.filter(~even)}, part="b")
    return published(spark, path, "rows").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("long").alias("n_chars"))


def _answer(prompt) -> dict:
    """A stand-in for a model: what it says follows from the length of a function, and from what it is told besides."""
    out = []
    for item in json.loads(prompt.user.split("\n", 1)[1])["items"]:
        kind = len(item["body"]) % 5
        says = "yes" if kind == 0 or kind == 1 and "context_additions" in item else "no" if kind == 2 and "file_context" in item else "abstain"
        if kind < 4:
            out.append({"function_id": item["function_id"], "y2038_summary": says, "confidence": 0.5, "issues": [], "needs_more_context": says == "abstain", "needs": ["macros"]})
    return {"text": json.dumps(out), "prompt_tokens": 0, "completion_tokens": 0}


@query("""WITH d AS (SELECT 'f' || doc_id AS function_id, length(coalesce(text, '')) % 5 AS k FROM documents)
SELECT function_id, CASE k WHEN 0 THEN '2a' WHEN 4 THEN '2a' WHEN 1 THEN '2b' ELSE '9' END AS pass, CASE WHEN k = 4 THEN 'analysis_error' ELSE 'completed' END AS status, CASE k WHEN 0 THEN 'yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE 'abstain' END AS summary FROM d""")
def judged_passes(spark, sf):
    """Texts as functions of files, judged in three passes, each of which takes what the one before left open."""
    docs = _t(spark, sf, "documents").select(F.concat(F.lit("f"), "doc_id").alias("function_id"), F.concat(F.lit("d"), (F.col("doc_id") / 8).cast("long").cast("string"), F.lit(".c")).alias("path"), F.coalesce("text", F.lit("")).alias("body"))
    units = docs.select("function_id", "path", F.col("function_id").alias("name"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), "body", F.array(F.lit(1)).alias("candidate_lines"))
    files = docs.select("path").distinct().withColumn("content", F.lit("#define A 1\n"))
    found = run_passes(units, files, Asking(_answer, scratch_folder(spark, "answers")))
    return found.select("function_id", "pass", "status", "summary")


@query("""SELECT 'p' || l_partkey AS function_id, arg_min('o' || l_orderkey, (('o' || l_orderkey), l_linenumber::INT)) AS path, list_sort(list_distinct(list(l_linenumber::INT))) AS candidate_lines FROM lineitem GROUP BY l_partkey""")
def function_dedupe(spark, sf):
    """Parts as functions that are found at every order line of theirs; one row each, with all lines."""
    line = F.col("l_linenumber").cast("int")
    rows = _t(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("function_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"), line.alias("start_line"), line.alias("end_line"), F.array(line).alias("candidate_lines"))
    return C.dedupe_functions(rows)[0].select("function_id", "path", "candidate_lines")


@query("""WITH p AS (SELECT *, CASE WHEN p_size <= 25 THEN 'ILP32' WHEN p_size < 50 THEN 'LP64' ELSE 'LLP64' END AS m, p_retailprice > 1200 AS s, p_type LIKE '%STEEL' AS na FROM part)
SELECT p_partkey, p_size::INT AS bits, s AS supported, CASE WHEN p_name LIKE 'a%' THEN 'unknown' WHEN na THEN 'not_available' ELSE 'not_set' END AS setting,
(1 + (m = 'LLP64')::INT + (p_size NOT IN (32, 64))::INT + (NOT s AND (p_name LIKE 'a%' OR NOT na))::INT + (s AND na AND NOT p_name LIKE 'a%')::INT + (p_name LIKE 'a%')::INT)::INT AS n_errors FROM p""")
def detected_answers(spark, sf):
    """Parts as environments that a model described, none of which names a C library that is known."""
    p = _t(spark, sf, "part")
    value = F.when(F.col("p_name").startswith("a"), " ").when(F.col("p_type").endswith("STEEL"), "not_available").otherwise("not_set")
    model = F.when(F.col("p_size") <= 25, "ILP32").when(F.col("p_size") < 50, "LP64").otherwise("LLP64")
    row = F.struct(model.alias("hardware_model"), F.col("p_size").alias("time_t_size_bits"), F.lit("signed").alias("time_t_signed"), F.lit(True).alias("time64_functions_available"), (F.col("p_retailprice") > 1200).alias("d_time_bits_supported"), value.alias("d_time_bits_setting"), F.col("p_brand").alias("c_library"))
    found = DE.detected_environments(p.select("p_partkey", F.to_json(row).alias("text")))
    return found.select("p_partkey", F.col("time_t_size_bits").alias("bits"), F.col("d_time_bits_supported").alias("supported"), F.col("d_time_bits_setting").alias("setting"), F.size("errors").alias("n_errors"))

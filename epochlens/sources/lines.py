"""Tables of source lines: from files, from text columns, and synthesised from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A line of C from an order line; the same text runs in DuckDB. Eighteen templates cover the detectors.
SYNTHETIC_TEXT = """
CASE CAST((l_partkey + l_linenumber) % 18 AS INT)
 WHEN 0 THEN concat('time_t t', CAST(l_linenumber AS STRING), ' = time(NULL);')
 WHEN 1 THEN concat('int32_t x', CAST(l_suppkey % 7 AS STRING), ' = (int32_t) time(NULL);')
 WHEN 2 THEN concat('t', CAST(l_linenumber AS STRING), ' = t', CAST(l_linenumber AS STRING), ' ', CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN '+' WHEN 1 THEN '/' WHEN 2 THEN '-' ELSE '*' END, ' ', CAST(l_partkey * 1000 AS STRING), ';')
 WHEN 3 THEN concat('deadline += ', CAST(l_suppkey AS STRING), '; // time_t note')
 WHEN 4 THEN concat('printf("%d %s", t', CAST(l_linenumber AS STRING), ');')
 WHEN 5 THEN concat('#define TIMEOUT_', CAST(l_suppkey % 5 AS STRING), ' 3600')
 WHEN 6 THEN concat('#define REG_BASE_', CAST(l_suppkey % 5 AS STRING), ' 0x4000')
 WHEN 7 THEN 'struct timeval tv; gettimeofday(&tv, NULL);'
 WHEN 8 THEN concat('memcpy((void *)buf, &t', CAST(l_linenumber AS STRING), ', sizeof(time_t));')
 WHEN 9 THEN 'if (stamp < 0) return -1;'
 WHEN 10 THEN concat('#include "h', CAST(l_partkey % 9 AS STRING), '.h"')
 WHEN 11 THEN concat('typedef ', CASE WHEN l_suppkey % 7 = 0 THEN 'time_t' ELSE concat('alias', CAST(l_suppkey % 7 - 1 AS STRING), '_t') END, ' alias', CAST(l_suppkey % 7 AS STRING), '_t;')
 WHEN 12 THEN concat('long d', CAST(l_linenumber AS STRING), ' = (long) start_time;')
 WHEN 13 THEN concat('int y', CAST(l_linenumber AS STRING), ' = last_tick;')
 WHEN 14 THEN concat('puts("time(NULL) in text ', CAST(l_linenumber AS STRING), '");')
 WHEN 15 THEN concat('mktime(&tm', CAST(l_linenumber AS STRING), ');')
 WHEN 16 THEN ''
 ELSE concat('return localtime(&t', CAST(l_linenumber AS STRING), ');')
END
"""
SYNTHETIC_SQL = f"""
SELECT concat('src/f', CAST(CAST(floor(l_orderkey / 64) AS BIGINT) AS STRING), '.c') AS path,
       CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 64) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS line,
       {SYNTHETIC_TEXT} AS text
FROM lineitem"""


def synthetic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made from order lines: path, line, text.

    Lines are numbered by path, which stands for the 64 orders of a file, so that they are dealt by path once and whatever follows by path needs no exchange.
    """
    path, block = "concat('src/f', CAST(CAST(floor(l_orderkey / 64) AS BIGINT) AS STRING), '.c')", "CAST(floor(l_orderkey / 64) AS BIGINT) ORDER BY"
    named = f"FROM (SELECT {path} AS path, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM parquet.`{sf_dir}/lineitem.parquet`)"
    # Texts are made of numbered rows, so that they are not dealt.
    numbered = SYNTHETIC_SQL.replace(f"{path} AS path", "path").replace(block, "path ORDER BY").replace(SYNTHETIC_TEXT, "l_linenumber, l_partkey, l_suppkey").replace(" AS text", "").replace("FROM lineitem", named)
    return spark.sql(f"SELECT path, line, {SYNTHETIC_TEXT} AS text FROM ({numbered})")


def split_lines(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Lines from 1; LF, CRLF and a lone CR end a line; an empty last piece is no line."""
    # A content is split once, by the generator; anything beside it would be computed for every line.
    pieces = F.split(F.coalesce(F.col(content_col), F.lit("")), r"\r\n|\r|\n", -1)
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    parts = files.select(F.col(path_col).alias("path"), F.posexplode(F.get(F.transform(F.array(pieces), whole), F.lit(0))).alias("pos", "text"))
    return parts.select("path", (F.col("pos") + 1).alias("line"), "text")


_TOKENS = r'"(?:\\.|[^"\\])*"?|' + r"'(?:\\.|[^'\\])*'?|//.*$|/\*.*?\*/"


def _clean_code(text: Column) -> Column:
    """Text that starts outside a comment: literals and whole comments become one blank, from an open comment on it is cut."""
    marks = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in "\"'/"])
    return F.when(marks, F.regexp_replace(F.regexp_replace(text, _TOKENS, " "), r"/\*.*$", " ")).otherwise(text)


def _stays_open(text: Column) -> Column:
    return F.contains(text, F.lit("/*")) & F.regexp_like(F.regexp_replace(text, _TOKENS, " "), F.lit(r"/\*"))


def _uncommented(text: Column) -> Column:
    """Text that starts outside a comment: comments become one blank, literals stay."""
    marked = F.regexp_replace(text, r"""("(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?)|//.*$|/\*.*?\*/|/\*.*$""", "$1\x01")
    return F.replace(F.regexp_replace(marked, "([\"'])\x01", "$1"), F.lit("\x01"), F.lit(" "))


def _marked(lines: DataFrame) -> DataFrame:
    """Adds what a line leaves behind if a block comment is open before it and if none is; ``__set`` is what it leaves where that is the same."""
    text = F.col("text")
    closing = F.instr(text, "*/")
    tail = F.when(closing > 0, F.substring(text, closing + 2, F.length(text)))
    marked = lines.withColumn("__tail", tail).withColumn("__out", _stays_open(text)).withColumn("__in", F.when(tail.isNull(), True).otherwise(_stays_open(tail)))
    return marked.withColumn("__set", F.when(F.col("__out") == F.col("__in"), F.col("__out"))).drop("__out", "__in")


def _cleaned(marked: DataFrame, with_code: bool) -> DataFrame:
    """Adds the clean texts, given whether a comment is open before each line (``__state``)."""
    text = F.col("text")
    if with_code:
        code = F.when(~F.col("__state"), _uncommented(text)).when(F.col("__tail").isNull(), "").otherwise(_uncommented(F.col("__tail")))
        marked = marked.withColumn("code", code)
    clean = F.when(~F.col("__state"), _clean_code(text)).when(F.col("__tail").isNull(), "").otherwise(_clean_code(F.col("__tail")))
    return marked.withColumn("clean", clean).drop("__tail", "__set", "__state")


def with_clean_text(lines: DataFrame, with_code: bool = False) -> DataFrame:
    """Adds ``clean``: literals and comments are blanked; an open block comment carries over the lines of a file. ``with_code`` adds ``code``, where literals stay.

    A line either sets the state (the same whether it starts inside or not) or keeps it, so the state before a line is what the last
    setting line left.
    """
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last("__set", ignorenulls=True).over(before), F.lit(False))
    return _cleaned(_marked(lines).withColumn("__state", state), with_code)


def with_clean_ranges(lines: DataFrame, with_code: bool = False) -> DataFrame:
    """Lines of byte ranges (path, part, at, text; see ``trees.read_ranges``) as path, line, text, clean, as ``with_clean_text`` makes them.

    A range either sets the state of comments or keeps it, as its lines do. So each range is first told as its number of lines and the state that its last setting line left; over these few rows
    of a file the number and state before each range are found, and every range then cleans its own lines: no task holds all lines of a long file.
    """
    marked = _marked(lines)
    facts = marked.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("__set", F.when(F.col("__set").isNotNull(), F.col("at"))).alias("left"))
    earlier = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = facts.select("path", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__first"), F.coalesce(F.last("left", ignorenulls=True).over(earlier), F.lit(False)).alias("__open"))
    before = Window.partitionBy("path", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last("__set", ignorenulls=True).over(before), F.col("__open"))
    numbered = marked.join(begins, ["path", "part"]).withColumn("__state", state).withColumn("line", (F.col("__first") + F.col("at") + 1).cast("int"))
    return _cleaned(numbered, with_code).drop("part", "at", "__first", "__open")

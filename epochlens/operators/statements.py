"""Logical lines: statements over several lines and continued directives as one line each, with a way back to their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lines import with_clean_text


def statements(lines: DataFrame) -> DataFrame:
    """One row for each statement: path, line (its first), last_line, text, parts (line and length of each piece).

    A statement ends with a line that ends in a brace, or in a semicolon or label outside parentheses; a directive ends with its line. A line
    that ends in a backslash goes on in any case. Comments become a blank, pieces are trimmed and joined by one blank, and empty ones
    (lines of blanks or comments alone) belong to none. Depth is counted anew after each brace and directive, so a parenthesis that is never closed joins no more than the lines up to
    the next of those. Files never share a statement; an unfinished last one is kept. A literal that a backslash
    breaks is not carried to its second line, whose quote then opens another: such a statement may take the next line with it.
    """
    known = with_clean_text(lines.select("path", "line", F.coalesce("text", F.lit("")).alias("text")), with_code=True)
    goes_on = F.rtrim("text").endswith("\\")
    unmarked = lambda c: F.trim(F.regexp_replace(c, r"\\\s*$", ""))
    by_line = Window.partitionBy("path").orderBy("line")
    upto, before = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_line.rowsBetween(Window.unboundedPreceding, -1)
    rows = known.select("path", "line", unmarked("code").alias("piece"), unmarked("clean").alias("clean"), goes_on.alias("goes_on"))
    rows = rows.withColumn("continued", F.coalesce(F.lag("goes_on").over(by_line), F.lit(False)))
    rows = rows.withColumn("hash", ~F.col("continued") & F.col("piece").startswith("#"))
    rows = rows.withColumn("directive", F.coalesce(F.last(F.when(~F.col("continued"), F.col("hash")), ignorenulls=True).over(upto), F.lit(False)))
    rows = rows.filter((F.col("piece") != "") | F.col("goes_on"))
    count = lambda c: F.length("clean") - F.length(F.replace(F.col("clean"), F.lit(c), F.lit("")))
    hard = F.col("directive") | F.col("clean").rlike(r"[{}]$")
    rows = rows.withColumn("hard", hard).withColumn("sum", F.sum(F.when(F.col("directive"), 0).otherwise(count("(") - count(")"))).over(upto))
    depth = F.col("sum") - F.coalesce(F.last(F.when(F.col("hard"), F.col("sum")), ignorenulls=True).over(before), F.lit(0))
    soft = F.col("clean").rlike(r";$") | F.col("clean").rlike(r"^(?:case\b[^?]*|\w+\s*):$")
    rows = rows.withColumn("ends", ~F.col("goes_on") & (F.col("hard") | soft & (depth <= 0)))
    begins = F.coalesce(F.lag("ends").over(by_line), F.lit(True)) | F.col("hash")
    rows = rows.withColumn("first", F.last(F.when(begins, F.col("line")), ignorenulls=True).over(upto)).filter("piece <> ''")
    whole = rows.groupBy("path", "first").agg(F.max("line").alias("last_line"), F.array_sort(F.collect_list(F.struct("line", "piece"))).alias("p"))
    return whole.select(
        "path", F.get("p", F.lit(0))["line"].alias("line"), "last_line", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"), F.transform("p", lambda x: F.struct(x["line"].alias("line"), F.length(x["piece"]).alias("n"))).alias("parts")
    )


def place_of(parts: Column, at: Column) -> Column:
    """The line of a statement's character, counted from 0; null where there is none."""
    none = F.struct(at.cast("long").alias("left"), F.lit(None).cast("int").alias("line"))
    step = lambda s, x: F.struct((s["left"] - x["n"] - 1).cast("long").alias("left"), F.coalesce(s["line"], F.when((s["left"] >= 0) & (s["left"] <= x["n"]), x["line"])).cast("int").alias("line"))
    return F.aggregate(parts, none, step, lambda s: s["line"])

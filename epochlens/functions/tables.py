"""Table functions for SQL: what a text, or the lines of a file, hold.

``register_table_functions`` gives a session ``spans(content)``, ``typedefs(content)``, ``bodies(content)`` for ``LATERAL``, and ``line_spans(TABLE(lines))``,
which has Spark partition its table by path and sort it by line.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators import cparse as P

SPANS = StructType().add("name", StringType()).add("start_line", IntegerType()).add("end_line", IntegerType())
TYPEDEFS = StructType().add("alias", StringType()).add("line", IntegerType()).add("text", StringType())
BODIES = StructType().add("name", StringType()).add("start_line", IntegerType()).add("end_line", IntegerType()).add("part", IntegerType()).add("body", StringType())


def _of_text(parse, schema: StructType):
    """A table function of one text; a null text has no rows, and anything but a text is an error before the query runs."""

    class OfText:
        @staticmethod
        def analyze(content: AnalyzeArgument) -> AnalyzeResult:
            if content.isTable or not isinstance(content.dataType, (StringType, NullType)):
                raise ValueError("content must be a string")
            return AnalyzeResult(schema=schema)

        def eval(self, content: str):
            yield from parse(content or "")

    return udtf(OfText)


class LineSpans:
    """Function spans of files that are given as lines (path, line, text); their numbers are those of the lines given."""

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable or not {"path", "line", "text"} <= set(lines.dataType.fieldNames()):
            raise ValueError("a table with path, line and text is needed")
        schema = StructType().add("path", StringType())
        for field in SPANS:
            schema = schema.add(field)
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("line")])

    def __init__(self) -> None:
        self.path, self.lines, self.text = None, [], []

    def eval(self, row):
        self.path = row["path"]
        self.lines.append(row["line"])
        self.text.append(row["text"] or "")

    def terminate(self):
        for name, first, last in P.functions("\n".join(self.text)):
            yield self.path, name, self.lines[first - 1], self.lines[last - 1]


def register_table_functions(spark: SparkSession) -> None:
    """Register all table functions with a session."""
    spark.udtf.register("spans", _of_text(P.functions, SPANS))
    spark.udtf.register("typedefs", _of_text(P.typedefs, TYPEDEFS))
    spark.udtf.register("bodies", _of_text(P.split_bodies, BODIES))
    spark.udtf.register("line_spans", udtf(LineSpans))

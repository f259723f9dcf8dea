"""Scanning files as they arrive: each micro-batch is scanned as a table and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.publication import publish
from ..plans.scan import scan
from ..sources.lines import split_lines


def watch_files(spark: SparkSession, folder: str, rules: DataFrame, out: str, checkpoint: str):
    """A query that scans Parquet files of (path, content) in ``folder``; a batch that is run again replaces its own output."""
    source = spark.readStream.schema("path string, content string").parquet(folder)

    def append(batch: DataFrame, number: int) -> None:
        found = scan(split_lines(batch), rules).candidates
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def watch_published(spark: SparkSession, folder: str, rules: DataFrame, out: str, checkpoint: str):
    """As ``watch_files``, with each micro-batch as a part of a publication: readers see candidates and conflicts of a batch together, and a batch that is run again replaces
    its own part."""
    source = spark.readStream.schema("path string, content string").parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        found = scan(split_lines(batch), rules)
        publish(batch.sparkSession, out, {"candidates": found.candidates, "conflicts": found.conflicts}, part=f"batch-{number}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)

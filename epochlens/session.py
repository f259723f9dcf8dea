"""What the engine needs of the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir. A local session without one gets a folder of its own; on a cluster that is an
    error, as executors do not share the driver's folders."""
    if spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="epochlens-"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of checkpoints, which all executors share."""
    ensure_checkpoints(spark)
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the query that made them ends, while this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries made inside delete their shuffle files at their end, which else stay until the driver's heap is collected. A query that is run again makes them anew."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)

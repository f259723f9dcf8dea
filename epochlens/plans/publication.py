"""Runs that readers see whole or not at all.

The tables of a run are written to a folder of their own, ``versions/<id>``. When all are there a numbered manifest that names them is put in place by one rename, which fails if the number is taken.
Readers take the manifest with the highest number and resolve every table through it, so they never mix two runs, and a run that stops midway leaves the one before. A manifest has
parts: a whole run replaces all of them, a micro-batch of a stream only its own, so a batch that is run again does not count twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.artifacts import new_run_id

WHOLE = "run"


class Taken(Exception):
    """Another run published under the same number; its manifest stands."""


def _store(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target.getFileSystem(conf), target


def _manifests(spark: SparkSession, path: str) -> list[int]:
    _, store, folder = _store(spark, f"{path}/manifests")
    if not store.exists(folder):
        return []
    return sorted(int(n[:-5]) for n in (x.getPath().getName() for x in store.listStatus(folder)) if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    jvm, store, target = _store(spark, f"{path}/manifests/{number:012d}.json")
    stream = store.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> dict | None:
    """The manifest in force: number, id, parts and schemas; none where nothing was published."""
    numbers = _manifests(spark, path)
    return _manifest(spark, path, numbers[-1]) if numbers else None


def _put(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write a manifest aside and rename it to its number."""
    jvm, store, aside = _store(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{manifest['number']:012d}.json")
    out = store.create(aside, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if store.exists(target) or not store.rename(aside, target):
        store.delete(aside, False)
        raise Taken(f"{path}: manifest {manifest['number']} is there already")


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], part: str = WHOLE, more: Callable[[str], object] | None = None, tries: int = 5) -> dict:
    """Write ``tables``, and what ``more(folder)`` writes beside them, then let readers see them. Returns the manifest.

    With ``part`` only that part is replaced. If another run publishes meanwhile, the manifest is made anew on top of it; the tables are not written again.
    """
    version = f"{new_run_id()}-{uuid.uuid4().hex[:6]}"
    folder = f"{path}/versions/{version}"
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    if more is not None:
        more(folder)
    for left in range(tries - 1, -1, -1):
        before = current(spark, path)
        number = (before["number"] if before else 0) + 1
        parts = {} if part == WHOLE or before is None else {k: v for k, v in before["parts"].items() if k != WHOLE}
        schemas = (before["schemas"] if before and part != WHOLE else {}) | {name: table.schema.jsonValue() for name, table in tables.items()}
        manifest = {"number": number, "id": version, "parts": parts | {part: {"folder": f"versions/{version}", "tables": sorted(tables)}}, "schemas": schemas}
        try:
            _put(spark, path, manifest)
            return manifest
        except Taken:
            if not left:
                raise
    raise AssertionError


def published(spark: SparkSession, path: str, name: str, manifest: dict | None = None) -> DataFrame:
    """A table of the run in force, or of the run that ``manifest`` describes; read several tables with one manifest to have them of one run."""
    manifest = manifest or current(spark, path)
    if manifest is None:
        raise ValueError(f"nothing was published in {path}")
    if name not in manifest["schemas"]:
        raise ValueError(f"{path} has no table {name}; it has {', '.join(sorted(manifest['schemas']))}")
    schema = StructType.fromJson(manifest["schemas"][name])
    folders = [f"{path}/{p['folder']}/{name}" for p in manifest["parts"].values() if name in p["tables"]]
    return spark.read.schema(schema).parquet(*folders)


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests but the last ``keep``, and all folders that none of those names: replaced runs and what failed ones left. Not while another run writes. Returns the folders."""
    numbers = _manifests(spark, path)
    if keep < 1 or not numbers:
        return []
    live = {p["folder"].split("/")[-1] for n in numbers[-keep:] for p in _manifest(spark, path, n)["parts"].values()}
    jvm, store, folder = _store(spark, f"{path}/versions")
    gone = sorted(x.getPath().getName() for x in store.listStatus(folder) if x.getPath().getName() not in live)
    for n in numbers[:-keep]:
        store.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{n:012d}.json"), False)
    for name in gone:
        store.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{name}"), True)
    return gone

"""One provenance for each candidate: rows of one identity are merged so that a kept row is never put together from rows that contradict each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, candidate_id
from .candidates import IDENTITY, METHODS

FIELDS = ("discovery_method", "rule_id", "description")


def merge_provenance(candidates: DataFrame) -> DataFrame:
    """One row for each identity: the identity, candidate_id, the fields of the provenance that won, n_rows, n_won (rows of that provenance), conflict, contradicted (names of fields).

    A provenance is a row's method, rule id and description; blank fields are empty. Where no field has two values, the row is filled from all (no conflict). Else one whole
    provenance wins, empty fields and all: the one with most fields, then the earliest method of the vocabulary, then the smallest values.
    Repeats are counted before they travel: a merge is minima, maxima and sums alone, so it is associative, rows are combined before the shuffle, and no group of rows is ever held.
    """
    rows = candidates.select(*IDENTITY, *[blank_to_null(F.col(c)).alias(c) for c in FIELDS])
    each = rows.groupBy(*IDENTITY, *FIELDS).agg(F.count(F.lit(1)).alias("n"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, METHODS)), F.col("discovery_method")), F.lit(0)), F.lit(len(METHODS) + 1))
    n_fields = sum((F.col(c).isNotNull().cast("int") for c in FIELDS), F.lit(0))
    best = F.struct((-n_fields).alias("f"), rank.alias("r"), *[F.coalesce(c, F.lit("")).alias(f"s_{c}") for c in FIELDS], *FIELDS, "n")
    spans = [f(c).alias(f"{name}_{c}") for c in FIELDS for name, f in (("least", F.min), ("most", F.max))]
    merged = each.groupBy(*IDENTITY).agg(F.min(best).alias("best"), F.sum("n").alias("n_rows"), *spans)
    merged = merged.withColumn("contradicted", F.array_compact(F.array(*[F.when(F.col(f"least_{c}") != F.col(f"most_{c}"), F.lit(c)) for c in FIELDS]))).withColumn("conflict", F.size("contradicted") > 0)
    ident = candidate_id(F.col("path"), F.col("line"), F.col("col_start"), F.col("col_end"), F.col("risk"), F.col("symbol"))
    kept = [F.when(F.col("conflict"), F.col("best")[c]).otherwise(F.col(f"least_{c}")).alias(c) for c in FIELDS]
    return merged.select(*IDENTITY, ident.alias("candidate_id"), *kept, "n_rows", F.col("best")["n"].alias("n_won"), "conflict", "contradicted")

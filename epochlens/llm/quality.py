"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier on shape features of the whole text is fitted on a bounded sample of labelled rows (``SAMPLE``, a
parameter; chosen by digest). Its logit less that of the sample's share of good rows is a document's own evidence. What is
expected of a document before its text is read comes from its site: the classifier's probabilities over all documents are summed
by host and by path, the corpus mean is the prior of the hosts, a host's posterior mean is the prior of its paths, and each level has a
strength of its own, from the spread of its means beyond chance (method of moments), so sparse sites shrink toward what lies above
them and levels that tell nothing shrink altogether. A document's own probability is left out of its site's sums, so
no evidence counts twice. Evidence plus the logit of the path's posterior is the document's final logit; it is accepted where that is at
least ``THRESHOLD``.

Hosts and paths are columns of the caller's choice. ``documents`` has no address: there the host is the source and the path the
language within it. ``url_site`` gives host and path of an address.

Defined cases: null or empty text has the features of an empty text; null hosts and paths form groups of their own; a document alone in
its site has the prior of the level above; without labels of both kinds the classifier is 0 for all and everything is accepted; repeated
rows each give their row and count as rows; an empty table gives no rows; other columns pass through where asked for.
"""

from __future__ import annotations

from collections import Counter
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, byte_values, saved, slices, small_batches

SAMPLE, THRESHOLD, STEPS, RIDGE = 6000, 0.0, 60, 1e-2
#: Strengths are counts of documents, within these bounds; the upper one is that of a level without spread.
WEAKEST, STRONGEST = 1.0, 1e6

_KINDS = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    _KINDS[_c] = (
        1 if 97 <= _c <= 122 or _c >= 128 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c == 10 else 5 if _c in b" \t\r\x0b\x0c" else 6 if _c in b".,;:?'\"()-" else 7 if _c == 33 else 8 if _c == 124 else 9
    )
_TABLE = _KINDS.tobytes()
N_FEATURES = 15


def features(data: bytes) -> list[float]:
    """Shares of kinds of bytes and words, and how much repeats."""
    kinds = np.bincount(np.frombuffer(data.translate(_TABLE), dtype=np.uint8), minlength=10)
    words = data.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = data.split(b"\n")
    letters = max(1, kinds[1] + kinds[2])
    size = max(1, len(data))
    top = max(counts.values(), default=0) / n
    return [
        kinds[2] / letters,
        kinds[3] / size,
        kinds[7] / n,
        kinds[8] / n,
        kinds[9] / n,
        kinds[6] / n,
        np.log1p(n),
        size / n / 10,
        np.log1p(len(counts)) / np.log1p(n),
        top,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)) / np.log1p(n),
        sum(map(eq, words, words[1:])) / n,
        min(1.0, 20 * kinds[9] / n),
        min(1.0, 5 * kinds[2] / letters),
    ]


class Model(NamedTuple):
    """Weights and offset on raw features, and the logit of the sample's share of good rows."""

    weights: list[float]
    offset: float
    base: float


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression by Newton steps on standardised features."""
    if len(y) == 0 or y.min() == y.max():
        return Model([0.0] * (x.shape[1] if x.ndim == 2 else N_FEATURES), 0.0, 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + RIDGE * np.append(w[:-1], 0)
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + (RIDGE + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / scale
    return Model(raw.tolist(), float(w[-1] - raw @ mean), float(np.log(y.mean() / (1 - y.mean()))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled ids, chosen by the digest of their ids, each with one text: of several texts of an id the one with the smallest digest."""
    chosen = (
        labels.select(labels[id_col].cast("long").alias("l_id"), labels[label_col].cast("double").alias("y")).dropna()
        .groupBy("l_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    )
    texts = docs.select(docs[id_col].cast("long").alias("l_id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            rows = [features(t) for t in byte_values(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    # The sample is bounded by ``sample`` rows of two numbers, so it may be broadcast, and so are the features that come back.
    one_each = texts.join(F.broadcast(chosen), "l_id").groupBy("l_id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    found = one_each.select("y", "text").mapInArrow(run, "y double, x array<double>").toPandas()
    found = found.sort_values(["y", "x"], key=lambda c: c.map(str)) if len(found) else found
    return fit(np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES), found["y"].to_numpy(dtype=np.float64))


def classify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Adds __logit from the whole text; only ``keep`` of the other columns stay."""
    weights, offset = np.array(model.weights), model.offset
    kept = docs.select(*[docs[c] for c in keep])
    schema = T.StructType([*kept.schema.fields, T.StructField("__logit", T.DoubleType())])

    def run(batches):
        for batch in slices(batches, column=0):
            x = np.array([features(t) for t in byte_values(batch.column(0))])
            logit = np.clip(x @ weights + offset, -30, 30)
            yield pa.record_batch([*batch.columns[1:], pa.array(logit, pa.float64())], [*keep, "__logit"])

    return docs.select(docs[text_col].cast("string").alias("__text"), *[docs[c] for c in keep]).mapInArrow(run, schema)


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and first part of the path of an address; empty where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host, F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def _strength(mean: Column, spread: Column) -> Column:
    """How many documents a prior weighs, from the variance between the means of its level."""
    return F.when(spread > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), mean * (1 - mean) / spread - 1))).otherwise(STRONGEST)


def site_sums(scored: DataFrame, host_col: str, path_col: str) -> DataFrame:
    """One row per host and path: counts and sums of probabilities of path, host and corpus, and the strengths of the two levels."""
    p = 1 / (1 + F.exp(-F.col("__logit")))
    paths = scored.groupBy(F.col(host_col).alias("__host"), F.col(path_col).alias("__path")).agg(F.count(F.lit(1)).alias("__n"), F.sum(p).alias("__s"))
    square = lambda s, n: s * s / n
    hosts = paths.groupBy("__host").agg(
        F.sum("__n").alias("__host_n"), F.sum("__s").alias("__host_s"), F.sum(square(F.col("__s"), F.col("__n"))).alias("ss"), F.sum(F.col("__n") * F.col("__n")).alias("nn"), F.count(F.lit(1)).alias("k")
    )
    n, s = F.col("__host_n"), F.col("__host_s")
    world = hosts.agg(
        F.sum(n).alias("__all_n"), F.sum(s).alias("__all_s"), F.count(F.lit(1)).alias("hosts"), F.sum("k").alias("paths"), F.sum(square(s, n)).alias("host_ss"), F.sum(n * n).alias("host_nn"),
        F.sum(F.col("ss") - square(s, n)).alias("path_ss"), F.sum(n - F.col("nn") / n).alias("path_free"),
    )
    mean = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("__all_s") / F.col("__all_n")))
    # Squares between the means of a level, less what chance alone gives, by the count that tells of them.
    host_spread = (F.col("host_ss") - square(F.col("__all_s"), F.col("__all_n")) - (F.col("hosts") - 1) * mean * (1 - mean)) / (F.col("__all_n") - F.col("host_nn") / F.col("__all_n"))
    path_spread = (F.col("path_ss") - (F.col("paths") - F.col("hosts")) * mean * (1 - mean)) / F.col("path_free")
    strengths = world.select(
        "__all_n", "__all_s",
        F.when(F.col("hosts") > 1, _strength(mean, host_spread)).otherwise(STRONGEST).alias("__host_strength"),
        F.when(F.col("paths") > F.col("hosts"), _strength(mean, path_spread)).otherwise(STRONGEST).alias("__path_strength"),
    )
    # One row of four numbers.
    above = hosts.crossJoin(F.broadcast(strengths)).select(F.col("__host").alias("__h"), "__host_n", "__host_s", *strengths.columns)
    return paths.join(above, F.col("__host").eqNullSafe(F.col("__h"))).drop("__h")


def _posteriors(base: float) -> tuple[Column, Column]:
    """Means of a document's host and path, its own probability left out."""
    own = 1 / (1 + F.exp(-F.col("__logit")))
    prior = 1 / (1 + float(np.exp(-base)))
    # One row's worth of the sample's share stands in where no other document is there.
    corpus = (F.col("__all_s") - own + prior) / F.col("__all_n")
    host = (F.col("__host_s") - own + corpus * F.col("__host_strength")) / (F.col("__host_n") - 1 + F.col("__host_strength"))
    path = (F.col("__s") - own + host * F.col("__path_strength")) / (F.col("__n") - 1 + F.col("__path_strength"))
    return tuple(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x)) for x in (host, path))


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str], sample: int = SAMPLE, host_col: str = "source", path_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Columns ``keep`` with __logit, __host_mean, __path_mean, __final and __accepted."""
    small_batches(docs)
    model = train(docs, labels, sample, id_col, text_col)
    scored = saved(classify(docs, model, list(dict.fromkeys([*keep, host_col, path_col])), text_col), "scored")
    return with_sites(scored, model.base, host_col, path_col)


def with_sites(scored: DataFrame, base: float, host_col: str, path_col: str) -> DataFrame:
    """``scored``, which has __logit, with __host_mean, __path_mean, __final and __accepted."""
    sites = saved(site_sums(scored, host_col, path_col), "sites")
    on = scored[host_col].eqNullSafe(sites["__host"]) & scored[path_col].eqNullSafe(sites["__path"])
    small = sites.count() * 256 <= BROADCAST_BYTES
    host, path = _posteriors(base)
    joined = scored.join(F.broadcast(sites) if small else sites, on).select(*[scored[c] for c in scored.columns], host.alias("__host_mean"), path.alias("__path_mean"))
    final = F.col("__logit") - F.lit(base) + F.log(F.col("__path_mean") / (1 - F.col("__path_mean")))
    # Sums of floating-point numbers differ in their last digits from run to run.
    return joined.withColumn("__final", F.round(final, 9)).withColumn("__accepted", F.col("__final") >= THRESHOLD)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, evidence, posteriors, score and decision."""
    out = score_quality(docs, labels, ["doc_id", "source", "lang"], sample)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.round("__logit", 9).alias("classifier_logit"), F.round("__host_mean", 9).alias("host_mean"), F.round("__path_mean", 9).alias("path_mean"), F.round(1 / (1 + F.exp(-F.col("__final"))), 9).alias("score"), F.col("__accepted").alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    columns = docs.columns
    return score_quality(docs, labels, columns, sample).filter("__accepted").select(*columns)

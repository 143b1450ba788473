"""Vector and score arithmetic as columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
METRICS = ("cosine", "l2", "ip")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(EPS))
    return F.transform(a, lambda x: x.cast("double") / n)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """``cosine`` (0 to 2), ``l2`` (squared) or ``ip`` (negative inner product)."""
    if metric == "cosine":
        return F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - cosine(a, b)))
    if metric == "l2":
        return l2_squared(a, b)
    if metric == "ip":
        return -dot(a, b)
    raise ValueError(f"no metric {metric}; there are {METRICS}")


def similarity(metric: str, d: Column) -> Column:
    """A distance as a similarity of 0 to 1."""
    if metric == "cosine":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (2 - d) / 2))
    if metric == "l2":
        return 1 / (1 + F.greatest(d, F.lit(0.0)))
    if metric == "ip":
        return 1 / (1 + F.exp(d))
    return F.lit(0.0)


def query_similarity(metric: str, a: Column, b: Column) -> Column:
    """Similarity of a node to the query; that of cosine is not clamped."""
    return (cosine(a, b) + 1) / 2 if metric == "cosine" else similarity(metric, distance(metric, a, b))


def min_max(df: DataFrame, value: str, group: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` scaled to 0 to 1 within its ``group``; all zeros where the range vanishes.

    Least and greatest are aggregated before they are shuffled and joined back, so a large group is never one task's.
    """
    ends = df.groupBy(F.col(group).alias("_group")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = F.col("_high") - F.col("_low")
    scaled = F.when(width < 1e-9, F.lit(0.0)).otherwise((F.col(value) - F.col("_low")) / width)
    return df.join(ends, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, scaled).drop("_group", "_low", "_high")


def recency(newest: Column, ts: Column, scale: float = 3600.0) -> Column:
    return F.exp(-(newest - ts) / scale)


def hamming_penalty(value: Column, others: Column) -> Column:
    """One less the smallest share of differing bits to any of the array ``others``; 0 if there are none."""
    least = F.aggregate(others, F.lit(64), lambda m, x: F.least(m, F.bit_count(value.bitwiseXOR(x))))
    return F.when(F.size(others) > 0, 1 - least / 64).otherwise(F.lit(0.0))


def backoff(attempt: Column, first: float = 0.5, most: float = 8.0) -> Column:
    """Seconds to wait before a retry, without jitter: doubled each time up to ``most``."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))

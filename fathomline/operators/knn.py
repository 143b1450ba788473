"""Exact nearest neighbours of a stated query set, in two phases, and what builds on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from .lexical import top

#: Query vectors compared at once; a larger query set is taken in blocks of this many.
QUERY_BLOCK = 4096


def _distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return np.clip(1 - q @ x.T, 0, 2)
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)
    return -(q @ x.T)


def flat_knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_: str = "id", vector: str = "embedding", skip_self: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, id, distance, rank)``: the ``k`` nearest vectors of each query ``(query_id, q)``.

    Every partition keeps its own ``k`` best of each query, by (distance, id),
    so what is shuffled is bounded by queries x partitions x k. The query set
    is broadcast in blocks of ``block``. Null vectors and those of another
    length than the query are passed over.
    """
    if metric not in METRICS:
        raise ValueError(f"no metric {metric}; there are {METRICS}")
    spark = vectors.sparkSession
    stated = queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>")).filter("query_id is not null and q is not null")
    # The driver holds one block of the stated queries at a time.
    parts = max(1, -(-stated.count() // block))
    out = None
    for p in range(parts):
        own = stated.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).collect()
        by: dict[int, list] = {}
        for r in own:
            by.setdefault(len(r.q), []).append(r)
        held = spark.sparkContext.broadcast({n: (np.array([r.query_id for r in rs], np.int64), np.array([r.q for r in rs], "f8")) for n, rs in by.items() if n})

        def run(batches, held=held):
            best: dict[int, list] = {}
            for b in batches:
                ids = b.column(0).to_numpy()
                size = np.nan_to_num(b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype("f8"), nan=-1).astype(int)
                for n, (qid, q) in held.value.items():
                    at = size == n
                    if not at.any():
                        continue
                    x = b.column(1).filter(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, n)
                    xi = ids[at]
                    for s in range(0, len(q), 256):
                        d = _distances(metric, q[s : s + 256], x)
                        if skip_self:
                            d[qid[s : s + 256, None] == xi[None, :]] = np.inf
                        for i in range(len(d)):
                            key = (n, s + i)
                            od, oi = best.get(key, (np.zeros(0), np.zeros(0, np.int64)))
                            row = d[i]
                            if len(od) >= k:
                                near = row <= od[-1]
                                cd, ci = row[near], xi[near]
                            else:
                                cd, ci = row, xi
                            if len(cd):
                                cd, ci = np.concatenate([od, cd]), np.concatenate([oi, ci])
                                o = np.lexsort((ci, cd))[:k]
                                best[key] = (cd[o], ci[o])
            if best:
                keys = list(best)
                qs = np.concatenate([np.full(len(best[key][0]), held.value[key[0]][0][key[1]]) for key in keys])
                d = np.concatenate([best[key][0] for key in keys])
                i = np.concatenate([best[key][1] for key in keys])
                ok = np.isfinite(d)
                yield pa.RecordBatch.from_arrays([pa.array(qs[ok]), pa.array(i[ok]), pa.array(d[ok])], ["query_id", "id", "distance"])

        rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null")
        found = rows.mapInArrow(run, "query_id long, id long, distance double")
        out = found if out is None else out.unionByName(found)
    return top(out, k, "distance", ascending=True)


def filtered(vectors: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Rows that meet all equalities; an unknown field matches nothing. Equalities on columns reach the scan."""
    for field, value in conditions.items():
        if field not in vectors.columns:
            return vectors.limit(0)
        vectors = vectors.filter(F.col(field) == F.lit(value))
    return vectors


def merge_tops(parts: DataFrame, k: int, value: str = "distance", largest: bool = False) -> DataFrame:
    """Partial results ``(query_id, id, value)`` merged: one value for each id, its best, then the best ``k``."""
    best = (F.max if largest else F.min)(value)
    return top(parts.groupBy("query_id", "id").agg(best.alias(value)), k, value, ascending=not largest)


def neighbour_graph(vectors: DataFrame, nodes: DataFrame, k: int = 8, metric: str = "cosine", id_: str = "id", vector: str = "embedding") -> DataFrame:
    """``(src, dst, distance)``: the ``k`` nearest others of each of ``nodes (id)``, exactly."""
    stated = nodes.select(F.col("id")).distinct().join(vectors.select(F.col(id_).alias("id"), F.col(vector).alias("q")), "id").select(F.col("id").alias("query_id"), "q")
    found = flat_knn(vectors, stated, k, metric, id_, vector, skip_self=True)
    return found.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance")

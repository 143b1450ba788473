"""An inverted file over vectors: cells from k-means, exact rerank of probed cells, optional product codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..session import cut
from .knn import flat_knn
from .lexical import top


def kmeans(x: np.ndarray, k: int, rounds: int = 25, tolerance: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Centroids of a bounded sample; an empty cell takes the point farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    last = np.inf
    for _ in range(rounds):
        cell, near = nearest_cell(x, c)
        count = np.bincount(cell, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, cell, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
        c[count == 0] = x[np.argsort(-near, kind="stable")[: (count == 0).sum()]]
        now = near.sum()
        if last - now <= tolerance * max(now, 1e-12):
            break
        last = now
    return c


def nearest_cell(x: np.ndarray, c: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its squared distance, in blocks of bounded size."""
    cell, near = np.empty(len(x), np.int64), np.empty(len(x))
    size = (c * c).sum(1)[None, :]
    for s in range(0, len(x), block):
        part = x[s : s + block]
        d = size - 2 * part @ c.T
        at = d.argmin(1)
        cell[s : s + block] = at
        near[s : s + block] = np.maximum(d[np.arange(len(part)), at] + (part * part).sum(1), 0)
    return cell, near


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)


@dataclass
class Ivf:
    """``postings (id, cell, v)`` and ``centroids``; the number of cells bounds what is broadcast."""

    postings: DataFrame
    centroids: np.ndarray
    metric: str

    def search(self, queries: DataFrame, k: int, nprobe: int = 16) -> DataFrame:
        """``(query_id, id, distance, rank)`` over the ``nprobe`` non-empty cells nearest to each query ``(query_id, q)``.

        Distances are exact within the probed cells; with all cells probed the
        result is that of a flat search. Where the probed cells hold fewer than
        ``k`` rows, a flat search fills up.
        """
        spark = self.postings.sparkSession
        held = spark.sparkContext.broadcast(self.centroids)
        alive = spark.sparkContext.broadcast(np.array(sorted(r.cell for r in self.postings.select("cell").distinct().collect()), np.int64))  # at most the number of cells

        def probe(batches):
            c = held.value[alive.value]
            for b in batches:
                q = _rows(b.column(1), c.shape[1])
                d = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * q @ c.T
                n = min(nprobe, len(c))
                cells = alive.value[np.argsort(d, axis=1, kind="stable")[:, :n]]
                rows = np.repeat(np.arange(b.num_rows), n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(cells.ravel())], ["query_id", "q", "cell"])

        probes = queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>")).mapInArrow(probe, "query_id long, q array<double>, cell long")
        scored = self.postings.join(probes, "cell").select("query_id", "id", distance(self.metric, F.col("q"), F.col("v")).alias("distance"))
        return filled(top(scored, k, "distance", ascending=True), self.postings, queries, k, self.metric)


def filled(found: DataFrame, postings: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """``found``, in which queries with fewer than ``k`` rows get the nearest others of an exact flat search."""
    found = cut(found.select("query_id", "id", "distance", "rank"))
    short = queries.select(F.col("query_id").cast("long"), "q").join(found.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    if short.isEmpty():
        return found
    more = flat_knn(postings, short, k, metric, vector="v").join(found, ["query_id", "id"], "left_anti")
    both = found.withColumn("flat", F.lit(0)).unionByName(more.withColumn("flat", F.lit(1)))
    kept = both.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("flat", "distance", "id"))).filter(F.col("r") <= k)
    return top(kept.select("query_id", "id", "distance"), k, "distance", ascending=True)


def build(vectors: DataFrame, cells: int = 4096, metric: str = "cosine", id_: str = "id", vector: str = "embedding", sample: int = 50_000, seed: int = 0, path: str | None = None) -> Ivf:
    """Cells are fitted on at most ``sample`` vectors, chosen by the hash of their id; every vector is assigned. A dense cell lies in many ranges of ids, so no task holds
    one. Vectors of another length than the most frequent one are left out.

    With ``path`` the postings are written there, partitioned by cell, so a
    probe prunes partitions.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        raise ValueError("no vectors")
    rows = rows.filter(F.size("v") == common.n)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    centroids = kmeans(_rows(some.column("v").combine_chunks(), common.n), cells, seed=seed)
    held = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        c = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest_cell(_rows(b.column(1), c.shape[1]), c)[0])], ["id", "v", "cell"])

    postings = rows.mapInArrow(assign, "id long, v array<double>, cell long")
    if path:
        postings.repartitionByRange("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(path)
        postings = spark.read.parquet(path).withColumn("cell", F.col("cell").cast("long"))
    else:
        postings = cut(postings.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"))
    return Ivf(postings, centroids, metric)


def product_codes(index: Ivf, parts: int = 8, codes: int = 256, sample: int = 50_000) -> tuple[DataFrame, np.ndarray]:
    """``(id, cell, code)`` of the residuals to their cell, and the codebooks ``(parts, codes, dim / parts)``."""
    dim = index.centroids.shape[1]
    if dim % parts or codes > 256:
        raise ValueError("parts must divide the dimension, and a code is one byte")
    some = index.postings.select("id", "cell", "v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    residual = _rows(some.column("v").combine_chunks(), dim) - index.centroids[some.column("cell").to_numpy()]
    books = np.stack([_padded(kmeans(residual[:, p * dim // parts : (p + 1) * dim // parts], codes, seed=p), codes) for p in range(parts)])
    held = index.postings.sparkSession.sparkContext.broadcast((index.centroids, books))

    def encode(batches):
        c, books = held.value
        step = c.shape[1] // len(books)
        for b in batches:
            cell = b.column(1).to_numpy()
            x = _rows(b.column(2), c.shape[1]) - c[cell]
            code = np.stack([nearest_cell(x[:, p * step : (p + 1) * step], books[p])[0] for p in range(len(books))], axis=1).astype(np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(books)), len(x), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], ["id", "cell", "code"])

    return index.postings.select("id", "cell", "v").mapInArrow(encode, "id long, cell long, code binary"), books


def _padded(c: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([c, np.repeat(c[-1:], n - len(c), 0)]) if len(c) < n else c


#: Queries whose residual tables are broadcast at once.
CODE_BLOCK = 128


def code_search(index: Ivf, coded: DataFrame, books: np.ndarray, queries: DataFrame, k: int, nprobe: int = 16, refine: int = 200, block: int = CODE_BLOCK) -> DataFrame:
    """As :meth:`Ivf.search`, but the ``refine`` best by code distance (query residual tables) are reranked exactly.

    A block of queries is broadcast with its tables, which are looked up
    while the codes are scanned; each task keeps the ``refine`` best of a
    query, so no code is joined with a table.
    """
    spark = coded.sparkSession
    c, parts = index.centroids, len(books)
    step = c.shape[1] // parts
    stated = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")).filter("query_id is not null and q is not null")
    # The driver holds one block of the stated queries at a time.
    blocks = max(1, -(-stated.count() // block))
    near = None
    for p in range(blocks):
        own = stated.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == p).collect()
        ids, q = np.array([r.query_id for r in own], np.int64), np.array([r.q for r in own], "f8").reshape(len(own), -1)
        n = min(nprobe, len(c))
        cells = np.argsort((c * c).sum(1)[None, :] - 2 * q @ c.T, axis=1, kind="stable")[:, :n] if len(q) else np.zeros((0, n), np.int64)
        residual = (q[:, None, :] - c[cells]).reshape(len(q), n, parts, step) if len(q) else np.zeros((0, n, parts, step))
        tables = np.stack([((residual[:, :, i, None, :] - books[i]) ** 2).sum(-1) for i in range(parts)], axis=2).astype("f4")
        held = spark.sparkContext.broadcast((ids, cells, tables))

        def run(batches, held=held):
            ids, cells, tables = held.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            for b in batches:
                at, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
                code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1).astype(np.int64)
                for v in np.unique(cell):
                    mine = np.flatnonzero(cell == v)
                    for i, j in zip(*np.nonzero(cells == v), strict=True):
                        d = tables[i, j][np.arange(code.shape[1])[None, :], code[mine]].sum(1).astype("f8")
                        d, x = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], at[mine]])
                        o = np.lexsort((x, d))[:refine]
                        best[i] = (d[o], x[o])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(d) for d, _ in best])), pa.array(np.concatenate([np.zeros(0, np.int64), *[x for _, x in best]])), pa.array(np.concatenate([np.zeros(0), *[d for d, _ in best]]))], ["query_id", "id", "near"])

        found = coded.select("id", "cell", "code").mapInArrow(run, "query_id long, id long, near double")
        near = found if near is None else near.unionByName(found)
    short = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "id"))).filter(F.col("r") <= refine)
    full = short.join(index.postings.select("id", "v"), "id").join(stated, "query_id")
    best = top(full.select("query_id", "id", distance(index.metric, F.col("q"), F.col("v")).alias("distance")), k, "distance", ascending=True)
    return filled(best, index.postings, queries, k, index.metric)

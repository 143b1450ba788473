"""Collections of chunks with their vectors: insert, build an index, search by text or vector."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from ..session import cut
from . import ivf
from .dedup import insert_new
from .embedding import embed
from .knn import filtered, flat_knn

RECORD = "text string, doc_id string, hash64 decimal(20,0)"
KINDS = ("flat", "ivf", "ivf_pq")


@dataclass
class Collection:
    """Rows ``(id, text, doc_id, hash64, embedding, ...)``; ids are dense in the order of insertion.

    A record whose hash is stored already, or came earlier in its batch, is not
    inserted again; records without a hash always are. Inserts leave the index
    as it was built: rebuild it to have later rows in it. A search with filters
    is flat over the rows that meet them.
    """

    spark: SparkSession
    dim: int
    metric: str = "cosine"
    rows: DataFrame | None = None
    kind: str = "flat"
    index: ivf.Ivf | None = None
    codes: tuple[DataFrame, np.ndarray] | None = None
    size: int = 0

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"no metric {self.metric}; there are {METRICS}")

    def insert(self, batch: DataFrame, order: str) -> int:
        """Add the rows ``(text, doc_id, hash64, embedding, ...)``, the first by ``order`` of equal hashes; the number added."""
        if (wrong := batch.filter(F.size("embedding") != self.dim).count()) > 0:
            raise ValueError(f"{wrong} vectors have not {self.dim} numbers")
        stored = self.rows if self.rows is not None else self.spark.createDataFrame([], f"id long, {RECORD}")
        new = cut(insert_new(stored, batch, "hash64", order))
        self.rows = new if self.rows is None else cut(self.rows.unionByName(new, allowMissingColumns=True))
        added = new.count()
        self.size += added
        return added

    def build_index(self, kind: str = "flat", cells: int = 4096, parts: int = 8, codes: int = 256) -> None:
        if kind not in KINDS:
            raise ValueError(f"no index {kind}; there are {KINDS}")
        if kind != "flat" and not self.size:
            raise RuntimeError("an empty collection has no cells")
        self.kind = kind
        self.index = ivf.build(self.rows, cells, self.metric) if kind != "flat" else None
        self.codes = None
        if kind == "ivf_pq":
            coded, books = ivf.product_codes(self.index, parts, codes)
            self.codes = (cut(coded), books)

    def search(self, queries: DataFrame, k: int = 10, filters: dict | None = None, nprobe: int = 16, refine: int = 200) -> DataFrame:
        """``(query_id, id, distance, rank, text, doc_id)`` of each query ``(query_id, q)``."""
        if self.rows is None:
            return self.spark.createDataFrame([], "query_id long, id long, distance double, rank int, text string, doc_id string")
        if filters or self.index is None:
            found = flat_knn(filtered(self.rows, filters or {}), queries, k, self.metric)
        elif self.codes is not None:
            found = ivf.code_search(self.index, *self.codes, queries, k, nprobe, refine)
        else:
            found = self.index.search(queries, k, nprobe)
        return found.select("query_id", "id", "distance", "rank").join(self.rows.select("id", "text", "doc_id"), "id")


@dataclass
class Store:
    """Named collections that share a model: texts go in and are asked for as texts, vectors as vectors."""

    spark: SparkSession
    model: Callable[[list[str]], np.ndarray]
    collections: dict[str, Collection] = field(default_factory=dict)

    def create(self, name: str, dim: int, metric: str = "cosine") -> Collection:
        if name in self.collections:
            raise ValueError(f"there is a collection {name}")
        self.collections[name] = Collection(self.spark, dim, metric)
        return self.collections[name]

    def insert(self, name: str, records: DataFrame, order: str) -> int:
        """``records (text, doc_id, hash64, ...)`` with or without an ``embedding``; blank texts without one are left out."""
        if "embedding" not in records.columns:
            records = embed(records, self.model)
        return self.collections[name].insert(records.filter("embedding is not null"), order)

    def search(self, name: str, asked: str | list[str] | list[list[float]] | DataFrame, k: int = 10, **how) -> DataFrame:
        """One text, texts or vectors, numbered from 0, or a table ``(query_id, q)`` or ``(query_id, query)``."""
        if isinstance(asked, str):
            asked = [asked]
        if isinstance(asked, list):
            kind = "query string" if not asked or isinstance(asked[0], str) else "q array<double>"
            asked = self.spark.createDataFrame(list(enumerate(asked)), f"query_id long, {kind}")
        if "q" not in asked.columns:
            asked = embed(asked, self.model, "query", name="q").filter("q is not null")
        return self.collections[name].search(asked.select("query_id", "q"), k, **how)

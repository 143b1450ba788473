"""Hybrid retrieval over a chunk graph: seeds, level-by-level beam, merged contexts.

Terms and vectors are looked up in indexes that are built once (:class:`Indexes`)
or, without them, in one pass over the chunks.

A batch of queries ``(query_id, query, q)`` runs at once. Tables that grow are
the chunks ``(id, doc_id, index, start, end, text, embedding)``; all that is
per query (seeds, frontiers, contexts) is bounded by the parameters times the
number of queries; whether that is small enough to broadcast is Spark's choice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_phrase
from ..functions.vectors import min_max, query_similarity, similarity
from ..session import cut
from .ivf import Ivf
from .ivf import build as build_cells
from .knn import flat_knn, neighbour_graph
from .lexical import TermIndex, bm25, index_terms, top


#: Scores are rounded before they are ranked, so that equal ones are ties whatever the order of their sums.
DIGITS = 9


@dataclass(frozen=True)
class Params:
    metric: str = "cosine"
    seeds_semantic: int = 64
    seeds_lexical: int = 64
    weight_semantic: float = 0.6
    weight_lexical: float = 0.3
    bonus_adjacent: float = 0.1
    bonus_phrase: float = 0.1
    depth: int = 3
    beam: int = 8
    neighbours: int = 8
    decay: float = 0.85
    most_expansions: int = 2000
    nodes: int = 24
    above: int = 2
    below: int = 2
    most_chars: int = 2000


def adjacency(chunks: DataFrame) -> DataFrame:
    """``(id, prev, next, pos)``: neighbours within a document by (index, id), across gaps in the index."""
    order = Window.partitionBy("doc_id").orderBy("index", "id")
    return chunks.select("id", F.lag("id").over(order).alias("prev"), F.lead("id").over(order).alias("next"), F.row_number().over(order).alias("pos"))


@dataclass
class Indexes:
    """What a retriever looks up: an inverted index of the texts, cells of the vectors, and the order of the chunks."""

    terms: TermIndex
    cells: Ivf | None
    adjacent: DataFrame
    nprobe: int = 16

    @staticmethod
    def of(chunks: DataFrame, cells: int | None = None, metric: str = "cosine", nprobe: int = 16) -> Indexes:
        """Without ``cells`` vectors are searched flat."""
        return Indexes(index_terms(chunks), build_cells(chunks, cells, metric) if cells else None, cut(adjacency(chunks)), nprobe)


def near_vectors(chunks: DataFrame, queries: DataFrame, k: int, metric: str, indexes: Indexes | None) -> DataFrame:
    """``(query_id, id, distance, rank)`` from the cells, or from a flat search where there are none."""
    if indexes is not None and indexes.cells is not None:
        return indexes.cells.search(queries, k, indexes.nprobe)
    return flat_knn(chunks, queries, k, metric)


def near_nodes(chunks: DataFrame, nodes: DataFrame, k: int, metric: str, indexes: Indexes | None) -> DataFrame:
    """``(src, dst)``: the ``k`` nearest others of each node."""
    if indexes is None or indexes.cells is None:
        return neighbour_graph(chunks, nodes, k, metric).select("src", "dst")
    q = indexes.cells.postings.join(nodes, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = indexes.cells.search(q, k + 1, indexes.nprobe).filter("query_id <> id")
    return top(found.drop("rank"), k, "distance", ascending=True).select(F.col("query_id").alias("src"), F.col("id").alias("dst"))


def seeds(chunks: DataFrame, queries: DataFrame, lexical: DataFrame, p: Params = Params(), indexes: Indexes | None = None) -> DataFrame:
    """``(query_id, id, score)``: the union of the semantic and lexical best, weighted scores summed, phrase bonus added.

    ``lexical``: ``(query_id, id, lex)`` scaled to 0 to 1.
    """
    near = near_vectors(chunks, queries.select("query_id", "q"), p.seeds_semantic, p.metric, indexes)
    sem = near.select("query_id", "id", (p.weight_semantic * similarity(p.metric, F.col("distance"))).alias("score"))
    lex = top(lexical, p.seeds_lexical, "lex").select("query_id", "id", (p.weight_lexical * F.col("lex")).alias("score"))
    both = sem.unionAll(lex).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    said = both.join(chunks.select("id", "text"), "id").join(queries.select("query_id", "query"), "query_id")
    return said.select("query_id", "id", F.round(F.col("score") + F.when(has_phrase(F.col("text"), F.col("query")), p.bonus_phrase).otherwise(0.0), DIGITS).alias("score"))


def scaled_lexical(chunks: DataFrame, queries: DataFrame, indexes: Indexes | None = None) -> DataFrame:
    """``(query_id, id, lex)``: BM25 scaled to 0 to 1 within each query; a single hit scores 0."""
    scores = indexes.terms.search(queries) if indexes is not None else bm25(chunks, queries)
    return min_max(scores, "score", "query_id", "lex").select("query_id", "id", F.round("lex", DIGITS).alias("lex"))


def beam(chunks: DataFrame, queries: DataFrame, start: DataFrame, lexical: DataFrame, adjacent: DataFrame, p: Params = Params(), indexes: Indexes | None = None) -> DataFrame:
    """``(query_id, id, score)``: the best score of every node that the beam expanded.

    Each level keeps the ``beam`` best rows of a query's frontier, in which a
    node may stand twice; each of them passes its ``beam`` best neighbours on.
    Only rows of the frontier are scored; a query stops after
    ``most_expansions - 1`` rows.
    """
    front = top(start, p.beam).select("query_id", "id", "score")
    seen = None
    for level in range(p.depth + 1):
        front = cut(front)
        seen = front if seen is None else seen.unionByName(front)
        if level == p.depth or p.beam * (level + 1) >= p.most_expansions:
            break
        nodes = front.select("id").distinct()
        local = adjacent.join(nodes, "id").select(F.col("id").alias("src"), F.explode(F.array_compact(F.array("prev", "next"))).alias("dst"), F.lit(p.bonus_adjacent).alias("bonus"))
        near = near_nodes(chunks, nodes, p.neighbours, p.metric, indexes).select("src", "dst", F.lit(0.0).alias("bonus"))
        edges = local.unionByName(near).filter("src <> dst").groupBy("src", "dst").agg(F.max("bonus").alias("bonus"))
        # One row number for each frontier row: equal nodes stay apart.
        numbered = front.withColumn("row", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
        steps = numbered.withColumnRenamed("id", "src").join(edges, "src").select("query_id", "row", "score", F.col("dst").alias("id"), "bonus")
        told = steps.join(lexical, ["query_id", "id"], "left").join(queries, "query_id").join(chunks.select("id", "text", "embedding"), "id")
        base = p.weight_semantic * query_similarity(p.metric, F.col("q"), F.col("embedding")) + p.weight_lexical * F.coalesce("lex", F.lit(0.0)) + F.col("bonus")
        fade = p.decay ** (level + 1)
        scored = told.select("query_id", "row", "id", "score", F.round(base, DIGITS).alias("base"), has_phrase(F.col("text"), F.col("query")).alias("phrase")).filter("base > 0")
        passed = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("base"), "id"))).filter(F.col("r") <= p.beam)
        grown = passed.select("query_id", "id", F.round(F.col("score") + fade * F.col("base") + F.when(F.col("phrase"), p.bonus_phrase * fade).otherwise(0.0), DIGITS).alias("score"), "row")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "row")
        front = grown.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= p.beam).select("query_id", "id", "score")
    return seen.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def merged_spans(chunks: DataFrame, scores: DataFrame, p: Params = Params()) -> DataFrame:
    """Contexts: windows round the best nodes, overlapping or touching ones of a document merged.

    Windows walk along existing neighbours; whether they touch is judged on
    chunk indexes, so a gap that deduplication left keeps them apart.
    """
    scores = cut(scores)
    best = top(scores, p.nodes).select("query_id", "id", "score")
    docs = chunks.join(best.select("id").distinct(), "id", "left_semi").select("doc_id").distinct()
    # Only chunks of documents that have a best node are put in order.
    order = Window.partitionBy("doc_id").orderBy("index", "id")
    inside = chunks.join(docs, "doc_id", "left_semi").select("id", "doc_id", "index", "start", "end", "text", F.row_number().over(order).alias("pos"))
    mine = inside.join(best, "id").select("query_id", "doc_id", "pos")
    last = inside.groupBy("doc_id").agg(F.max("pos").alias("last"))
    span = mine.join(last, "doc_id").select("query_id", "doc_id", F.greatest(F.lit(1), F.col("pos") - p.above).alias("a"), F.least("last", F.col("pos") + p.below).alias("b"))
    index = inside.select("doc_id", "pos", "index")
    span = span.join(index.select("doc_id", F.col("pos").alias("a"), F.col("index").alias("ia")), ["doc_id", "a"]).join(index.select("doc_id", F.col("pos").alias("b"), F.col("index").alias("ib")), ["doc_id", "b"])
    by = Window.partitionBy("query_id", "doc_id").orderBy("ia", "ib", "a", "b")
    before = F.max("ib").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("ia") <= before + 1, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    ranges = span.withColumn("island", island).groupBy("query_id", "doc_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    members = inside.join(ranges, "doc_id").filter("pos between a and b").join(scores.select("query_id", "id", "score"), ["query_id", "id"], "left")
    grouped = members.groupBy("query_id", "doc_id", "island").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "index", "start", "end", "text"))).alias("m"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score")
    )
    joined = F.array_join(F.transform("m", lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    text = F.when(F.length(joined) > p.most_chars, F.concat(F.substring(joined, 1, p.most_chars), F.lit("…"))).otherwise(joined)
    first, last = F.element_at("m", 1), F.element_at("m", -1)
    out = grouped.select(
        "query_id", "doc_id", first["id"].alias("start_node_id"), last["id"].alias("end_node_id"), first["index"].alias("start_index"), last["index"].alias("end_index"),
        first["start"].alias("start_char"), last["end"].alias("end_char"), "score", text.alias("text"), F.transform("m", lambda x: x["id"]).alias("node_ids"),
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "start_node_id")))


def retrieve(chunks: DataFrame, queries: DataFrame, p: Params = Params(), indexes: Indexes | None = None) -> DataFrame:
    """The contexts of every query, best first; ``indexes`` serve any number of calls."""
    lexical = cut(scaled_lexical(chunks, queries, indexes))
    adjacent = indexes.adjacent if indexes is not None else cut(adjacency(chunks))
    start = seeds(chunks, queries, lexical, p, indexes)
    return merged_spans(chunks, beam(chunks, queries, start, lexical, adjacent, p, indexes), p)

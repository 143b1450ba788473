"""BM25: in one pass over the texts for the terms that are asked for, or from an index that is kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import cut

K1, B = 0.9, 0.4


def term_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(term, df, cf, idf)`` over all texts."""
    tokens = docs.select(tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    n = docs.agg(F.count("*").alias("n"))
    # A text counts each of its terms once for df and every token for cf; both are added up before the shuffle.
    once = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf")))
    each = F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    rows = tokens.select(F.explode(F.concat(once, each)).alias("t"))
    stats = rows.groupBy(F.col("t.term").alias("term")).agg(F.sum("t.df").alias("df"), F.sum("t.cf").alias("cf"))
    return stats.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of texts and their average length in tokens."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokenize(F.coalesce(F.col(text), F.lit(""))))).alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, id, score)`` of all texts that share a term with a query ``(query_id, query)``.

    Only the queries' own terms are kept, by a join in the scan's stage, and
    counted before anything is shuffled; document frequencies come from the
    same rows.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))
    tokens = docs.select(F.col(key).alias("id"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    corpus = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    each = tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    postings = cut(each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return _scored(postings.join(df, "term").join(terms, "term").crossJoin(F.broadcast(corpus)), k1, b)  # one row


@dataclass
class TermIndex:
    """An inverted index: ``postings (term, id, tf, dl, df)`` in ranges of terms, and ``corpus (n, avgdl)``, one row.

    A search reads the postings of its own terms; a frequent term lies in many ranges of ids.
    """

    postings: DataFrame
    corpus: DataFrame

    def save(self, path: str) -> None:
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TermIndex:
        return TermIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus"))

    def search(self, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
        """``(query_id, id, score)`` of all texts that share a term with a query ``(query_id, query)``, as :func:`bm25`."""
        terms = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))
        rows = self.postings.join(terms, "term").crossJoin(F.broadcast(self.corpus))  # one row
        return _scored(rows, k1, b)


def index_terms(docs: DataFrame, key: str = "id", text: str = "text") -> TermIndex:
    """The index of all texts; document frequencies are counted from the postings and travel with them."""
    tokens = docs.select(F.col(key).alias("id"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    each = tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    rows = cut(each.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    corpus = cut(docs.agg(F.count("*").alias("n")).crossJoin(rows.groupBy().agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("all"))).select("n", (F.col("all") / F.greatest(F.lit(1), F.col("n"))).alias("avgdl")))
    return TermIndex(cut(rows.join(df, "term").repartitionByRange("term", "id").sortWithinPartitions("term", "id")), corpus)


def _scored(rows: DataFrame, k1: float, b: float) -> DataFrame:
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    damp = F.greatest(F.lit(1e-9), F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl"))))
    return rows.groupBy("query_id", "id").agg(F.sum(idf * F.col("tf") * (k1 + 1) / damp).alias("score")).filter("score > 0")


def top(scores: DataFrame, k: int, by: str = "score", group: str = "query_id", id_: str = "id", ascending: bool = False) -> DataFrame:
    """The best ``k`` of each group with their ``rank``; ties go to the smaller id."""
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, id_))).filter(F.col("rank") <= k)

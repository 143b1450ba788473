"""Duplicates by hash: across chunks, on insert, and first sight in a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flat
from ..session import cut


def least_of_hash(df: DataFrame, hash_: str, order: list[str]) -> DataFrame:
    """Rows whose ``order`` is the least of their hash; rows tied on all of it stay, rows without a hash too.

    The least key of each hash is aggregated before the shuffle and joined
    back, so a hot hash is never sorted in one task.
    """
    key = F.struct(*order)
    least = df.filter(F.col(hash_).isNotNull()).groupBy(hash_).agg(F.min(key).alias("_least"))
    return df.join(least, hash_, "left").filter(F.col("_least").isNull() | (key == F.col("_least"))).select(*df.columns)


def insert_new(stored: DataFrame, batch: DataFrame, hash_: str, order: str, id_: str = "id") -> DataFrame:
    """The rows of ``batch`` that an insert adds, with dense ids after those stored.

    The first of equal hashes wins, against the stored rows and within the
    batch; rows without a hash are always new. Ids count within ranges of the
    order and add the ranges' sums, so nothing is numbered in one task.
    """
    first = least_of_hash(batch, hash_, [order])
    known = stored.select(hash_).filter(F.col(hash_).isNotNull()).distinct()
    fresh = first.join(known, hash_, "left_anti").select(*batch.columns)
    top = stored.agg(F.coalesce(F.max(id_), F.lit(-1)).alias("_top"))
    return numbered(fresh, [order], id_).crossJoin(F.broadcast(top)).withColumn(id_, F.col(id_) + F.col("_top") + 1).drop("_top")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row in the order of the whole table, from 0."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    base = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for each range
    base = base.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + within).drop("_at", "_part", "_base")


def ingest_counts(records: DataFrame, text: str, hash_: str, stored: DataFrame | None = None) -> DataFrame:
    """One row: rows in all, without text, with text, and inserted."""
    filled = records.withColumn("_t", flat(F.coalesce(F.col(text), F.lit(""))))
    some = filled.filter("_t <> ''")
    if stored is not None:
        some = some.join(stored.select(hash_).distinct(), hash_, "left_anti")
    per = filled.agg(F.count("*").alias("total"), F.count_if(F.col("_t") == "").alias("empty_text"), F.count_if(F.col("_t") != "").alias("embedded"))
    new = some.groupBy(hash_).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col(hash_).isNull(), F.col("n")).otherwise(1)), F.lit(0)).alias("inserted"))
    return per.crossJoin(new)


def first_seen(messages: DataFrame) -> DataFrame:
    """``(conv_id, content_hash, first_msg_id)``."""
    return messages.groupBy("conv_id", "content_hash").agg(F.min("msg_id").alias("first_msg_id"))

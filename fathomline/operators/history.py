"""The message log: keyed reads, context selection under a token budget, the hash chain, branches."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import blake64_signed, sha256
from ..functions.text import message_tokens
from ..functions.vectors import cosine, hamming_penalty, recency

THREAD = ["conv_id", "branch_id"]
KEY = [*THREAD, "msg_id"]
# The weight of a message by its role code.
ROLE_WEIGHTS = [0.7, 1.0, 0.9, 0.6]


def role_weight(role: Column) -> Column:
    """The weight of a role code; an unknown or null one weighs nothing."""
    out = F.when(role == 0, ROLE_WEIGHTS[0])
    for code, weight in enumerate(ROLE_WEIGHTS[1:], 1):
        out = out.when(role == code, weight)
    return out.otherwise(0.0)


def by_keys(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """Messages of a key table ``(conv_id, branch_id, msg_id)``."""
    return messages.join(keys.select(*KEY).distinct(), KEY)


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` of every thread by arrival, with ``back``, 1 for the last."""
    order = Window.partitionBy(*THREAD).orderBy(F.desc("msg_id"), F.desc("ts"))
    return messages.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n)


def latest(messages: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of the latest ``ts``; ties go to the smaller id."""
    return messages.orderBy(F.desc_nulls_last("ts"), "msg_id").limit(n)


def duplicate_penalty(messages: DataFrame, refs: int = 64) -> DataFrame:
    """``messages`` with ``dup``, against the stored hashes of the last ``refs`` of the thread; a message counts against itself."""
    last = recent(messages, refs).groupBy(*THREAD).agg(F.collect_list("simhash_i64").alias("refs"))
    return messages.join(last, THREAD, "left").withColumn("dup", hamming_penalty(F.col("simhash_i64"), F.coalesce("refs", F.array().cast("array<bigint>")))).drop("refs")


def context_score(messages: DataFrame, alpha: float = 1.0, beta: float = 0.3, gamma: float = 0.1, delta: float = 0.5, sim: Column | None = None) -> DataFrame:
    """``messages`` (with ``dup``) with ``score``: similarity, recency and role for it, duplication against it."""
    newest = messages.groupBy(*THREAD).agg(F.max("ts").alias("newest"))
    messages = messages.join(newest, THREAD)
    score = alpha * (sim if sim is not None else F.lit(0.0)) + beta * recency(F.col("newest"), F.col("ts")) + gamma * role_weight(F.col("role")) - delta * F.col("dup")
    return messages.withColumn("score", score).drop("newest")


def within_budget(rows: DataFrame, budget: int, group: list[str], score: str = "score", tokens: str = "token_count", id_: str = "msg_id") -> DataFrame:
    """The prefix, by score for each token, whose tokens sum up to at most ``budget``; what follows the first too many is out."""
    ratio = F.col(score) / (F.coalesce(F.col(tokens), F.lit(0)) + F.lit(1.1920928955078125e-07))
    order = Window.partitionBy(*group).orderBy(ratio.desc(), id_)
    used = F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).filter(F.col("used") <= budget)


def build_context(messages: DataFrame, vectors: DataFrame, queries: DataFrame, budget: int = 256, shortlist: int = 96, rerank: int = 64, window: int = 128) -> DataFrame:
    """``(query_id, conv_id, branch_id, msg_id, turn, content)``: the messages chosen for each query ``(query_id, conv_id, branch_id, q)``, in order of time.

    ``vectors``: ``(conv_id, branch_id, msg_id, embedding)``. Candidates are
    the nearest of all messages that lie in the thread, and its last
    ``window``; system messages come in by the window only.
    """
    from .knn import flat_knn

    uid = F.xxhash64(*KEY)
    spoken = messages.filter(F.col("role").isin(1, 2, 3)).select(*KEY).join(vectors, KEY)
    near = flat_knn(spoken.withColumn("id", uid), queries.select("query_id", "q"), shortlist).select("query_id", "id")
    keyed = messages.withColumn("id", uid)
    semantic = near.join(keyed.select("id", *KEY), "id").join(queries.select("query_id", *THREAD), ["query_id", *THREAD]).select("query_id", *KEY)
    threads = queries.select("query_id", *THREAD)
    last = recent(messages.join(threads.select(*THREAD).distinct(), THREAD, "left_semi"), window).join(threads, THREAD).select("query_id", *KEY)
    chosen = semantic.union(last).distinct()
    told = duplicate_penalty(messages.join(threads.select(*THREAD).distinct(), THREAD, "left_semi"))
    newest = told.groupBy(*THREAD).agg(F.max("ts").alias("newest"))
    rows = told.join(newest, THREAD).join(chosen, KEY).join(vectors, KEY, "left").join(queries.select("query_id", "q"), "query_id")
    sim = F.coalesce(cosine(F.col("q"), F.col("embedding")), F.lit(0.0))
    rows = rows.withColumn("sim", sim).withColumn("score", sim + 0.3 * recency(F.col("newest"), F.col("ts")) + 0.1 * role_weight(F.col("role")) - 0.5 * F.col("dup"))
    fit = within_budget(rows, budget, ["query_id"])
    best = fit.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "msg_id"))).filter(F.col("r") <= rerank)
    return best.select("query_id", *KEY, F.row_number().over(Window.partitionBy("query_id").orderBy("ts", "msg_id")).alias("turn"), "content")


def _link(prev: bytes, role: int | None, ts: float | None, content: str | None) -> bytes | None:
    if prev is None or role is None or ts is None or content is None or not 0 <= role <= 255:
        return None
    return hashlib.sha256(prev + bytes([role]) + str(float(ts)).encode() + content.encode()).digest()


def chain_check(messages: DataFrame) -> DataFrame:
    """``(conv_id, branch_id, msg_id, hash_ok, content_ok)``: whether each row's own link of the chain and content hash hold.

    A link needs only its row, so nothing is shuffled; whether links follow
    one another is :func:`chain_order`.
    """

    def run(batches):
        for b in batches:
            prev, role, ts, content, said = (b.column(i).to_pylist() for i in range(3, 8))
            links = [_link(*x) for x in zip(prev, role, ts, content, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([None if x is None or y is None else x == y for x, y in zip(links, said, strict=True)], pa.bool_()), b.column(8)], [*b.schema.names[:3], "hash_ok", "content_ok"])

    fine = F.col("content_hash") == sha256(F.col("content"))
    rows = messages.select(*KEY, "chain_prev", F.col("role").cast("int").alias("role"), F.col("ts").cast("double").alias("ts"), "content", "chain_hash", fine.alias("content_ok"))
    return rows.mapInArrow(run, "conv_id string, branch_id string, msg_id long, hash_ok boolean, content_ok boolean")


def chain_order(messages: DataFrame) -> DataFrame:
    """``(conv_id, branch_id, msg_id, linked)``: whether ``chain_prev`` is the hash of some message of the conversation, or the start of a chain."""
    hashes = messages.select("conv_id", F.col("chain_hash").alias("chain_prev")).distinct().withColumn("known", F.lit(True))
    start = F.col("chain_prev") == F.unhex(F.lit("00" * 32))
    rows = messages.select(*KEY, "chain_prev").distinct()
    return rows.join(hashes, ["conv_id", "chain_prev"], "left").select(*KEY, (start | F.coalesce("known", F.lit(False))).alias("linked"))


def append(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows that an append of ``batch`` adds: keys not stored yet, hashes computed, chained after each thread's tip.

    Of a key that the batch has more than once the row with the smallest ts
    counts, then the smallest of the rest, so a replay makes the same chain.

    ``batch``: ``(conv_id, branch_id, msg_id, role, ts, token_count,
    parent_msg_id, content)``. A chain is a fold along its thread; it runs
    over the new rows of one thread at a time.
    """
    rest = [c for c in batch.columns if c not in (*KEY, "ts")]
    once = batch.groupBy(*KEY).agg(F.min(F.struct("ts", *rest)).alias("m")).select(*KEY, "m.*")
    fresh = once.join(stored.select(*KEY), KEY, "left_anti")
    tips_ = tips(stored)
    rows = fresh.join(tips_.select(*THREAD, "tip_hash"), THREAD, "left").select(
        *KEY, F.col("role").cast("tinyint").alias("role"), F.col("ts").cast("double").alias("ts"), F.coalesce(F.col("token_count").cast("int"), message_tokens(F.col("content"))).alias("token_count"), F.col("parent_msg_id").cast("long").alias("parent_msg_id"), "content",
        sha256(F.col("content")).alias("content_hash"), blake64_signed(F.col("content")).alias("simhash_i64"), F.coalesce("tip_hash", F.unhex(F.lit("00" * 32))).alias("tip"),
    )

    def fold(batches):
        now, last = None, None
        for b in batches:
            prev, mine = [], []
            for c, r, role, ts, content, tip in zip(*(b.column(n).to_pylist() for n in ("conv_id", "branch_id", "role", "ts", "content", "tip")), strict=True):
                if (c, r) != now:
                    now, last = (c, r), tip
                prev.append(last)
                last = _link(last, role, ts, content) or last
                mine.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prev, pa.binary()), pa.array(mine, pa.binary())], [*b.schema.names[:-1], "chain_prev", "chain_hash"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "tip")
    # Rows of a thread meet in one sorted run and are folded as they stream by.
    return rows.repartition(*THREAD).sortWithinPartitions(*THREAD, "msg_id").mapInArrow(fold, f"{kinds}, chain_prev binary, chain_hash binary")


def tips(messages: DataFrame) -> DataFrame:
    """``(conv_id, branch_id, tip_hash, last_msg_id)``: the last state of each branch, by arrival."""
    return messages.groupBy(*THREAD).agg(F.max_by("chain_hash", "msg_id").alias("tip_hash"), F.max("msg_id").alias("last_msg_id"))


def upsert_tips(held: DataFrame, new: DataFrame) -> DataFrame:
    """Tip rows ``(conv_id, branch_id, tip_hash, last_msg_id)`` with the later of both for each branch."""
    both = held.select(*THREAD, "tip_hash", "last_msg_id").unionByName(new.select(*THREAD, "tip_hash", "last_msg_id"))
    return both.groupBy(*THREAD).agg(F.max(F.struct("last_msg_id", "tip_hash")).alias("m")).select(*THREAD, "m.tip_hash", "m.last_msg_id")


def upsert_meta(held: DataFrame, new: DataFrame) -> DataFrame:
    """Values ``(key, value)`` with those of ``new`` put in place of held ones."""
    return held.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new.select("key", "value"))


def fork(messages: DataFrame, tips_: DataFrame, conv: str, branch: str, new: str, at: int | None = None) -> DataFrame:
    """The tip row of a new branch: the old tip, or the state after message ``at``. No message is copied."""
    if at is None:
        row = tips_.filter((F.col("conv_id") == conv) & (F.col("branch_id") == branch)).select("conv_id", F.lit(new).alias("branch_id"), "tip_hash", "last_msg_id")
    else:
        row = messages.filter((F.col("conv_id") == conv) & (F.col("branch_id") == branch) & (F.col("msg_id") == at)).select("conv_id", F.lit(new).alias("branch_id"), F.col("chain_hash").alias("tip_hash"), F.col("msg_id").alias("last_msg_id"))
    row = row.limit(1)
    if row.isEmpty():
        raise ValueError(f"no message {at} in {conv}/{branch}")
    return row

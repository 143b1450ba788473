"""Problem 3: message rows reassembled into ordered dialogs.

Method: the log is read as exports, runs of rows in the order of arrival. What
an export holds of one thread is a fragment, cut anew wherever a message does
not follow the one before it. A fragment is a run of message hashes: the stored
chain names the hash of each message and of the one that it follows, so a
fragment begins with the hash at which another ends if they overlap. Where a
suffix equals one prefix only, and that prefix one suffix, the two are merged;
a thread whose fragments are not one such path, or whose path does not begin
at the start of a chain or at a message of its conversation, has a gap: an
export is missing. A thread of any length is many bounded fragments, spread
over exports, and never one task.

Defined results: rows with a null msg_id are ignored; of a repeated msg_id the
row with the smallest ``ts`` counts (then smallest conv_id, branch_id and role;
a null ts comes last); ties in ts are ordered by msg_id; null conv_id or
branch_id are values of their own; a row without hashes follows nothing. A
table without the columns of the chain is taken to have no gaps. Empty input
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

THREAD = ["conv_id", "branch_id"]
#: the columns of the chain: hash of the message before, hash of the message
CHAIN = ("chain_prev", "chain_hash")
#: rows of an export that are looked at together
RUN = 1 << 16
ROLES = {0: "system", 1: "user", 2: "assistant", 3: "tool"}


def single_rows(messages: DataFrame) -> DataFrame:
    """One row for each msg_id, with its content."""
    far = F.lit(float("inf"))
    row = F.struct(F.coalesce("ts", far).alias("ts"), *THREAD, F.col("role").cast("int").alias("role"), "content")
    return messages.filter("msg_id is not null").groupBy("msg_id").agg(F.min(row).alias("m")).select("msg_id", "m.*")


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, the place in the order of thread, ts and msg_id over the whole table.

    Ranges are sorted in parallel; only one count for each range is summed up.
    """
    order = [*THREAD, "ts", "msg_id"]

    def number(batches):
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(m, part, np.int32)), pa.array(np.arange(n, n + m))], [*b.schema.names, "part", "idx"])
            n += m

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    table = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{kinds}, part int, idx long"))
    counts = table.groupBy("part").agg(F.count("*").alias("n"))  # one row for each range
    base = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return table.join(F.broadcast(base), "part").withColumn("pos", F.col("base") + F.col("idx")).drop("part", "idx", "base")


def _chain(messages: DataFrame) -> list:
    """128 bits of the hash that a message follows and of its own; both null without the columns."""
    if not set(CHAIN) <= set(messages.columns):
        return [F.lit(None).cast("binary").alias(c) for c in ("prev", "hash")]
    return [F.substring(F.col(c).cast("binary"), 1, 16).alias(n) for c, n in zip(CHAIN, ("prev", "hash"), strict=True)]


def fragments(messages: DataFrame, run: int = RUN) -> DataFrame:
    """One row for each fragment: ``prefix`` and ``suffix`` hashes and what its rows say about the thread.

    Rows are ranged by msg_id, the order of arrival, so no thread is gathered.
    ``first`` is the first row that is no system row, ``last`` the last one of
    a user or assistant, by (ts, msg_id).
    """
    said = F.coalesce(F.col("content").rlike(r"[^\s\p{Z}\p{Cc}]"), F.lit(False)).alias("said")
    ts = F.coalesce(F.col("ts").cast("double"), F.lit(float("inf"))).alias("ts")
    row = F.struct(ts, F.col("conv_id").cast("string").alias("conv_id"), F.col("branch_id").cast("string").alias("branch_id"), F.coalesce(F.col("role").cast("int"), F.lit(-1)).alias("role"), said, *_chain(messages))
    once = messages.filter("msg_id is not null").groupBy(F.col("msg_id").cast("long").alias("msg_id")).agg(F.min(row).alias("m")).select("msg_id", "m.*")
    ordered = once.repartitionByRange("msg_id").sortWithinPartitions("msg_id")
    chained = set(CHAIN) <= set(messages.columns)

    def grouped(t: pa.Table):
        n = t.num_rows
        ids, when, role, spoken = (t.column(c).to_numpy() for c in ("msg_id", "ts", "role", "said"))
        codes = [pc.dictionary_encode(t.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in THREAD]
        o = np.lexsort((np.arange(n), codes[1], codes[0]))
        new = np.concatenate([[True], (codes[0][o][1:] != codes[0][o][:-1]) | (codes[1][o][1:] != codes[1][o][:-1])])
        if chained:
            follows = pc.equal(t.column("prev").take(pa.array(o[1:])), t.column("hash").take(pa.array(o[:-1])))
            new[1:] |= ~pc.fill_null(follows, False).combine_chunks().to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new)
        end = np.append(start[1:], n)
        frag = np.cumsum(new) - 1
        ids, when, role, spoken = (x[o] for x in (ids, when, role, spoken))
        turn = (role == 1) | (role == 2)
        count = lambda mask: np.bincount(frag[mask], minlength=len(start)).astype(np.int64)

        def edge(mask, which):
            """ts, msg_id and role of the first or last row of each fragment in ``mask``; no row: null."""
            at = np.flatnonzero(mask)
            at = at[np.lexsort((ids[at], when[at], frag[at]))]
            f = frag[at]
            pick = np.concatenate([[True], f[1:] != f[:-1]]) if which == "first" else np.concatenate([f[1:] != f[:-1], [True]])
            pick = at[pick[: len(at)]]
            full = np.full(len(start), -1)
            full[frag[pick]] = pick
            none = pa.array(full < 0)
            return [pc.if_else(none, None, pa.array(x[np.maximum(full, 0)])) for x in (when, ids, role)]

        firsts, ends = pa.array(o[start]), pa.array(o[end - 1])
        cols = [
            *(t.column(c).take(firsts) for c in THREAD), t.column("prev").take(firsts), t.column("hash").take(ends), pa.array((end - start).astype(np.int64)),
            *(pa.array(count(m)) for m in (turn & spoken, (role < 0) | (role > 3), (role == 2) & ~spoken)), *edge(role != 0, "first"), *edge(turn, "last"),
        ]
        return pa.Table.from_arrays(cols, _FRAGMENT).combine_chunks().to_batches()

    def read(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= run:
                yield from grouped(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from grouped(pa.Table.from_batches(held))

    kinds = "conv_id string, branch_id string, prefix binary, suffix binary, rows long, said long, odd_roles long, blank_replies long, fts double, fid long, frole int, lts double, lid long, lrole int"
    out = ordered.mapInArrow(read, kinds)
    state = lambda k: F.when(F.col(f"{k}id").isNotNull(), F.struct(F.col(f"{k}ts").alias("ts"), F.col(f"{k}id").alias("msg_id"), F.col(f"{k}role").alias("role")))
    return out.select(*THREAD, "prefix", "suffix", "rows", "said", "odd_roles", "blank_replies", state("f").alias("first"), state("l").alias("last"))


_FRAGMENT = [*THREAD, "prefix", "suffix", "rows", "said", "odd_roles", "blank_replies", "fts", "fid", "frole", "lts", "lid", "lrole"]


def assemble(frags: DataFrame, messages: DataFrame) -> DataFrame:
    """One row for each thread from its fragments, with ``gap`` where the overlap graph is no single unambiguous path from a known start."""
    key = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in THREAD])  # equal threads have equal keys
    ends = frags.select(key.alias("thread"), F.col("suffix").alias("hash"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    starts = frags.select(key.alias("thread"), F.col("prefix").alias("hash"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    # A node of the overlap graph is a hash; only where it ends one fragment and begins one is there a way on.
    nodes = ends.unionByName(starts).filter("hash is not null").groupBy("thread", "hash").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    origin = F.unhex(F.lit("00" * 16))
    clear = nodes.filter("out = 1 and into = 1").groupBy("thread").agg(F.count("*").alias("links"))
    roots = nodes.filter("out = 0").select("thread", "hash")
    begun = roots.filter(F.col("hash") == origin).select("thread", F.lit(1).alias("starts"))
    if set(CHAIN) <= set(messages.columns):
        # Other starts are known if they are a message of the conversation: a branch begins there.
        other = roots.filter(F.col("hash") != origin).join(frags.select(key.alias("thread"), "conv_id").distinct(), "thread")
        said = messages.select(F.col("conv_id").alias("c"), F.substring(F.col(CHAIN[1]).cast("binary"), 1, 16).alias("hash"))
        forked = other.join(said, (other["hash"] == said["hash"]) & other["conv_id"].eqNullSafe(said["c"])).select("thread", other["hash"]).distinct()
        begun = begun.unionByName(forked.select("thread", F.lit(1).alias("starts")))
    parts = frags.select(*THREAD, key.alias("thread"), F.lit(1).alias("frags"), "rows", "said", "odd_roles", "blank_replies", "first", "last")
    merged = parts.groupBy(*THREAD, "thread").agg(F.sum("frags").alias("frags"), *[F.sum(c).alias(c) for c in ("rows", "said", "odd_roles", "blank_replies")], F.min("first").alias("first"), F.max("last").alias("last"))
    whole = merged.join(clear, "thread", "left").join(begun.groupBy("thread").agg(F.sum("starts").alias("starts")), "thread", "left")
    # A path over n fragments has n - 1 unambiguous links and one start.
    gap = (F.coalesce("links", F.lit(0)) != F.col("frags") - 1) | (F.coalesce("starts", F.lit(0)) != 1)
    return whole.withColumn("gap", gap if set(CHAIN) <= set(messages.columns) else F.lit(False)).drop("thread", "links", "starts")


def judge(threads: DataFrame) -> DataFrame:
    """``threads`` with ``reason``: null for a whole dialog, else the first that applies of empty, broken, no_reply, gap."""
    reason = (
        F.when(F.col("said") == 0, "empty")
        .when((F.col("odd_roles") > 0) | ~F.col("first.role").eqNullSafe(1), "broken")
        .when((F.col("blank_replies") > 0) | (F.col("last.role") == 1), "no_reply")
        .when(F.col("gap"), "gap")
    )
    return threads.withColumn("reason", reason)


def threads(messages: DataFrame, run: int = RUN) -> DataFrame:
    """The assembled and judged threads."""
    return judge(assemble(cut(fragments(messages, run)), messages))


def dropped_threads(messages: DataFrame, run: int = RUN) -> DataFrame:
    """``(conv_id, branch_id, reason)`` of the threads that make no dialog."""
    return threads(messages, run).filter("reason is not null").select(*THREAD, "reason")


def dialogs(messages: DataFrame, run: int = RUN) -> DataFrame:
    """``(conv_id, branch_id, turn, msg_id, role, speaker, content)`` of the whole dialogs, in order from turn 0."""
    good = threads(messages, run).filter("reason is null").select(F.col("conv_id").alias("c"), F.col("branch_id").alias("b"))
    rows = positions(single_rows(messages))
    starts = rows.groupBy(F.col("conv_id").alias("c"), F.col("branch_id").alias("b")).agg(F.min("pos").alias("from"))
    good = good.join(starts, good["c"].eqNullSafe(starts["c"]) & good["b"].eqNullSafe(starts["b"])).select(good["c"], good["b"], "from")
    kept = rows.join(good, rows["conv_id"].eqNullSafe(F.col("c")) & rows["branch_id"].eqNullSafe(F.col("b")))
    speaker = F.create_map(*[x for k, v in ROLES.items() for x in (F.lit(k), F.lit(v))])[F.col("role")]
    return kept.select(*THREAD, (F.col("pos") - F.col("from")).alias("turn"), "msg_id", "role", speaker.alias("speaker"), "content")

"""Problem 8: texts put into containers of a fixed number of tokens.

Method: length-histogram planning. Texts become pieces with a length in
tokens; best-fit runs over the counts of each length, not over texts, and
yields patterns of lengths with a number of repetitions; pieces then take the
planned slots by joining on their rank within their length.

The histogram has one row for each length up to the capacity, so the plan's
size is bounded by the capacity whatever the number of texts. Ranks come from
prefix sums over salted counts, so no length is ordered in one task.

Defined results: null and blank texts are left out; every other row comes out
exactly once, a text longer than the capacity as consecutive full pieces and a
rest; rows with equal keys are told apart by their piece's rank; empty input
gives an empty result.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .codepoints import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str = VOCABULARY):
    """The byte-level tokenizer of a rank file."""
    with open(path, "rb") as f:
        return _encoding(f.read())


def pieces(df: DataFrame, key: str, text: str, capacity: int, path: str = VOCABULARY, with_tokens: bool = False) -> DataFrame:
    """``(key, piece, start, n)``: the consecutive token ranges of each text, at most ``capacity`` each.

    The vocabulary is read on the driver and goes to the workers with the job,
    about a megabyte whatever the texts.
    """
    kind = df.schema[key].dataType.simpleString()
    with open(path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encode = _encoding(ranks.value).encode_ordinary_batch
        for b in slices(batches, "t"):
            rows, piece, start, n, held = [], [], [], [], []
            for i, ids in enumerate(encode(b.column(1).to_pylist(), num_threads=1)):
                for k, s in enumerate(range(0, len(ids), capacity)):
                    rows.append(i), piece.append(k), start.append(s), n.append(min(capacity, len(ids) - s))
                    if with_tokens:
                        held.append(ids[s : s + capacity])
            columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int32()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(held, pa.list_(pa.int32()))] if with_tokens else [])], ["k", "piece", "start", "n", *(["tokens"] if with_tokens else [])])

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter(F.col("t").rlike(r"[^\s\p{Z}\p{Cc}]"))
    out = rows.mapInArrow(run, f"k {kind}, piece int, start int, n int" + (", tokens array<int>" if with_tokens else ""))
    return out.withColumnRenamed("k", key)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots ``(length, first rank, last rank + 1, first container, items of this length in one container)``.

    Best-fit decreasing over counts: the longest length left opens a
    container, the longest that still fits goes in until none does; the
    pattern is repeated as often as every count in it allows.
    """
    left = dict(histogram)
    sizes = np.array(sorted(left), np.int64)
    alive = np.ones(len(sizes), bool)
    used = dict.fromkeys(left, 0)
    slots, container = [], 0
    while alive.any():
        pattern: dict[int, int] = {}
        room = capacity
        while True:
            fits = np.flatnonzero(alive & (sizes <= room))
            fits = [i for i in fits[::-1] if left[int(sizes[i])] > pattern.get(int(sizes[i]), 0)][:1]
            if not fits:
                break
            length = int(sizes[fits[0]])
            take = min(room // length, left[length] - pattern.get(length, 0))
            pattern[length] = pattern.get(length, 0) + take
            room -= length * take
        times = min(left[x] // m for x, m in pattern.items())
        for x, m in pattern.items():
            slots.append((x, used[x], used[x] + m * times, container, m))
            used[x] += m * times
            left[x] -= m * times
            if not left[x]:
                alive[np.searchsorted(sizes, x)] = False
        container += times
    return slots


def ranked(rows: DataFrame, key: str, salts: int) -> DataFrame:
    """``rows`` with ``rank``, a number from 0 within each length ``n``, ordered in ``salts`` parts of every length."""
    salt = F.pmod(F.xxhash64(key, "piece"), F.lit(salts))
    rows = rows.withColumn("salt", salt)
    counts = rows.groupBy("n", "salt").agg(F.count("*").alias("c"))
    base = counts.select("n", "salt", (F.sum("c").over(Window.partitionBy("n").orderBy("salt")) - F.col("c")).alias("base"))
    within = F.row_number().over(Window.partitionBy("n", "salt").orderBy(key, "piece")) - 1
    return rows.withColumn("within", within).join(base, ["n", "salt"]).withColumn("rank", F.col("base") + F.col("within")).drop("salt", "within", "base")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, path: str = VOCABULARY, salts: int | None = None) -> DataFrame:
    """``(key, piece, start, n, container)``: every piece with the container that it goes into."""
    rows = cut(pieces(df, key, text, capacity, path))
    histogram = {r.n: r.c for r in rows.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most ``capacity`` rows
    slots = sorted(plan(histogram, capacity))
    total = sum(histogram.values())
    by: dict[int, tuple] = {}
    for length in histogram:
        own = [s for s in slots if s[0] == length]
        by[length] = tuple(np.array([s[i] for s in own], np.int64) for i in (1, 3, 4))
    shared = df.sparkSession.sparkContext.broadcast(by)

    def place(batches):
        for b in batches:
            n, rank = b.column("n").to_numpy(), b.column("rank").to_numpy()
            out = np.empty(len(n), np.int64)
            for length in np.unique(n):
                first, container, each = shared.value[int(length)]
                at = n == length
                i = np.searchsorted(first, rank[at], side="right") - 1
                out[at] = container[i] + (rank[at] - first[i]) // each[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], [*b.schema.names[:4], "container"])

    kind = df.schema[key].dataType.simpleString()
    placed = ranked(rows, key, salts or max(8, total // 1_000_000)).select(key, "piece", "start", "n", "rank")
    return placed.mapInArrow(place, f"`{key}` {kind}, piece int, start int, n int, container long")

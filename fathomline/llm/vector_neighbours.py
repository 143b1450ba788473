"""Problem 1: the most similar vectors for every vector.

Method: shifted space-filling curves. Every vector is projected to a few
directions several times, each time with its own rotation and shift; a Hilbert
curve through each projection orders the vectors. The orderings are
range-partitioned, neighbouring key windows are compared, and the windows'
candidates merge and are reranked.

The directions are rotations within the ``lead`` leading principal axes, which
come from moments over all vectors. Vectors travel through the orderings as whole numbers
of 8 or 10 bits a dimension (cosine error about 0.001 or 0.0003 at 64
dimensions); a window passes on the best ``k`` of each vector as one list, so
an ordering shuffles each vector and each list once. With ``exact`` the merged
candidates are reranked with the full vectors, which shuffles a vector for
every pair; without it the rank is that of the whole numbers. A window never
crosses a partition; every ordering has other boundaries, so what one loses
another finds.

Defined results: null, empty, all-zero and non-finite vectors take part in
nothing; vectors of different lengths are searched apart; a repeated id counts
once, its first vector in byte order; ties are ordered by id; fewer than k
others give fewer rows; an empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: cosine lost to 8 and 10 bits, at most
SLACK = {8: 0.008, 10: 0.002}
#: rows of a partition of an ordering, at least, and blocks of a window's size in it
ROWS, BLOCKS = 1 << 16, 8
#: a cosine of 1 in the lists that are shuffled
UNIT = 32_767
_OUT = "id long, other long, cosine double, rank int"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells ``(n, d)`` of ``bits`` bits, for ``d * bits <= 63``.

    Gray-code form of the curve: undo excess rotation from the top bit down,
    then read the transposed bits in turn.
    """
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(x)):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(set_, low, swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & one != 0, np.uint64((1 << level) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = (key << one) | (((v ^ turn) >> np.uint64(level)) & one)
    return key.astype(np.int64)


def principal_axes(rows: DataFrame, dim: int, most: int) -> np.ndarray:
    """``(dim, most)``: the leading principal axes of all unit vectors ``v``, each scaled to one common spread of the projections."""

    def moments(batches):
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            x, _ = _matrix(b.column(0), dim)
            x = np.concatenate([x.astype("f8"), np.ones((len(x), 1))], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "m"])

    found = rows.select("v").mapInArrow(moments, "i long, m double").groupBy("i").agg(F.sum("m").alias("m")).collect()  # (dim + 1)^2 rows
    m = np.zeros((dim + 1) ** 2)
    for r in found:
        m[r.i] = r.m
    m = m.reshape(dim + 1, dim + 1)
    n = max(m[-1, -1], 1)
    spread, axes = np.linalg.eigh(m[:-1, :-1] / n - np.outer(m[-1, :-1], m[-1, :-1]) / n**2)
    lead = axes[:, ::-1][:, : min(most, dim)]
    return lead / max(np.sqrt(spread[::-1][: lead.shape[1]].mean()), 1e-9)


def _orderings(lead: np.ndarray, count: int, axes: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    axes = min(axes, lead.shape[1])
    return [(lead @ np.linalg.qr(rng.normal(size=(lead.shape[1], axes)))[0], rng.uniform(-0.5, 0.5, axes)) for _ in range(count)]


def pack(x: np.ndarray, bits: int) -> np.ndarray:
    """Vectors as rows of bytes: whole numbers of 8 or 10 bits, the largest of each vector at the limit; a direction needs no scale."""
    top = (1 << (bits - 1)) - 1
    v = np.rint(x / np.abs(x).max(1)[:, None] * top).astype(np.int16)
    if bits == 8:
        return v.astype(np.int8).view(np.uint8)
    v = (np.concatenate([v, np.zeros((len(v), -v.shape[1] % 4), np.int16)], axis=1) + 512).astype(np.uint16)
    a, b, c, d = (v[:, i::4] for i in range(4))
    return np.stack([a >> 2, (a & 3) << 6 | b >> 4, (b & 15) << 4 | c >> 6, (c & 63) << 2 | d >> 8, d & 255], axis=2).astype(np.uint8).reshape(len(v), -1)


def unpack(raw: np.ndarray, dim: int, bits: int) -> np.ndarray:
    """The inverse of :func:`pack`, as whole numbers."""
    if bits == 8:
        return raw.view(np.int8).astype(np.int16)
    t = [x.astype(np.int16) for x in np.moveaxis(raw.reshape(len(raw), -1, 5), 2, 0)]
    v = np.stack([t[0] << 2 | t[1] >> 6, (t[1] & 63) << 4 | t[2] >> 4, (t[2] & 15) << 6 | t[3] >> 2, (t[3] & 3) << 8 | t[4]], axis=2).reshape(len(raw), -1)
    return v[:, :dim] - 512


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list array, and which rows have one."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype("f8"), nan=-1).astype(int)
    ok = lengths == dim
    flat = column.filter(pa.array(ok)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype("f4").reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x.astype("f8") ** 2).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        ok[np.flatnonzero(ok)[~good]] = False
        return (x[good] / norm[good, None]).astype("f4"), ok


def curve_keys(rows: DataFrame, dim: int, count: int, axes: int, bits: int, depth: int, lead: int, seed: int) -> DataFrame:
    """``(id, q, keys)``: the packed unit vector and its position on every curve."""
    plans = _orderings(principal_axes(rows, dim, lead), count, axes, seed)

    def run(batches):
        for b in batches:
            x, ok = _matrix(b.column(1), dim)
            if not len(x):
                continue
            keys = np.empty((len(x), count), np.int64)
            for i, (project, shift) in enumerate(plans):
                y = x @ project  # about one standard deviation for each axis
                cell = ((y / 6 + 0.5) * (1 << bits) + shift * (1 << max(0, bits - 2))).astype(np.int64)
                keys[:, i] = hilbert_key(np.clip(cell, 0, (1 << bits) - 1), bits)
            raw = pack(x, depth)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * count, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), packed, lists], ["id", "q", "keys"])

    return rows.select("id", "v").mapInArrow(run, "id long, q binary, keys array<long>")


def window_candidates(ordered: DataFrame, dim: int, k: int, window: int, depth: int, least: float) -> DataFrame:
    """``(id, d, other)``: of each ordering's windows, the ``k`` most similar ``other`` of each vector, ``d`` their negative cosines in steps of 1 / UNIT.

    With ``least`` above 0 all that could be that similar and among the ``k``
    best, but for the error of the bytes, are passed on. A vector sees its own
    block of ``window`` vectors and the blocks before and after it.
    """
    slack = SLACK[depth]

    def pick(ids, w, at, others, ws):
        """The best of the rows ``at`` of a middle block ``(ids, w)``."""
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (w[at].astype("f4"), ws.astype("f4")))
        sim = x @ y.T
        sim[ids[at][:, None] == others[None, :]] = -2
        m = min(k, sim.shape[1])
        # A floor from the vectors nearby leaves few to be sorted.
        middle = int(np.flatnonzero(others == ids[at][0])[0])
        lo = max(0, min(middle - 512, sim.shape[1] - 1024 - len(at)))
        part = sim[:, lo : lo + 1024 + len(at)]
        m = min(m, part.shape[1])
        floor = np.partition(part, part.shape[1] - m, axis=1)[:, part.shape[1] - m] - 2 * slack
        if least > 0:
            floor = np.maximum(floor, least - slack)
        i, j = np.nonzero(sim >= np.maximum(floor, -1.5)[:, None])
        # The same pair has the same value in every window: it is summed in whole numbers.
        a, b = w[at][i].astype("f8"), ws[j].astype("f8")
        d = -np.minimum((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)), 1).astype("f4")
        o = np.lexsort((others[j], d, i))
        i, j, d = i[o], j[o], d[o]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        worst = np.full(len(at), np.float32(2))
        full = nth == k - 1
        worst[i[full]] = d[full]
        keep = d <= worst[i] + 2 * slack if least > 0 else nth < k
        i, j, d = i[keep], j[keep], d[keep]
        count = np.bincount(i, minlength=len(at))
        some = np.flatnonzero(count)
        ends = pa.array(np.concatenate([[0], np.cumsum(count[some])]), pa.int32())
        short = pa.array(np.rint(d * UNIT).astype(np.int16))
        return pa.RecordBatch.from_arrays([pa.array(ids[at][some]), pa.ListArray.from_arrays(ends, short), pa.ListArray.from_arrays(ends, pa.array(others[j]))], ["id", "d", "other"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # up to three blocks in a row
        rest, now = None, None

        def ready(block):
            """The middle block, once the one after it is known."""
            held.append(block)
            if len(held) > 3:
                held.pop(0)
            return (held[-2], held) if len(held) > 1 else None

        def emit(middle, blocks):
            others, ws = (np.concatenate([v[i] for v in blocks]) for i in (0, 1))
            for s in range(0, len(middle[0]), 256):
                yield pick(*middle, np.arange(s, min(s + 256, len(middle[0]))), others, ws)

        def close():
            if rest is not None and len(rest[0]):
                out = ready(rest)
                if out:
                    yield from emit(*out)
            if held:
                yield from emit(held[-1], held[-2:])

        for batch in batches:
            order, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            w = unpack(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), -1), dim, depth)
            for o in np.unique(order):
                part = order == o
                now_rows = (ids[part], w[part])
                if now is not None and o != now:
                    yield from close()
                    held, rest = [], None
                now = o
                if rest is not None:
                    now_rows = tuple(np.concatenate(v) for v in zip(rest, now_rows, strict=True))
                n = len(now_rows[0]) // window * window
                for s in range(0, n, window):
                    out = ready(tuple(v[s : s + window] for v in now_rows))
                    if out:
                        yield from emit(*out)
                rest = tuple(v[n:] for v in now_rows)
        yield from close()

    return ordered.select("o", "id", "q").mapInArrow(run, "id long, d array<short>, other array<long>")


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return rows.filter("id is not null and v is not null and size(v) > 0")


def lengths(df: DataFrame, key: str, vector: str) -> list[int]:
    """The lengths that two vectors or more have."""
    return [r.n for r in _vectors(df, key, vector).groupBy(F.size("v").alias("n")).count().filter("count > 1").orderBy("n").collect()]


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, dim: int | None = None, orderings: int = 7, axes: int = 8, bits: int = 6, window: int = 10_240, least: float = 0.0, depth: int = 10, lead: int = 16, exact: bool = True, seed: int = 7) -> DataFrame:
    """``(id, other, cosine, rank)``: up to ``k`` most similar others of every vector, cosine at least ``least`` if that is above 0.

    With ``dim`` only vectors of that length take part, else those of every length among themselves.
    """
    parts = [_nearest(_vectors(df, key, vector).filter(F.size("v") == n), k, n, orderings, axes, bits, window, least, depth, lead, exact or least > 0, seed) for n in ([dim] if dim else lengths(df, key, vector))]
    out = df.sparkSession.createDataFrame([], _OUT) if not parts else parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def _nearest(one: DataFrame, k: int, dim: int, orderings: int, axes: int, bits: int, window: int, least: float, depth: int, lead: int, exact: bool, seed: int) -> DataFrame:
    one, copies = _distinct(one)
    table = cut(curve_keys(one, dim, orderings, axes, bits, depth, lead, seed))
    # The id is part of the range key: a hot key splits over partitions.
    tasks = orderings * max(1, -(-table.count() // max(ROWS, BLOCKS * window)))
    ordered = table.select("id", "q", F.posexplode("keys").alias("o", "h")).repartitionByRange(tasks, "o", "h", "id").sortWithinPartitions("o", "h", "id")
    found = cut(window_candidates(ordered, dim, k, window, depth, least))
    # Two lists of numbers are shuffled, not one of pairs.
    each = F.flatten(F.transform(F.collect_list(F.struct("d", "other")), lambda x: F.arrays_zip(x["d"].alias("d"), x["other"].alias("other"))))
    if exact:
        if least <= 0:
            # The k-th best and all that could be as near, but for the error of the bytes.
            merged = found.groupBy("id").agg(F.array_sort(F.array_distinct(each)).alias("near"))
            limit = F.when(F.size("near") >= k, F.col("near")[k - 1]["d"]).otherwise(F.lit(2 * UNIT)) + 2 * SLACK[depth] * UNIT
            pairs = merged.select("id", F.explode(F.filter("near", lambda x: x["d"] <= limit)).alias("x")).select("id", "x.other")
        else:
            pairs = found.select("id", F.explode("other").alias("other")).distinct()
        lists = _by_full_vectors(one, cut(pairs), dim, least).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k).alias("near"))
    else:
        lists = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(each)), 1, k).alias("near"))
        lists = lists.select("id", F.transform("near", lambda x: F.struct((x["d"] / UNIT).alias("d"), x["other"].alias("other"))).alias("near"))
    best = lists.select("id", F.posexplode("near").alias("r", "x"))
    if copies is None:
        return best.select("id", F.col("x.other").alias("other"), (-F.col("x.d")).alias("cosine"), (F.col("r") + 1).alias("rank"))
    copies = cut(copies.join(table.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi"))
    members = copies.unionByName(copies.select("rep", F.col("rep").alias("id")).distinct())
    # No vector has more than the first k + 1 of a class among its neighbours.
    some = cut(members.withColumn("r", F.row_number().over(_by("rep", "id"))).filter(F.col("r") <= k + 1).select("rep", F.col("id").alias("m")))
    mine = some.groupBy(F.col("rep").alias("id")).agg(F.transform(F.collect_list("m"), lambda m: F.struct(F.lit(-1.0).alias("d"), m.alias("other"), F.lit(False).alias("open"))).alias("mine"))
    whole = lists.join(mine, "id", "full" if least > 0 else "left")
    none = F.array().cast("array<struct<d: double, other: long, open: boolean>>")
    told = F.concat(F.coalesce(F.transform("near", lambda x: F.struct(x["d"].alias("d"), x["other"].alias("other"), F.lit(True).alias("open"))), none), F.coalesce("mine", none))
    rows = whole.select("id", F.explode(told).alias("x")).select("id", "x.*")
    spread = rows.join(some, (rows["other"] == some["rep"]) & rows["open"], "left").select("id", F.coalesce("m", "other").alias("other"), "d")
    # Copies see what their class sees, and the first of them.
    top = spread.withColumn("r", F.row_number().over(_by("id", "d", "other"))).filter(F.col("r") <= k + 1).drop("r")
    shared = top.join(copies.select("rep").distinct(), top["id"] == F.col("rep"), "left_semi").withColumnRenamed("id", "rep").join(copies, "rep").select("id", "other", "d")
    out = None
    for part in (top, shared):
        ranked = part.filter("id <> other").withColumn("rank", F.row_number().over(_by("id", "d", "other"))).filter(F.col("rank") <= k).select("id", "other", (-F.col("d")).alias("cosine"), "rank")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def _by_full_vectors(one: DataFrame, pairs: DataFrame, dim: int, least: float) -> DataFrame:
    """``(id, other, d)`` of the pairs, ``d`` the negative cosine of the full vectors, where that is at least ``least``."""
    if least > 0:
        one = cut(one.join(pairs.select("id").union(pairs.select("other")).distinct(), "id", "left_semi"))
    vectors = one.groupBy("id").agg(F.min("v").alias("v"))
    full = pairs.join(vectors.withColumnRenamed("v", "va"), "id").join(vectors.select(F.col("id").alias("other"), F.col("v").alias("vb")), "other")

    def run(batches):
        for b in batches:
            x, y = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim) for i in (2, 3))
            s = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            keep = pa.array(s >= least if least > 0 else np.ones(len(s), bool))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(-s).filter(keep)], ["id", "other", "d"])

    return full.select("id", "other", "va", "vb").mapInArrow(run, "id long, other long, d double")


def _distinct(one: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One row ``(id, v)`` for each distinct vector, that of its smallest id, and the other ids ``(rep, id)``, if any.

    Vectors are told apart by 128 bits of hash, so that only hashes are shuffled.
    """

    def hashed(rows):
        return cut(rows.select("id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")))

    keyed = hashed(one)
    odd = cut(keyed.groupBy("id").count().filter("count > 1").select("id"))
    if not odd.isEmpty():  # repeated ids
        one = one.join(odd, "id", "left_anti").unionByName(one.join(odd, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))
        keyed = hashed(one)
    classes = keyed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    copies = cut(keyed.join(classes, ["h", "g"]).filter("id <> rep").select("rep", "id"))
    if copies.isEmpty():
        return one, None
    return one.join(copies.select("id"), "id", "left_anti"), copies


def _by(key, *order):
    return Window.partitionBy(key).orderBy(*order)


def close_pairs(df: DataFrame, key: str = "chunk_id", vector: str = "embedding", least: float = 0.9, k: int = 10, orderings: int = 8, window: int = 256, **how) -> DataFrame:
    """Pairs ``(key_a, key_b)`` of which one is among the ``k`` nearest of the other, with a cosine of at least ``least``.

    Close vectors lie close on most curves, so windows are small and bytes do.
    """
    near = nearest(df, key, vector, k, least=least, orderings=orderings, window=window, depth=8, **how)
    return near.select(F.least("id", "other").alias(f"{key}_a"), F.greatest("id", "other").alias(f"{key}_b")).distinct()

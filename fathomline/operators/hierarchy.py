"""Parent-child links of unknown depth: root, depth, path and descendants of every node.

Method: tree contraction. Leaves are raked into their parents and unary chain
nodes are compressed away, in turns, and every removal is recorded; the
records are then reversed to recover what each node needs from the node that
it was removed into. A core that never ends is a cycle.

Blocks of neighbouring ids first contract within themselves, one bounded task
each, so that only links between blocks remain for the distributed rounds. A
round removes at least the leaves and about a third of every chain, so the
rounds grow with the logarithm of the depth and the work shrinks by a constant
factor from round to round.

Defined results: a null or ``none`` parent marks a root; a parent that does
not exist makes the node and all below it ``orphan``; nodes on a cycle are
``cycle``, those that lead into one ``below_cycle``; these three have neither
root, depth, path nor a number of descendants. Rows with a null id are dropped; of a repeated id the row
with the smallest ``order`` counts, then the smallest parent. Columns other
than those named are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .dedup import numbered

STAY, LEAF, CHAIN = 0, 1, 2
_STATE = "id long, root long, depth long, state string, below long, anchor long, tail array<long>"
#: nodes of a block; with paths fewer, as a chain of n nodes inside a block has n * n / 2 steps in its paths
BLOCK, PATH_BLOCK = 1 << 15, 1 << 11


def _links(df: DataFrame, key: str, parent: str, order: str | None = None, none: int | None = None) -> DataFrame:
    """One row for each id: ``(id, up, missing)``."""
    up = F.col(parent).cast("long")
    if none is not None:
        up = F.when(up != none, up)
    rows = df.select(F.col(key).cast("long").alias("id"), up.alias("up"), (F.col(order).cast("double") if order else F.lit(0.0)).alias("o")).filter("id is not null")
    # A null order comes last, a null parent before others.
    first = rows.groupBy("id").agg(F.min(F.struct(F.coalesce("o", F.lit(float("inf"))).alias("o"), F.col("up"))).alias("m")).select("id", "m.up")
    ids = first.select(F.col("id").alias("known"))
    joined = first.join(ids, first.up == ids.known, "left")
    return joined.select("id", F.col("known").alias("up"), (F.col("up").isNotNull() & F.col("known").isNull()).alias("missing"))


def _contract_block(rows: pd.DataFrame, paths: bool) -> pd.DataFrame:
    """Rake and compress all that needs no other block; ``seq`` orders the removals."""
    rows = rows.sort_values("id", ignore_index=True)
    ids = rows["id"].to_numpy()
    up_id = rows["up"].fillna(-1).to_numpy().astype(np.int64)
    has_up = rows["up"].notna().to_numpy()
    at = np.clip(np.searchsorted(ids, up_id), 0, len(ids) - 1)
    inside = has_up & (ids[at] == up_id)
    up = np.where(inside, at, -1).tolist()
    n = rows["n"].to_numpy().astype(np.int64).tolist()
    local = np.bincount(at[inside], minlength=len(ids)).tolist()
    child = np.zeros(len(ids), np.int64)
    np.add.at(child, at[inside], np.flatnonzero(inside))
    child = child.tolist()
    size = len(ids)
    own, steps = [1] * size, rows["w"].to_numpy().astype(np.int64).tolist()
    kind, seq, only = [STAY] * size, [0] * size, [None] * size
    seg: list[list[int]] = [[] for _ in range(size)] if paths else []
    clock = 0
    stack = [i for i in range(size) if n[i] == 0 and up[i] >= 0]
    while stack:
        i = stack.pop()
        p = up[i]
        clock += 1
        kind[i], seq[i] = LEAF, clock
        own[p] += own[i]
        n[p] -= 1
        local[p] -= 1
        child[p] -= i
        if n[p] == 0 and up[p] >= 0 and p != i:
            stack.append(p)
    for i in range(size):
        p = up[i]
        if kind[i] == STAY and n[i] == 1 and local[i] == 1 and p >= 0 and p != i:
            c = child[i]
            if c == i:
                continue
            clock += 1
            kind[i], seq[i], only[i] = CHAIN, clock, int(ids[c])
            up[c] = p
            steps[c] += steps[i]
            own[p] += own[i]
            child[p] += c - i
            if paths:
                seg[c] = seg[i] + [int(ids[i])] + seg[c]
    where = np.array(up)
    rows["up"] = pd.array(np.where(where >= 0, ids[np.maximum(where, 0)], up_id), "Int64")
    rows.loc[~has_up, "up"] = pd.NA
    return rows.assign(n=n, own=own, steps=steps, kind=kind, seq=seq, only=pd.array(only, "Int64"), seg=seg if paths else [[]] * size)


def _restore_block(rows: pd.DataFrame, known: pd.DataFrame, paths: bool) -> pd.DataFrame:
    """Reverse one block's removals from the states of the nodes that stayed.

    Of a path only the part inside the block is made here: ``tail``, behind
    the node ``anchor`` that stayed.
    """
    have = {r[0]: (*r[1:], r[0], []) for r in known[["id", "root", "depth", "state", "below"]].itertuples(index=False)}
    gone = rows[rows["kind"] != STAY].sort_values("seq", ascending=False)
    out = []
    for i, up, kind, only, own, steps, seg in gone[["id", "up", "kind", "only", "own", "steps", "seg"]].itertuples(index=False):
        root, depth, state, _, anchor, tail = have[up]
        below = own - 1
        if kind == CHAIN:
            below += have[only][3] + 1
            state = "cycle" if have[only][2] == "cycle" else state
        if state == "cycle" and not (kind == CHAIN and have[only][2] == "cycle"):
            state = "below_cycle"
        ok = state == "ok"
        row = (root if ok else None, depth + steps if ok else None, state, below, anchor, [*tail, *seg, i] if ok and paths else [])
        have[i] = row
        out.append((i, *row))
    return pd.DataFrame(out, columns=["id", "root", "depth", "state", "below", "anchor", "tail"]).astype({"root": "Int64", "depth": "Int64"})


def hierarchy(df: DataFrame, key: str, parent: str, order: str | None = None, none: int | None = -1, paths: bool = True, block: int | None = None, weight: DataFrame | None = None) -> DataFrame:
    """``(id, root, depth, state, below, path)`` of every node.

    ``depth`` of a root is 0, ``below`` is the number of descendants, ``path``
    leads from the root to the node itself. ``block`` bounds the nodes that
    one task contracts by itself: they are neighbours in the order of ids,
    however far apart the ids are. The part of a path above a block is joined
    to it row by row, so no task holds more than its block's own steps. With
    ``weight (id, w)`` a step into a node counts ``w`` in ``depth``, not 1.
    """
    block = block or (PATH_BLOCK if paths else BLOCK)
    links = numbered(_links(df, key, parent, order, none), ["id"], "place")
    kids = links.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n"))
    if weight is not None:
        links = links.join(weight.select("id", "w"), "id", "left")
    else:
        links = links.withColumn("w", F.lit(1))
    nodes = links.join(kids, "id", "left").select("id", "up", "missing", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("w").cast("long"), F.lit(1)).alias("w"), F.expr(f"place div {int(block)}").alias("block"))
    full = "id long, up long, missing boolean, n long, w long, block long, own long, steps long, kind int, seq long, only long, seg array<long>"
    local = cut(nodes.groupBy("block").applyInPandas(lambda rows: _contract_block(rows, paths), full))

    rounds: list[DataFrame] = []
    now = local.filter(F.col("kind") == STAY).select("id", "up", "missing", "n", "own", "steps", "seg")
    while True:
        leaf = (F.col("n") == 0) & F.col("up").isNotNull()
        live = now.select("id", "up", "own", leaf.alias("leaf")).filter("up is not null")
        kids = live.groupBy(F.col("up").alias("id")).agg(F.sum(F.when(F.col("leaf"), F.col("own"))).alias("add"), F.count_if(~F.col("leaf")).alias("left"), F.min(F.when(~F.col("leaf"), F.col("id"))).alias("only"))
        joined = now.withColumn("leaf", leaf).drop("n").join(kids, "id", "left")
        toss = lambda c: F.xxhash64(c, F.lit(len(rounds)))
        chain = (F.col("left") == 1) & F.col("up").isNotNull() & (F.col("up") != F.col("id")) & (F.col("only") != F.col("id")) & (toss(F.col("id")) < toss(F.col("up"))) & (toss(F.col("id")) < toss(F.col("only")))
        kind = F.when(F.col("leaf"), LEAF).when(chain, CHAIN).otherwise(STAY)
        state = cut(joined.select("id", "up", "missing", F.coalesce("left", F.lit(0)).alias("n"), (F.col("own") + F.coalesce("add", F.lit(0))).alias("own"), "steps", "seg", "only", kind.alias("kind")))
        counts = state.groupBy().agg(F.count_if(F.col("kind") != STAY).alias("gone"), F.count_if(F.col("up").isNotNull() & (F.col("up") != F.col("id")) & (F.col("kind") == STAY)).alias("active")).first()
        rounds.append(state)
        stay, gone = state.filter(F.col("kind") == STAY), state.filter(F.col("kind") == CHAIN)
        by = gone.select(F.col("only").alias("id"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.concat("seg", F.array("id")).alias("seg2"))
        credit = gone.groupBy(F.col("up").alias("id")).agg(F.sum("own").alias("credit"))
        now = stay.join(by, "id", "left").join(credit, "id", "left").select("id", F.coalesce("up2", "up").alias("up"), "missing", "n", (F.col("own") + F.coalesce("credit", F.lit(0))).alias("own"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.when(F.col("seg2").isNotNull(), F.concat("seg2", "seg")).otherwise(F.col("seg")).alias("seg"))
        if not counts.active:
            break

    done = F.when(F.col("up").isNotNull(), F.lit("cycle")).when(F.col("missing"), F.lit("orphan")).otherwise(F.lit("ok"))
    known = now.select("id", done.alias("state"), (F.col("own") - 1).alias("below"))
    rooted = F.col("state") == "ok"
    known = known.select("id", F.when(rooted, F.col("id")).alias("root"), F.when(rooted, F.lit(0).cast("long")).alias("depth"), "state", "below", F.when(rooted & F.lit(paths), F.array("id")).alias("path"))

    def restore(gone: DataFrame, known: DataFrame, chain: bool) -> DataFrame:
        above = known.select(F.col("id").alias("up"), "root", F.col("depth").alias("d"), F.col("state").alias("s"), F.col("path").alias("p"))
        rows = gone.join(above, "up")
        if chain:
            rows = rows.join(known.select(F.col("id").alias("only"), F.col("state").alias("cs"), F.col("below").alias("cb")), "only")
            state = F.when(F.col("cs") == "cycle", "cycle").when(F.col("s") == "cycle", "below_cycle").otherwise(F.col("s"))
            below = F.col("own") + F.col("cb")
        else:
            state, below = F.when(F.col("s") == "cycle", "below_cycle").otherwise(F.col("s")), F.col("own") - 1
        ok = F.col("s") == "ok"
        return rows.select("id", F.when(ok, F.col("root")).alias("root"), F.when(ok, F.col("d") + F.col("steps")).alias("depth"), state.alias("state"), below.alias("below"), F.when(ok & F.lit(paths), F.concat("p", "seg", F.array("id"))).alias("path"))

    known = cut(known)
    for state in reversed(rounds):
        for kind in (CHAIN, LEAF):
            gone = state.filter(F.col("kind") == kind)
            if not gone.isEmpty():
                known = known.unionByName(cut(restore(gone, known, kind == CHAIN)))
    stay = local.filter(F.col("kind") == STAY).select("id", F.col("block").alias("part"))
    held = known.join(stay, "id").select("id", "root", "depth", "state", "below", "part")
    gone = local.filter(F.col("kind") != STAY).groupBy("block")
    inner = gone.cogroup(held.groupBy("part")).applyInPandas(lambda rows, have: _restore_block(rows, have, paths), _STATE)
    if paths:
        above = known.select(F.col("id").alias("anchor"), F.col("path").alias("lead"))
        inner = inner.join(above, "anchor").withColumn("path", F.when(F.col("state") == "ok", F.concat("lead", "tail")))
    else:
        inner = inner.withColumn("path", F.lit(None).cast("array<long>"))
    nodes = known.unionByName(inner.select("id", "root", "depth", "state", "below", "path"))
    return nodes.withColumn("below", F.when(F.col("state") == "ok", F.col("below")))


def running_sums(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows before a row in the order of the whole table.

    Sums run within sorted ranges, to which the sums of the ranges before are added.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = df.columns.index(value)

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = np.cumsum(b.column(at).to_numpy(zero_copy_only=False)) + total
            starts = np.concatenate([[total], ends[:-1]]) if len(ends) else ends
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts.astype(np.int64)), pa.array(np.full(len(starts), part, np.int32))], [*b.schema.names, name, "_part"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    table = cut(ranged.mapInArrow(run, f"{kinds}, `{name}` long, _part int"))
    ends = table.groupBy("_part").agg(F.max(F.col(name) + F.col(value)).alias("_n"))  # one row for each range
    base = ends.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return table.join(F.broadcast(base), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")


def intervals(df: DataFrame, key: str, parent: str, order: str | None = None, none: int | None = -1, block: int | None = None) -> DataFrame:
    """``(id, first, last)`` of every node with a root: its place in pre-order and that of its last descendant.

    One row for each node however deep the trees are; x lies below y where
    ``y.first < x.first <= y.last``. Siblings and roots are in the order of
    their ids. A node's place is its parent's, one more and the sizes of the
    siblings before it; contraction sums that up along the paths.
    """
    how = {"key": key, "parent": parent, "order": order, "none": none}
    sizes = cut(hierarchy(df, **how, paths=False, block=block).filter("state = 'ok'").select("id", (F.col("below") + 1).alias("size")))
    rows = sizes.join(_links(df, **how).select("id", F.coalesce("up", F.lit(0)).alias("up"), F.col("up").isNull().alias("top")), "id")
    before = cut(running_sums(rows.select("id", "up", "top", "size"), ["top", "up", "id"], "size", "sum"))
    start = before.groupBy("top", "up").agg(F.min("sum").alias("least"))
    placed = cut(before.join(start, ["top", "up"]).select("id", "top", "size", (F.col("sum") - F.col("least")).alias("skip")))
    deep = hierarchy(df, **how, paths=False, block=block, weight=placed.select("id", (F.col("skip") + 1).alias("w"))).filter("state = 'ok'").select("id", "root", "depth")
    roots = placed.filter("top").select(F.col("id").alias("root"), F.col("skip").alias("base"))
    first = (F.col("base") + F.col("depth")).alias("first")
    return deep.join(roots, "root").join(placed.select("id", "size"), "id").select("id", first, (F.col("base") + F.col("depth") + F.col("size") - 1).alias("last"))


def descendants(nodes: DataFrame) -> DataFrame:
    """``(id, descendant, distance)``: every node with each node below it, from the paths of :func:`hierarchy`."""
    rows = nodes.filter("state = 'ok'").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "id"))
    return rows.filter("id <> descendant").select("id", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def unrooted(df: DataFrame, key: str, parent: str, order: str | None = None, none: int | None = -1) -> DataFrame:
    """``(key, state)`` of the nodes from which no root can be reached."""
    nodes = hierarchy(df, key, parent, order, none, paths=False)
    return nodes.filter("state <> 'ok'").select(F.col("id").alias(key), "state")

"""Problem 5: records that share most of their words but differ by small edits.

Method: fast similarity sketching (rounds of hashed bin placement: round i
puts every shingle into a random bin with a value in [i, i+1); rounds t and
later aim at one fixed bin each, so every coordinate fills), then banding and
exact verification of every candidate pair on its shingle sets.

Work is done on classes of equal word sequences; a class is one row however
many copies it has. A band bucket with more than ``cap`` classes makes no
pairs of its own: its classes go through an exact prefix-filtered set join
instead, so nothing is lost and no group is paired in full.

Groups are made of classes, too: a class brings its number of members, and
members meet their class at the end, so copies make no pairs of their own.
Classes are told apart by 64 bits of hash; the few that share them are found
by another 64 bits and get a hash of their own.

Defined results: null, blank or short texts take part in nothing; of a
repeated id the row with the smallest ``order`` counts; empty input gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .codepoints import mix, shingles, slices
from .copies import canonical_keys, words_form

U64 = np.uint64


def sketch(h: np.ndarray, row: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """``(rows, bins)`` sketch values of the shingle sets ``(h, row)``; a row without shingles gets zeros.

    A coordinate's value is the smallest scrambled hash that the first round
    to reach it put there, so two sets agree on it with the probability of
    their Jaccard similarity.
    """
    empty = U64(0xFFFFFFFFFFFFFFFF)
    out = np.full(rows * bins, empty, U64)
    for i in range(2 * bins):
        if not len(h):
            break
        v = mix(h + U64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = row * bins + ((v >> U64(33)) % U64(bins) if i < bins else np.full(len(h), i - bins)).astype(np.int64)
        v = mix(v)
        if i:
            free = out[at] == empty
            at, v = at[free], v[free]
        np.minimum.at(out, at, v)
        full = (out.reshape(rows, bins) != empty).all(1)
        if full.any():
            left = ~full[row]
            h, row = h[left], row[left]
    out[out == empty] = 0
    return out.reshape(rows, bins)


def band_rows(classes: DataFrame, bands: int, height: int, n: int, least_words: int) -> DataFrame:
    """``(band, cls)`` for every class and band; classes lately seen by a task are skipped."""

    def run(batches):
        seen: set[int] = set()
        for b in slices(batches, "t"):
            cls = b.column(0).to_numpy(zero_copy_only=False)
            if len(seen) > 200_000:
                seen.clear()
            new = np.array([c not in seen for c in cls.tolist()], bool)
            seen.update(cls.tolist())
            h, row, count = shingles(b.column(1), n)
            use = new & (count >= max(n, least_words))
            k = use[row]
            s = sketch(h[k], row[k], len(cls), bands * height).reshape(len(cls), bands, height)[use]
            if not len(s):
                continue
            key = np.zeros(s.shape[:2], U64)
            for j in range(height):
                key = mix(key * U64(0x9E3779B97F4A7C15) + s[:, :, j])
            key = mix(key + np.arange(bands, dtype=U64)[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(cls[use], bands))], ["band", "cls"])

    return classes.select("cls", "t").mapInArrow(run, "band long, cls long")


def bucket_pairs(rows: DataFrame, cap: int) -> DataFrame:
    """``(a, b)`` of classes that share a bucket; ``(a, null)`` for a class of a bucket above ``cap``."""

    def run(batches):
        band, held, over = None, [], False

        def pairs():
            x = np.array(held, np.int64)
            i, j = np.triu_indices(len(x), 1)
            return np.minimum(x[i], x[j]), np.maximum(x[i], x[j])

        for batch in batches:
            xs, ys, lone = [], [], []
            keys, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[s] != band:
                    if len(held) > 1:
                        x, y = pairs()
                        xs.append(x), ys.append(y)
                    band, held, over = keys[s], [], False
                if e - s == 1 and not held and not over:
                    held = [int(cls[s])]
                    continue
                new = np.unique(cls[s:e])
                if over:
                    lone.append(new)
                    continue
                held = sorted({*held, *new.tolist()})
                if len(held) > cap:
                    lone.append(np.array(held, np.int64))
                    held, over = [], True
            if xs or lone:
                a = np.concatenate([*xs, *lone])
                none = np.concatenate([np.zeros(sum(map(len, xs)), bool), np.ones(sum(map(len, lone)), bool)])
                b = np.concatenate([*ys, *lone])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=none)], ["a", "b"])
        if len(held) > 1:
            x, y = pairs()
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return rows.repartition("band").sortWithinPartitions("band").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` of the pairs ``(a, b, ta, tb)`` whose shingle sets reach ``threshold`` exactly."""

    def run(batches):
        for whole in batches:
            for b in slices([whole], "ta"):
                sets = []
                for k in (2, 3):
                    h, row, _ = shingles(b.column(k), n)
                    o = np.lexsort((h, row))
                    h, row = h[o], row[o]
                    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)]
                    sets.append((h[new], row[new]))
                size = [np.bincount(r, minlength=b.num_rows) for _, r in sets]
                h, row = (np.concatenate([sets[0][k], sets[1][k]]) for k in (0, 1))
                o = np.lexsort((h, row))
                h, row = h[o], row[o]
                both = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
                common = np.bincount(row[1:][both], minlength=b.num_rows)
                union = size[0] + size[1] - common
                # compared in whole numbers, so 0.6 is reached exactly
                ok = (union > 0) & (common * 1_000_000 >= union * round(threshold * 1_000_000))
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array((common[ok] / union[ok]).astype("f8"))], ["a", "b", "similarity"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def prefix_pairs(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """Exact candidates ``(a, b)`` by prefix filtering: sets of similarity ``threshold`` share one of their rarest shingles."""

    def run(batches):
        for b in slices(batches, "t"):
            h, row, _ = shingles(b.column(1), n)
            o = np.lexsort((h, row))
            h, row = h[o], row[o]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)]
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[row[new]]), pa.array(h[new].view(np.int64))], ["cls", "s"])

    tokens = cut(classes.select("cls", "t").mapInArrow(run, "cls long, s long"))
    often = tokens.groupBy("s").agg(F.count("*").alias("df"))
    # The order by rarity is global; ties go by the shingle's hash.
    sized = tokens.join(often, "s").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("all"))
    keep = F.size("all") - F.ceil(F.size("all") * threshold - 1e-9) + 1
    prefix = cut(sized.select("cls", F.size("all").alias("size"), F.explode(F.slice("all", 1, keep.cast("int"))).alias("e")).filter("e.df > 1").select("cls", "size", F.col("e.s").alias("s")))
    other = prefix.select("s", F.col("cls").alias("b"), F.col("size").alias("sb"))
    pairs = prefix.select("s", F.col("cls").alias("a"), F.col("size").alias("sa")).join(other, "s").filter("a < b")
    return pairs.filter(F.least("sa", "sb") >= F.greatest("sa", "sb") * threshold - 1e-9).select("a", "b").distinct()


def similar_classes(rows: DataFrame, n: int = 5, threshold: float = 0.8, bands: int = 20, height: int = 4, least_words: int = 0, cap: int = 64) -> DataFrame:
    """``(a, b, similarity)`` of the classes of ``rows (cls, t)`` whose shingle sets reach ``threshold``."""
    found = cut(bucket_pairs(band_rows(rows, bands, height, n, least_words), cap).distinct())
    pairs = found.filter("b is not null")
    texts = lambda who: rows.join(who.distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("t").alias("t"))
    crowded = found.filter("b is null").select(F.col("a").alias("cls"))
    if not crowded.isEmpty():
        pairs = pairs.unionByName(prefix_pairs(texts(crowded), n, threshold)).distinct()
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls")))
    text = cut(texts(wanted))
    full = pairs.join(text.select(F.col("cls").alias("a"), F.col("t").alias("ta")), "a").join(text.select(F.col("cls").alias("b"), F.col("t").alias("tb")), "b")
    return cut(verify(full, n, threshold))


class Classes:
    """The texts of a table that count, as ``members (id, cls, copy)``, and the ``pairs (a, b, similarity)`` of their classes.

    ``copy`` is the canonical hash where copies in the sense of problem 7 are
    told apart, null for shorter texts. ``where`` is judged on the row that
    counts for its id. With 26 bands of 3 a pair of similarity 0.6 is missed
    with probability 0.002, one of 0.7 with 1e-5.
    """

    def __init__(self, df: DataFrame, key: str, text: str, order: str | None = None, where: Column | None = None, least_words: int = 20, n: int = 3, threshold: float = 0.6, bands: int = 26, height: int = 3):
        norm = words_form(F.col(text))
        keys = canonical_keys(F.col(text))
        count = F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1
        one, two = F.xxhash64(norm), F.xxhash64(F.lit(31), norm)
        ok = where if where is not None else F.lit(True)
        rows = df.select(F.col(key).cast("long").alias("id"), (F.col(order) if order else F.lit(0.0)).alias("o"), ok.alias("ok"), one.alias("cls"), two.alias("cls2"), F.when(keys["n"] >= 80, keys["h1"]).alias("copy"), count.alias("words"))
        first = rows.filter("id is not null").groupBy("id").agg(F.min(F.struct(F.coalesce("o", F.lit(float("inf"))).alias("o"), "ok", "cls", "cls2", "copy", "words")).alias("m"))
        members = cut(first.filter((F.col("m.ok")) & (F.col("m.words") >= least_words)).select("id", "m.cls", "m.cls2", "m.copy"))
        clash = members.groupBy("cls").agg(F.min("cls2").alias("x"), F.max("cls2").alias("y")).filter("x <> y").select("cls").collect()  # by chance: about n^2 / 2^65
        own = lambda c, d: F.when(c.isin([r.cls for r in clash]), F.xxhash64(F.lit(37), d)).otherwise(c) if clash else c
        self.members = members.select("id", own(F.col("cls"), F.col("cls2")).alias("cls"), "copy")
        self.pairs = similar_classes(df.filter(ok).select(own(one, two).alias("cls"), norm.alias("t")), n, threshold, bands, height, least_words)


def near_copies(df: DataFrame, key: str, text: str, order: str | None = None, where: Column | None = None, **how) -> DataFrame:
    """Pairs ``(key_a, key_b)`` of near copies that are not copies of one canonical form, by :class:`Classes`."""
    c = Classes(df, key, text, order, where, **how)
    side = lambda cls, i, k: c.members.select(F.col("cls").alias(cls), F.col("id").alias(i), F.col("copy").alias(k))
    found = c.pairs.select("a", "b").join(side("a", "x", "cx"), "a").join(side("b", "y", "cy"), "b").filter("not (cx <=> cy) or cx is null").select("x", "y")
    # Of one word sequence those pairs count that are no copies: too short for it, or of other fields.
    some = c.members.groupBy("cls").agg(F.count("*").alias("n"), F.count("copy").alias("known"), F.countDistinct("copy").alias("kinds")).filter("n > 1 and (known < n or kinds > 1)").select("cls")
    inner = c.members.join(some, "cls")
    same = inner.select("cls", F.col("id").alias("x"), F.col("copy").alias("cx")).join(inner.select("cls", F.col("id").alias("y"), F.col("copy").alias("cy")), "cls").filter("x < y and (not (cx <=> cy) or cx is null)").select("x", "y")
    return found.unionByName(same).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def near_groups(df: DataFrame, key: str, text: str, order: str | None = None, where: Column | None = None, **how) -> DataFrame:
    """``(id, group, links)`` of every text that :func:`near_copies` pairs: its group's smallest id and the number of its pairs.

    Units are the members of a class that are copies of one another; links are
    counted from the units' sizes, and groups grow over one row for each unit.
    """
    c = Classes(df, key, text, order, where, **how)
    unit = ["cls", "copy"]
    units = cut(c.members.groupBy(*unit).agg(F.min("id").alias("u"), F.count("*").alias("n")))
    side = lambda cls, k: units.select(F.col("cls").alias(cls), F.col("u").alias(f"u{k}"), F.col("n").alias(f"n{k}"), F.col("copy").alias(f"c{k}"))
    met = c.pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").filter("not (cx <=> cy) or cx is null").select("ux", "nx", "uy", "ny")
    # Units of one class are all linked; each is tied to the first of them.
    whole = units.groupBy("cls").agg(F.min("u").alias("first"), F.sum("n").alias("all"), F.count("*").alias("units")).filter("units > 1")
    tied = units.join(whole, "cls").select("u", "first", (F.col("all") - F.col("n")).alias("links"))
    alone = units.filter("copy is null and n > 1").select("u", F.col("u").alias("first"), (F.col("n") - 1).alias("links"))
    links = met.select(F.col("ux").alias("u"), F.col("ny").alias("links")).unionByName(met.select(F.col("uy").alias("u"), F.col("nx").alias("links"))).unionByName(tied.select("u", "links")).unionByName(alone.select("u", "links"))
    links = links.groupBy("u").agg(F.sum("links").alias("links"))
    edges = met.select(F.col("ux").alias("a"), F.col("uy").alias("b")).unionByName(tied.select(F.col("u").alias("a"), F.col("first").alias("b"))).unionByName(alone.select(F.col("u").alias("a"), F.col("first").alias("b")))
    labels = groups(edges, "a", "b").select(F.col("id").alias("u"), "group")
    placed = units.join(labels, "u").join(links, "u").select("cls", F.col("copy").alias("c"), "group", "links")
    found = c.members.join(placed, (c.members["cls"] == placed["cls"]) & c.members["copy"].eqNullSafe(placed["c"]))
    return found.select("id", "group", "links")


def groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, group, links)`` of everything in ``pairs``: the smallest id that links lead to, and the number of its own links.

    Labels travel along links and jump to the label of their label, so rounds
    grow with the logarithm of a group's width; every round is a written table.
    """
    one = pairs.select(F.col(a).alias("id"), F.col(b).alias("other"))
    edges = cut(one.union(one.select("other", "id")).distinct())
    now = cut(edges.groupBy("id").agg(F.least("id", F.min("other")).alias("group")))
    while True:
        told = edges.join(now.select(F.col("id").alias("other"), F.col("group").alias("g")), "other").groupBy("id").agg(F.min("g").alias("g"))
        near = now.join(told, "id").select("id", "group", F.least("group", "g").alias("new"))
        # One label back: the label that the new label has itself.
        jump = near.join(now.select(F.col("id").alias("new"), F.col("group").alias("far")), "new").select("id", "group", F.least("new", "far").alias("new"))
        step = cut(jump)
        changed = step.filter("new <> group").limit(1).count()
        now = step.select("id", F.col("new").alias("group"))
        if not changed:
            break
    return now.join(edges.groupBy("id").agg(F.count("*").alias("links")), "id")

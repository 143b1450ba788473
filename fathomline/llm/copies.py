"""Problem 7: records that differ only in form, collapsed and counted.

Method: every record gets a hash of its canonical form. Each partition folds
its hashes into two Bloom filters, of hashes seen once and seen repeatedly;
the partitions' filters are merged; only records that the merged filter calls
possible repeats are shuffled and grouped exactly. All others are singletons
and leave without a shuffle.

A Bloom filter has no false negatives, so no copy is lost at any filter size.
There are eight bits for each record. Hashes are split by range so that one
range's filter has at most ``most_bits``; the key table is sorted by hash
within its files, so a range's pass reads its own pages of them.

The canonical form of named fields has them in the order of their names, at
every depth of a JSON object; names and texts are compared without case and
signs at the top, without case below it.

Defined results: a null or blank text is no record; a record with fewer than
``least`` letters and digits is its own singleton; a repeated id within one
table is one record, its row with the smallest ``order`` counts; empty input
gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .codepoints import mix

#: Upper bound of the broadcast filter: 2**28 bits are 32 MB.
MOST_BITS = 1 << 28
_SEGMENT = 1 << 19
_HASHES = 4


def words_form(text: Column) -> Column:
    """Lower case, with every run of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def plain_form(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.replace(words_form(text), F.lit(" "), F.lit(""))


def field_form(text: Column) -> Column:
    """Sorted ``name value`` parts of a JSON object or of ``name = value; ...``, else null."""
    low = F.lower(text)
    inside = lambda v: F.when(F.ltrim(v).rlike(r"^[\[{]"), F.coalesce(F.to_json(F.try_parse_json(v)), v)).otherwise(v)  # noqa: E731  a variant's fields are sorted
    entries = F.map_entries(F.from_json(low, "map<string,string>"))
    as_json = F.transform(entries, lambda e: F.concat(plain_form(e["key"]), F.lit("\x1f"), F.coalesce(plain_form(inside(e["value"])), F.lit(""))))
    parts = F.filter(F.split(low, ";"), lambda p: F.trim(p) != "")
    as_parts = F.transform(parts, lambda p: F.concat(plain_form(F.substring_index(p, "=", 1)), F.lit("\x1f"), plain_form(F.regexp_replace(p, r"^[^=]*=", ""))))
    is_json = F.ltrim(text).startswith("{")
    is_parts = F.contains(text, F.lit("=")) & (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(r"^\s*[\w .-]+="))
    return F.when(is_json, F.array_join(F.array_sort(as_json), "\x1e")).when(is_parts, F.array_join(F.array_sort(as_parts), "\x1e"))


def canonical_keys(text: Column) -> dict[str, Column]:
    """``h1``/``h2``: 128 bits of the canonical form; ``n``: its letters and digits."""
    plain = plain_form(text)
    form = F.coalesce(F.concat(F.lit("\x1d"), field_form(text)), plain)
    return {"h1": F.xxhash64(form), "h2": F.xxhash64(F.lit(29), form), "n": F.length(plain)}


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    a, b = mix(h.view(np.uint64)), mix(h.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return ((a[None, :] + np.arange(_HASHES, dtype=np.uint64)[:, None] * b[None, :]) & np.uint64(bits - 1)).astype(np.int64)


def _test(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _set(filled: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filled, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def repeat_filter(keys: DataFrame, bits: int, column: str = "h1") -> np.ndarray:
    """The merged 'seen repeatedly' filter of ``bits`` bits."""
    segment = min(bits, _SEGMENT)

    def fold(batches):
        once, again = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for b in batches:
            h, count = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            if (count > 1).any():
                _set(again, _positions(h[count > 1], bits).ravel())
            at = np.sort(_positions(h, bits).ravel())
            twice = np.concatenate([at[1:] == at[:-1], [False]]) | _test(once, at) if len(at) else np.zeros(0, bool)
            _set(again, at[twice])
            _set(once, at)
        size = segment >> 3
        for s in range(bits // segment):
            one, two = once[s * size : (s + 1) * size], again[s * size : (s + 1) * size]
            if one.any():
                yield pa.RecordBatch.from_pydict({"s": [s], "one": [zlib.compress(one.tobytes(), 1)], "two": [zlib.compress(two.tobytes(), 1)]}, schema=pa.schema([("s", pa.int32()), ("one", pa.binary()), ("two", pa.binary())]))

    def merge(batches):
        now, one, two = None, None, None

        def out():
            return pa.RecordBatch.from_pydict({"s": [now], "two": [zlib.compress(two.tobytes(), 1)]}, schema=pa.schema([("s", pa.int32()), ("two", pa.binary())]))

        for b in batches:
            for s, x, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x, y = (np.frombuffer(zlib.decompress(v), np.uint8) for v in (x, y))
                if s != now:
                    if now is not None:
                        yield out()
                    now, one, two = s, x.copy(), y.copy()
                else:
                    two |= y | (one & x)
                    one |= x
        if now is not None:
            yield out()

    folded = keys.select(column).mapInArrow(fold, "s int, one binary, two binary")
    merged = folded.repartition("s").sortWithinPartitions("s").mapInArrow(merge, "s int, two binary")
    filled = np.zeros(bits >> 3, np.uint8)
    size = segment >> 3
    for row in merged.collect():  # at most most_bits, whatever the input
        filled[row.s * size : (row.s + 1) * size] = np.frombuffer(zlib.decompress(bytes(row.two)), np.uint8)
    return filled


def hash_ranges(rows: int, most_bits: int = MOST_BITS) -> tuple[int, list[tuple[int, int]]]:
    """Bits of one filter, and the ranges of hashes that get one each, so that every record has eight bits."""
    bits = 1 << max(10, (8 * rows - 1).bit_length() if rows else 0)
    parts = max(1, bits // most_bits)
    step = (1 << 64) // parts
    return bits // parts, [(r * step - (1 << 63), (r + 1) * step - 1 - (1 << 63)) for r in range(parts)]


def mark_repeats(keys: DataFrame, column: str = "h1", most_bits: int = MOST_BITS) -> DataFrame:
    """``keys`` with ``maybe``: false only where ``column`` surely occurs once."""
    bits, ranges = hash_ranges(keys.count(), most_bits)
    at = keys.columns.index(column)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    out = None
    for low, high in ranges:
        own = keys.filter(F.col(column).between(low, high)) if len(ranges) > 1 else keys
        shared = keys.sparkSession.sparkContext.broadcast(repeat_filter(own, bits, column))

        def run(batches, shared=shared):
            for b in batches:
                hit = _test(shared.value, _positions(b.column(at).to_numpy(zero_copy_only=False), bits)).all(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], [*b.schema.names, "maybe"])

        marked = own.mapInArrow(run, f"{kinds}, maybe boolean")
        out = marked if out is None else out.unionByName(marked)
    return out


def record_keys(df: DataFrame, table: str, key: str, text: str, order: str | None = None) -> DataFrame:
    """``(tbl, id, h1, h2, n)`` of the records of one table; only hashes are shuffled, never texts."""
    rows = df.select(F.col(key).cast("long").alias("id"), *([F.col(order).alias("o")] if order else []), *(c.alias(k) for k, c in canonical_keys(F.col(text)).items())).filter("n > 0 and id is not null")
    if order:
        first = rows.groupBy("id").agg(F.min(F.struct(F.coalesce("o", F.lit(float("inf"))).alias("o"), "h1", "h2", "n")).alias("m"))
        rows = first.select("id", "m.h1", "m.h2", "m.n")
    return rows.select(F.lit(table).alias("tbl"), "id", "h1", "h2", "n")


def collapse(keys: DataFrame, least: int = 80, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """Groups and members.

    ``groups``: ``(tbl, first_id, copies)``, one row for each distinct record.
    ``members``: ``(tbl, first_id, copy_id)``, one row for each copy.
    Groups never cross tables. A hot group is reduced to one row per task
    before it is shuffled; its members meet their group in a join whose other
    side has one row, which adaptive execution splits.
    """
    keys = cut(keys.withColumn("h1", F.xxhash64("tbl", "h1")).sortWithinPartitions("h1"))
    long = keys.filter(F.col("n") >= least).drop("n")
    marked = cut(mark_repeats(long, "h1", most_bits))
    maybe = marked.filter("maybe").drop("maybe")
    grouped = maybe.groupBy("tbl", "h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    single = marked.filter("not maybe").select("tbl", F.col("id").alias("first_id"), F.lit(1).cast("long").alias("copies"))
    short = keys.filter(F.col("n") < least).select("tbl", F.col("id").alias("first_id"), F.lit(1).cast("long").alias("copies"))
    groups = grouped.select("tbl", "first_id", "copies").unionByName(single).unionByName(short)
    repeated = grouped.filter("copies > 1").drop("copies")
    members = maybe.join(repeated, ["tbl", "h1", "h2"]).filter("id <> first_id").select("tbl", "first_id", F.col("id").alias("copy_id"))
    return groups, members

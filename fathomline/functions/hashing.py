"""Content hashes. Wrapping 64-bit arithmetic is not available in ANSI SQL, so FNV and BLAKE run in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fnv1a64_batch(items: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once: step j takes byte j of every string that has one."""
    h = np.full(len(items), 0xCBF29CE484222325, np.uint64)
    if not items:
        return h
    size = np.array([len(x) for x in items])
    order = np.argsort(-size, kind="stable")
    starts = np.concatenate([[0], np.cumsum(size[order])])[:-1]
    flat = np.frombuffer(b"".join(items[i] for i in order), np.uint8).astype(np.uint64)
    state = h[order]
    ordered = size[order]
    for j in range(int(size.max())):
        live = int(np.searchsorted(-ordered, -j, side="left"))
        state[:live] = (state[:live] ^ flat[starts[:live] + j]) * np.uint64(0x100000001B3)
    h[order] = state
    return h


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1a64(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unsigned FNV-1a 64 of a text's UTF-8 bytes."""
    from decimal import Decimal

    for s in it:
        known = s.notna()
        h = fnv1a64_batch([x.encode() for x in s[known]])
        out = pd.Series([None] * len(s), dtype=object)
        out[known.to_numpy()] = [Decimal(int(x)) for x in h]
        yield out


def _blake(order: str, signed: bool, bits: int = 64):
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), order, signed=signed) & ((1 << bits) - 1 if bits < 64 else -1)).astype("Int64" if signed or bits < 64 else object)

    return run


@F.pandas_udf(T.LongType())
def blake64_signed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Signed big-endian BLAKE2b-64 of a text."""
    yield from _blake("big", True)(it)


@F.pandas_udf(T.DecimalType(20, 0))
def blake64_little(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unsigned little-endian BLAKE2b-64 of a text."""
    from decimal import Decimal

    for s in _blake("little", False)(it):
        yield s.map(lambda x: None if x is None else Decimal(x))


@F.pandas_udf(T.LongType())
def _uid(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _blake("big", False, 63)(it)


def message_uid(conv: Column, branch: Column, msg: Column) -> Column:
    """A non-negative 63-bit id of a message's natural key."""
    return _uid(F.concat_ws("|", conv, branch, msg.cast("string")))


def sha256(text: Column) -> Column:
    """The 32 bytes of SHA-256."""
    return F.unhex(F.sha2(text.cast("binary"), 256))

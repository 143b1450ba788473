"""Texts to vectors through a pluggable model."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import flat


def hashed_words(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A native model for tests: signed counts of hashed words."""
    import re

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9_]+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out

    return embed


def letter_counts(texts: list[str]) -> np.ndarray:
    """A native model that SQL can repeat: how often each of the letters a to z occurs."""
    out = np.zeros((len(texts), 26))
    for i, t in enumerate(texts):
        data = np.frombuffer(t.lower().encode(), np.uint8)
        out[i] = np.bincount(data[(data >= 97) & (data <= 122)] - 97, minlength=26)
    return out


def embed(df: DataFrame, model: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = 64, unit: bool = True, name: str = "embedding") -> DataFrame:
    """``df`` with a vector of each text; a null or blank text gets none."""
    rows = df.withColumn("_t", flat(F.col(text)))

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            full = [i for i, t in enumerate(texts) if t]
            out: list = [None] * len(texts)
            for s in range(0, len(full), batch):
                part = full[s : s + batch]
                v = np.asarray(model([texts[i] for i in part]), "f8")
                if unit:
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for i, x in zip(part, v.astype("f4"), strict=True):
                    out[i] = x.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.float32()))], [*b.schema.names[:-1], name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(run, f"{kinds}, `{name}` array<float>")

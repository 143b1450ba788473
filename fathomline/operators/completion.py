"""The boundary to text generation: prompts in, answers out, with retries and bounded concurrency in every task."""

from __future__ import annotations

import asyncio
import random
from collections.abc import Awaitable, Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Client:
    """How to call. ``call(prompt)`` is a coroutine; errors in ``final`` are not retried."""

    call: Callable[[str], Awaitable[str]]
    timeout: float = 60.0
    retries: int = 2
    first: float = 0.5
    most: float = 8.0
    jitter: float = 0.0
    concurrency: int = 4
    final: tuple[type[Exception], ...] = (ValueError, KeyError)


async def attempt(client: Client, prompt: str) -> str:
    """One answer, waiting ``min(first * 2**n, most)`` and some jitter between tries."""
    for n in range(client.retries + 1):
        try:
            return await asyncio.wait_for(client.call(prompt), client.timeout)
        except client.final:
            raise
        except Exception:
            if n == client.retries:
                raise
            await asyncio.sleep(min(client.first * 2**n, client.most) + random.uniform(0, client.jitter))
    raise AssertionError


async def answer_all(client: Client, prompts: list[str | None]) -> list[tuple[str | None, str | None]]:
    """``(answer, error)`` in the order of the prompts."""
    gate = asyncio.Semaphore(client.concurrency)

    async def one(prompt):
        if prompt is None:
            return None, None
        async with gate:
            try:
                return await attempt(client, prompt), None
            except Exception as e:  # noqa: BLE001  reported with the row
                return None, f"{type(e).__name__}: {e}"

    return list(await asyncio.gather(*map(one, prompts)))


def complete(prompts: DataFrame, client: Client, prompt: str = "prompt") -> DataFrame:
    """``prompts`` with ``answer`` and ``error``."""
    at = prompts.columns.index(prompt)

    def run(batches):
        for b in batches:
            out = asyncio.run(answer_all(client, b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([a for a, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], [*b.schema.names, "answer", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInArrow(run, f"{kinds}, answer string, error string")


def length_limit(asked: Column, longest: Column, positions: int) -> Column:
    """New tokens that still fit the model's positions, one at least."""
    return F.greatest(F.lit(1), F.least(asked, F.lit(positions) - longest))

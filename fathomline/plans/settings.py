"""Settings of the pipeline: a flat YAML file, overridden by environment variables, cast strictly."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    input_glob: str = "data/**/*.txt"
    chunks_path: str = "out/chunks.jsonl"
    records_path: str = "out/records.jsonl"
    collection: str = "chunks"
    query: str = ""
    embed_model: str = ""
    device: str = "cpu"
    llm_url: str = ""
    llm_key: str = ""
    llm_model: str = ""
    llm_temperature: float = 0.2
    llm_tokens: int = 512
    conv_id: str = "default"
    branch_id: str = "main"
    chunk_size: int = 1024
    chunk_overlap: int = 128
    dimension: int = 768
    metric: str = "cosine"
    top_k: int = 10
    history_budget: int = 256
    context_chars: int = 32000
    concurrency: int = 4
    timeout: float = 60.0
    retries: int = 2


def _cast(name: str, kind: str, value):
    if kind == "bool":
        if str(value).lower() in ("true", "1", "yes", "on"):
            return True
        if str(value).lower() in ("false", "0", "no", "off"):
            return False
        raise ValueError(f"{name} is no truth value: {value!r}")
    try:
        return {"int": int, "float": float, "str": str}[kind](value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{name} is no {kind}: {value!r}") from e


def load_settings(path: str | None = None, prefix: str = "FATHOMLINE_") -> Settings:
    """An unknown key or a value of the wrong type is an error; ``PREFIX_NAME`` in the environment wins."""
    values = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            values = yaml.safe_load(f) or {}
    known = {f.name: f.type for f in fields(Settings)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for name in known:
        if prefix + name.upper() in os.environ:
            values[name] = os.environ[prefix + name.upper()]
    return Settings(**{k: _cast(k, known[k], v) for k, v in values.items()})

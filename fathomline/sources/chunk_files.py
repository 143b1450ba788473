"""Files to chunks in one go, also from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from ..operators.chunking import ChunkRules, chunks
from ..session import get_session
from . import readers, writers


def chunk_files(spark: SparkSession, paths: str | list[str], rules: ChunkRules = ChunkRules(1024, 128), **options) -> DataFrame:
    """The chunks of all documents under ``paths``; ``options`` are those of :func:`readers.load`."""
    return chunks(readers.load(spark, paths, tidy=False, **options), rules, "id")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Cut files into chunks.")
    p.add_argument("paths", nargs="+")
    p.add_argument("--out", required=True, help="folder for the chunks; .jsonl, .csv or .parquet says in which format")
    p.add_argument("--size", type=int, default=1024)
    p.add_argument("--overlap", type=int, default=128)
    p.add_argument("--separator", action="append", help="in order of preference; an empty one cuts anywhere")
    p.add_argument("--keep", choices=("end", "start", "none"), default="end")
    p.add_argument("--raw", action="store_true", help="cut texts as they are")
    p.add_argument("--keep-blank", action="store_true")
    p.add_argument("--deduplicate", action="store_true")
    p.add_argument("--keep-tags", action="store_true", help="leave HTML as it is")
    a = p.parse_args(argv)
    rules = ChunkRules(a.size, a.overlap, tuple(a.separator) if a.separator else ChunkRules().separators, a.keep, not a.raw, not a.keep_blank, a.deduplicate)
    writers.write(chunk_files(SparkSession.getActiveSession() or get_session("chunk_files"), a.paths, rules, strip_html=not a.keep_tags), a.out)


if __name__ == "__main__":
    main()

"""Sinks for chunks and pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the two formats, in their order.
JSON_ORDER = ["doc_id", "index", "start", "end", "text", "hash64"]
CSV_ORDER = ["doc_id", "index", "start", "end", "hash64", "text"]


def write_jsonl(chunks: DataFrame, path: str) -> None:
    chunks.select(*JSON_ORDER).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(chunks: DataFrame, path: str) -> None:
    chunks.select(*CSV_ORDER).write.mode("overwrite").option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def write_parquet(chunks: DataFrame, path: str) -> None:
    chunks.select(*JSON_ORDER).write.mode("overwrite").parquet(path)


def write(chunks: DataFrame, path: str) -> None:
    """By the suffix of ``path``; an unknown one gives JSON lines."""
    end = path.rsplit(".", 1)[-1].lower()
    {"csv": write_csv, "parquet": write_parquet}.get(end, write_jsonl)(chunks, path)


#: what a page may carry beside its text; missing columns are written as nulls
PAGE_PARTS = {"image": "binary", "cells": "array<struct<text: string, box: array<double>>>", "segments": "array<struct<label: string, text: string, box: array<double>>>", "extra": "map<string,string>"}


def write_pages(pages: DataFrame, path: str) -> None:
    """Converted pages with their image, cells, segments and extra values, compressed with zstd."""
    parts = [F.col(c).cast(t).alias(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in PAGE_PARTS.items()]
    pages.select(*[c for c in pages.columns if c not in PAGE_PARTS], *parts).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_texts(rows: DataFrame, path: str, by: list[str], text: str) -> None:
    """One folder for each value of ``by``, its text in one file."""
    rows.select(*by, F.coalesce(F.col(text), F.lit("")).alias("value")).repartition(*by).write.mode("overwrite").partitionBy(*by).text(path)


def write_tables(tables: DataFrame, path: str) -> None:
    """Detected tables ``(path, table_no, csv, html)``: one CSV and one HTML file for each."""
    each = tables.select(F.sha2("path", 256).alias("document"), "table_no", F.explode(F.create_map(F.lit("csv"), F.col("csv"), F.lit("html"), F.col("html"))).alias("kind", "value"))
    write_texts(each, path, ["kind", "document", "table_no"], "value")


def write_markdown(pages: DataFrame, path: str) -> None:
    """The Markdown of each converted document, its pages in order, in one file."""
    whole = pages.filter("page_no is not null").groupBy(F.sha2("path", 256).alias("document"))
    joined = whole.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("markdown", F.lit("")).alias("m")))), lambda x: x["m"]), "\n\n").alias("value"))
    write_texts(joined, path, ["document"], "value")


def write_files(rows: DataFrame, path: str, name: str = "name", content: str = "content") -> list[str]:
    """One file for each row, as for images of pages, tables and figures; the folders written to, relative to ``path``.

    A file is written whole under its own name, so a task that runs again
    leaves the same files. Names may have folders in them, but not lead out of
    ``path``; rows without content are passed over.
    """

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for b in batches:
            folders = set()
            for n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts = n.split("/")
                if ".." in parts or n.startswith("/"):
                    raise ValueError(f"{n} leads out of the folder")
                folders.add("/".join(parts[:-1]))
                system.create_dir("/".join([base, *parts[:-1]]), recursive=True)
                with system.open_output_stream(f"{base}/{n}") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(folders), pa.string())], ["folder"])

    done = rows.select(F.col(name), F.col(content).cast("binary")).filter(F.col(name).isNotNull() & F.col(content).isNotNull()).mapInArrow(run, "folder string")
    return sorted(r.folder for r in done.distinct().collect())  # one for each document


def write_images(pages: DataFrame, path: str, image: str = "image", kind: str = "page") -> list[str]:
    """The images of converted pages, tables or figures, as ``<document>/<kind>-<number>.png``."""
    file = F.concat(F.sha2("path", 256), F.lit(f"/{kind}-"), F.lpad(F.col("page_no").cast("string"), 5, "0"), F.lit(".png"))
    return write_files(pages.select(file.alias("name"), F.col(image).alias("content")), path)

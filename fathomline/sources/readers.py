"""Files of many formats as documents ``(id, text, path, type, record)``.

Paths are what Spark's own readers take: files, folders (read recursively)
and globs. One job reads all files; a file that can't be parsed gives no
document and does not stop the others: :func:`failed` names it. Files of many
records are read by :func:`load_records`, which splits them.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_to_text, normalize, suffix

DOCUMENT = "id string, text string, path string, type string, record int"
KINDS = {
    ".txt": "text", ".md": "text", ".log": "text", ".rst": "text", ".html": "html", ".htm": "html", ".json": "json", ".jsonl": "jsonl",
    ".ndjson": "jsonl", ".yaml": "yaml", ".yml": "yaml", ".csv": "csv", ".parquet": "parquet",
}


def leaves(value) -> Iterator[str]:
    """The scalars of nested data, depth first; nulls are skipped."""
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, (list, tuple)):
        for v in value:
            yield from leaves(v)
    elif value is not None:
        yield value if isinstance(value, str) else str(value)


def at_path(value, path: str):
    """The value at a dotted path, numbers being places in a list; None if there is none."""
    for part in path.split("."):
        if isinstance(value, dict) and part in value:
            value = value[part]
        elif isinstance(value, list) and part.lstrip("-").isdigit() and -len(value) <= int(part) < len(value):
            value = value[int(part)]
        else:
            return None
    return value


def flatten(value, fields: tuple[str, ...] | None = None) -> str:
    """All leaves, or those under ``fields``, one to a line; empty ones left out."""
    parts = leaves(value) if not fields else (x for f in fields for x in leaves(at_path(value, f)))
    return "\n".join(x for x in parts if x)


def parse_json(text: str, fields: tuple[str, ...] | None = None) -> str:
    """A whole JSON text, else its lines that are JSON."""
    try:
        return flatten(json.loads(text), fields)
    except ValueError:
        return "\n".join(x for x in (flatten(v, fields) for v in parse_lines(text)) if x)


def parse_lines(text: str) -> Iterator:
    for line in text.splitlines():
        if line.strip():
            try:
                yield json.loads(line)
            except ValueError:
                continue


def parse_yaml(text: str, fields: tuple[str, ...] | None = None) -> str:
    """Flattened YAML; the plain text where there is no parser or it fails."""
    try:
        import yaml

        return flatten(yaml.safe_load(text), fields)
    except Exception:  # noqa: BLE001
        return text


def parse_csv(text: str, columns: tuple[str, ...] | None = None) -> str:
    """Rows to lines, cells joined by spaces: ``columns`` that exist, else those with a cell that is no number, else all."""
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        return ""
    head, body = rows[0], rows[1:]
    keep = [i for i, h in enumerate(head) if columns and h in columns]
    if not keep:
        keep = [i for i in range(len(head)) if any(i < len(r) and r[i] and not _number(r[i]) for r in body)] or list(range(len(head)))
    return "\n".join(" ".join(r[i] if i < len(r) and r[i] else "nan" for i in keep) for r in body)


def _number(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return False
    return True


def parse_parquet(data: bytes, columns: tuple[str, ...] | None = None) -> str:
    """Column after column, a value to a line; null as ``None``."""
    import pyarrow.parquet as pq

    table = pq.read_table(io.BytesIO(data))
    names = [c for c in table.column_names if columns and c in columns] or [f.name for f in table.schema if pa.types.is_string(f.type) or pa.types.is_large_string(f.type)] or table.column_names
    return "\n".join(str(v) for n in names for v in table.column(n).to_pylist())


def _one(kind: str, data: bytes, options: dict) -> list[tuple[int | None, str]]:
    if kind == "parquet":
        return [(None, parse_parquet(data, options.get("parquet_columns")))]
    text = data.decode("utf-8", "replace")
    if kind == "jsonl":
        return list(enumerate(flatten(v, options.get("json_fields")) for v in parse_lines(text)))
    parse: dict[str, Callable[[str], str]] = {
        "json": lambda t: parse_json(t, options.get("json_fields")),
        "yaml": lambda t: parse_yaml(t, options.get("yaml_fields")),
        "csv": lambda t: parse_csv(t, options.get("csv_columns")),
    }
    return [(None, parse.get(kind, lambda t: t)(text))]


def _parsed(spark: SparkSession, paths: str | list[str], options: dict) -> DataFrame:
    """``(id, text, path, type, record, error)``: every document, and one row with an error for a file without any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    kind = F.lit(None)
    for end, name in KINDS.items():
        kind = F.coalesce(kind, F.when(suffix(F.col("path")) == end, name))
    files = files.select("path", F.coalesce(kind, F.lit("unknown")).alias("type"), "content")

    def run(batches):
        for b in batches:
            rows = []
            for path, name, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    found = _one(name, data or b"", options)
                except Exception as e:  # noqa: BLE001  a bad file becomes a row of its own
                    rows.append((path, None, path, name, None, f"{type(e).__name__}: {e}"))
                    continue
                rows.extend((path if record is None else f"{path}::record:{record}", text, path, name, record, None) for record, text in found)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["id", "text", "path", "type", "record", "error"])

    return files.mapInArrow(run, DOCUMENT + ", error string")


def failed(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """``(path, type, error)`` of the files that :func:`load` can't parse."""
    return _parsed(spark, paths, options).filter("error is not null").select("path", "type", "error")


def load(spark: SparkSession, paths: str | list[str], json_fields: tuple[str, ...] | None = None, yaml_fields: tuple[str, ...] | None = None, csv_columns: tuple[str, ...] | None = None, parquet_columns: tuple[str, ...] | None = None, strip_html: bool = True, tidy: bool = True, drop_blank: bool = True) -> DataFrame:
    """Documents of all files under ``paths``, dispatched by suffix; an unknown suffix is read as text of type ``unknown``."""
    options = {"json_fields": json_fields, "yaml_fields": yaml_fields, "csv_columns": csv_columns, "parquet_columns": parquet_columns}
    docs = _parsed(spark, paths, options).filter("error is null").drop("error")
    if strip_html:
        docs = docs.withColumn("text", F.when(F.col("type") == "html", html_to_text(F.col("text"))).otherwise(F.col("text")))
    if tidy:
        docs = docs.withColumn("text", normalize(F.col("text")))
    return docs.filter(F.col("text").rlike(r"\S")) if drop_blank else docs


def load_records(spark: SparkSession, paths: str | list[str], kind: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """``(id, text, path, type)``: a document for each record of ``jsonl``, ``csv`` or ``parquet`` files, by Spark's own readers.

    Files are split, columns and row groups pruned. JSON lines give all leaves
    or those under ``fields``, tables the columns ``fields`` or all, a value to
    a line; nulls are left out. The id is the file and a hash of the record and
    its place in the split.
    """
    if kind == "jsonl":
        rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"))

        def run(batches):
            for b in batches:
                out, at = [], []
                for i, line in enumerate(b.column(2).to_pylist()):
                    for value in parse_lines(line):
                        out.append(flatten(value, fields))
                        at.append(i)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(out, pa.string())], ["path", "block", "text"])

        rows = rows.mapInArrow(run, "path string, block long, text string")
    elif kind in ("csv", "parquet"):
        reader = spark.read.option("header", "true").option("multiLine", "false") if kind == "csv" else spark.read
        table = getattr(reader, kind)(paths)
        names = [c for c in table.columns if not fields or c in fields]
        rows = table.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.concat_ws("\n", *[F.col(f"`{c}`").cast("string") for c in names]).alias("text"))
    else:
        raise ValueError(f"no records in {kind}")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(F.concat_ws("::", "path", F.concat_ws(":", "block", place.cast("string")), F.hex(F.xxhash64("text"))).alias("id"), "text", "path", F.lit(kind).alias("type"))


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of a JSONL file, strictly: a malformed line is an error."""
    schema = "doc_id string, `index` int, start int, `end` int, text string, hash64 decimal(20,0)"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: The recognition engines that a converter can be asked for.
ENGINES = ("tesseract_cli", "tesseract", "easyocr", "rapidocr", "ocrmac")


def ocr_options(engine: str, languages: tuple[str, ...] = ("en",), whole_page: bool = False) -> dict:
    """What a converter is told of the engine; one that is not known is an error."""
    if engine not in ENGINES:
        raise ValueError(f"no recognition engine {engine}; there are {', '.join(ENGINES)}")
    return {"engine": engine, "languages": list(languages), "whole_page": whole_page}


def convert(spark: SparkSession, paths: str | list[str], converter: Callable[[str, bytes], list[tuple[int, str, str]]]) -> DataFrame:
    """Pages ``(path, document_hash, page_no, page_hash, text, markdown)`` by a pluggable converter.

    ``converter(path, content)`` gives ``(page_no, text, markdown)`` rows; a
    file on which it fails gives one row with ``error`` and nothing else. Layout and character recognition
    engines are external; this is their boundary.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", F.sha2("content", 256).alias("document_hash"), "content")

    def run(batches):
        for b in batches:
            rows = []
            for path, digest, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    rows.extend([(path, digest, no, text, md, None) for no, text, md in converter(path, data)])
                except Exception as e:  # noqa: BLE001  a bad file becomes a row of its own
                    rows.append((path, digest, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "document_hash", "page_no", "text", "markdown", "error"])

    pages = files.mapInArrow(run, "path string, document_hash string, page_no int, text string, markdown string, error string")
    return pages.withColumn("page_hash", F.sha2(F.concat_ws(":", "document_hash", (F.col("page_no") - 1).cast("string")), 256))

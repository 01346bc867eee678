"""Header files as element rows: JSON dumps of the standard's JSON model, one object of elements for each file.

An element is ``"GGGGEEEE": {"vr": ..., "Value": [...]}``; a sequence's values are objects of elements again; a person's
name is an object of its spellings. Rows: file, path, parent, depth, tag, keyword, vr, state, vals, as the conformance
and de-identification operators take them. Nothing below a private element is visited; pixel data never is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.files import visible

PIXELS = "7FE00010"
READ_FAILED = "DICOM_READ_FAILED"
_ROWS = "file string, path string, parent string, depth int, tag string, keyword string, vr string, state string, vals array<string>, error_type string"
_SCHEMA = pa.schema([("file", pa.string()), ("path", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("tag", pa.string()), ("keyword", pa.string()), ("vr", pa.string()), ("state", pa.string()), ("vals", pa.list_(pa.string())), ("error_type", pa.string())])


def is_private(tag: str) -> bool:
    """Whether the group of a tag is odd."""
    return int(tag[3], 16) % 2 == 1


def _text(value) -> str:
    if isinstance(value, dict):
        return next((str(v) for k in ("Alphabetic", "Ideographic", "Phonetic") if (v := value.get(k))), "")
    return "" if value is None else str(value)


def walk(elements: dict, names: dict[str, str], above: str = "", depth: int = 0) -> Iterator[tuple]:
    """(path, parent, depth, tag, keyword, vr, state, vals) of all elements, sequences before what they hold. An element
    without values, or with empty ones alone, is empty, as is a sequence without items; others exist."""
    for tag in sorted(elements):
        element = elements[tag]
        tag = tag.upper()
        if tag == PIXELS or not isinstance(element, dict) or len(tag) != 8:
            continue
        name, values = names.get(tag), element.get("Value") or []
        path = f"{above}.{name or tag}" if above else name or tag
        items = [v for v in values if isinstance(v, dict)] if element.get("vr") == "SQ" else []
        vals = [] if element.get("vr") == "SQ" else [_text(v) for v in values]
        full = bool(items) or any(v.strip() for v in vals) or "InlineBinary" in element or "BulkDataURI" in element
        yield path, above or None, depth, tag, name, element.get("vr"), "exists" if full else "empty", vals
        if not is_private(tag):
            for k, item in enumerate(items):
                yield from walk(item, names, f"{path}[{k}]", depth + 1)


def elements(dumps: DataFrame, names: dict[str, str]) -> DataFrame:
    """Element rows of dumps (file, content); a dump that cannot be read is one row with its error_type alone. ``names``:
    keywords of tags, as a published dictionary lists them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    found = json.loads(raw.as_py())
                    if not isinstance(found, dict):
                        raise ValueError
                    out = [(file, *row, None) for row in walk(found, names)]
                except (ValueError, TypeError, RecursionError):
                    out = [(file, None, None, None, None, None, None, None, None, READ_FAILED)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    return dumps.select("file", "content").mapInArrow(rows, _ROWS)


def list_files(spark: SparkSession, roots: list[str], suffix: str = ".json") -> DataFrame:
    """Distinct paths of header files under some roots, sorted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select("path")
    return found.where(visible(F.regexp_extract("path", r"([^/]+)$", 1)) & F.lower("path").endswith(suffix)).distinct().orderBy("path")


def scan(spark: SparkSession, root: str, names: dict[str, str], suffix: str = ".json") -> tuple[DataFrame, DataFrame]:
    """(element rows, one row with the counts of files read and skipped) of a folder; files of another suffix are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(visible(F.regexp_extract("path", r"([^/]+)$", 1)))
    header = F.lower("path").endswith(suffix)
    counts = files.select(header.alias("header")).agg(F.count_if("header").alias("files"), F.count_if(~F.col("header")).alias("skipped"))
    return elements(files.where(header).select(F.col("path").alias("file"), "content"), names), counts


def write_jsonl(reports: DataFrame, folder: str) -> None:
    """One JSON record for each file."""
    reports.write.mode("error").json(folder)

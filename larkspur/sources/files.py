"""Folders of files as rows: scanning, types, checksums, decoding, markers and manifests."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.editions import glob_regex

#: Types by extension.
TYPES = {"md": "md", "markdown": "md", "txt": "txt", "pdf": "pdf", "xml": "xml", "html": "html", "htm": "html", "docx": "docx", "xlsx": "xlsx", "doc": "doc"}
#: Typed failures.
ERRORS = ("UNSUPPORTED_FILE_TYPE", "EMPTY_DOCUMENT", "CORRUPTED_FILE", "ENCRYPTED_PDF", "ENCRYPTED_FILE", "NO_EXTRACTABLE_TEXT", "DB_ERROR", "UNEXPECTED_ERROR")


def visible(rel_path: Column) -> Column:
    """Neither hidden (a part that begins with a dot) nor an Office lock file."""
    return ~rel_path.rlike(r"(^|/)\.") & ~rel_path.rlike(r"(^|/)~\$[^/]*$")


def file_type(path: Column) -> tuple[Column, Column]:
    """(type, supported) by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, ext), ext), F.map_contains_key(known, ext)


def describe(files: DataFrame, root: str, include: tuple[str, ...] = ()) -> DataFrame:
    """Rows of path, length, modificationTime, content as discovered files, hidden ones left out."""
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    kind, supported = file_type(F.col("path"))
    df = files.withColumn("rel_path", rel).where(visible(F.col("rel_path")))
    if include:
        df = df.where(F.col("rel_path").rlike("|".join(map(glob_regex, include))))
    return df.select("path", "rel_path", F.element_at(F.split("path", "/"), -1).alias("file_name"), kind.alias("file_type"), supported.alias("supported"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("checksum"), "content")


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = ()) -> DataFrame:
    """All files below ``root``."""
    return describe(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root, include)


def scan_text(spark: SparkSession, root: str) -> DataFrame:
    """Readable text files of a folder: path and text."""
    return scan(spark, root).where(F.col("file_type").isin("md", "txt")).select("path", decode(F.col("content")).alias("decoded")).select("path", "decoded.*")


def decode_bytes(raw: bytes) -> tuple[str | None, str | None]:
    """UTF-8 without its mark, else the Korean code page, else a typed failure."""
    for codec in ("utf-8-sig", "cp949"):
        try:
            return raw.decode(codec), None
        except UnicodeDecodeError:
            pass
    return None, "CORRUPTED_FILE"


def decode(content: Column) -> Column:
    import pandas as pd

    def rows(raws: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_bytes(bytes(r)) for r in raws], columns=["text", "error_type"])

    return F.pandas_udf(rows, "struct<text:string,error_type:string>")(content)


def under_roots(path: str, roots: list[str]) -> str:
    """The real path, if it lies below one of the roots; refused otherwise."""
    real = os.path.realpath(path)
    if not any(real == os.path.realpath(r) or real.startswith(os.path.realpath(r) + os.sep) for r in roots):
        raise PermissionError("the path lies outside the allowed folders")
    if not os.path.exists(real):
        raise FileNotFoundError(path)
    return real


def read_marker(text: str | None) -> dict:
    """A corpus marker (name, classification, include, versions), as YAML if that can be read here, else as JSON;
    an empty dictionary where it is missing or broken."""
    if not text:
        return {}
    try:
        try:
            import yaml

            found = yaml.safe_load(text)
        except ImportError:
            found = json.loads(text)
    except Exception:
        return {}
    return found if isinstance(found, dict) else {}


def manifest_frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Edition entries (match, family, version, date, superseded) in their order, patterns as regular expressions."""
    rows = [(k, glob_regex(e["match"]), e.get("family"), e.get("version"), e.get("date"), bool(e.get("superseded"))) for k, e in enumerate(entries) if e.get("match")]
    return spark.createDataFrame(rows, "ord int, pattern string, family string, label string, date string, superseded boolean")

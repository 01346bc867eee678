"""The corpus pipeline: documents through five operators, each stage written as Parquet and read by the next.

Null, empty and repeated rows are treated as the operators say: quality rules drop texts without words, equal texts
leave one row, near copies leave the smallest doc_id, pseudonyms keep null texts, packing takes null texts as empty.
Columns beyond those of ``documents`` pass through all stages but the last. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import exact_dedup, jaccard_join, packing, pseudonyms, quality_rules
from larkspur.llm.common import remove, shared_folder, staged_tables

SEQUENCE_TOKENS = 2048
#: Near copies share this percentage of their distinct shingles of so many words.
NEAR_SHINGLE = 5
NEAR_PERCENT = 80
TOKENIZER = "byte_bpe_50k.json"


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality_rules.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs, NEAR_SHINGLE, NEAR_PERCENT)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data."""
    return pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), SEQUENCE_TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("pseudonyms", private_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL has no byte-level BPE, no Feistel network and no best-fit plan; tests hold each stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``. What a stage staged and its input are deleted once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/larkspur/pipeline-{uuid.uuid4().hex}"
    before, written = staged_tables(), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        for left in [*(staged_tables() - before), *([written] if written else [])]:
            remove(spark, left)
        docs, written = spark.read.parquet(path), path
    return docs

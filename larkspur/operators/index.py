"""The index: duplicates, registration against a store, job summaries, resets and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE_CHARS = 2000


def corpus_hash(files: DataFrame) -> DataFrame:
    """SHA-256 of each corpus's sorted ``path:checksum`` lines. A corpus's list of files meets in one row here; where
    that is too much, take corpus_fingerprint."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "rel_path", "checksum"))), "\n")
    return files.groupBy("corpus").agg(F.sha2(F.concat(lines, F.lit("\n")), 256).alias("corpus_hash"), F.count("*").alias("files"))


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """One hash for each corpus: file hashes added up independently of order, so that no corpus meets in one row."""
    line = F.sha2(F.concat_ws(":", "rel_path", "checksum"), 256)
    part = lambda k: F.sum(F.conv(F.substring(line, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    return files.groupBy("corpus").agg(F.sha2(F.concat_ws("-", *(part(k).cast("string") for k in range(4))), 256).alias("corpus_hash"), F.count("*").alias("files"))


def mark_duplicates(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds duplicate_of: the first path of equal content in this run, NULL for that one itself. The first path of
    each checksum comes from an aggregation, so copies of one file need not meet in a task."""
    first = files.groupBy("checksum").agg(F.min(path).alias("_first"))
    return files.join(first, "checksum").withColumn("duplicate_of", F.when(F.col(path) != F.col("_first"), F.col("_first"))).drop("_first")


def register(files: DataFrame, store: DataFrame, model: str) -> DataFrame:
    """What to do with each file of a run: insert; reprocess (failed before, or another model); retag (corpus,
    classification or edition changed); keep. The store's other rows are kept. Columns: checksum, corpus,
    classification, edition; the store's also status and embedding_model."""
    a, b = files.alias("a"), store.alias("b")
    same = F.expr("a.corpus <=> b.corpus and a.classification <=> b.classification and a.edition <=> b.edition")
    action = F.when(F.col("a.checksum").isNull(), "keep").when(F.col("b.checksum").isNull(), "insert").when((F.col("b.status") == "FAILED") | ~F.col("b.embedding_model").eqNullSafe(F.lit(model)), "reprocess").when(same, "keep").otherwise("retag")
    return a.join(b, F.col("a.checksum") == F.col("b.checksum"), "full_outer").select(
        F.coalesce("a.checksum", "b.checksum").alias("checksum"), *(F.when(F.col("a.checksum").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("corpus", "classification", "edition")), action.alias("action")
    )


def outcomes(processed: DataFrame) -> DataFrame:
    """A row for each document: INDEXED with its chunks, or FAILED with a typed error and no chunk. Columns:
    document_id, n_chunks, error_type, error_message."""
    bad = F.col("error_type").isNotNull() | (F.col("n_chunks") == 0)
    return processed.select("document_id", F.when(bad, "FAILED").otherwise("INDEXED").alias("status"), F.when(bad, 0).otherwise(F.col("n_chunks")).alias("chunk_count"), F.when(bad, F.coalesce("error_type", F.lit("EMPTY_DOCUMENT"))).alias("error_type"), F.substring("error_message", 1, MESSAGE_CHARS).alias("error_message"))


def job_summary(results: DataFrame) -> DataFrame:
    """Totals of a run by status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("total"), n("INDEXED").alias("indexed"), n("FAILED").alias("failed"), n("SKIPPED_DUPLICATE").alias("skipped_duplicate"))


def job_details(results: DataFrame) -> DataFrame:
    """A run's outcome for each path, as its report lists them: by path."""
    return results.select("path", "status", "error_type", "chunk_count").orderBy("path")


def report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each document: status, chunks in the index, seconds from start to end; by name."""
    held = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    seconds = F.round(F.unix_micros("finished_at") / 1e6 - F.unix_micros("started_at") / 1e6, 3)
    return documents.join(held, "document_id", "left").select("file_name", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"), seconds.alias("seconds")).orderBy("file_name")


def listed(documents: DataFrame) -> DataFrame:
    """All documents, by name."""
    return documents.orderBy("file_name", "document_id")


def reset(documents: DataFrame) -> DataFrame:
    """Every document to be indexed anew, but for those that failed for reasons of their own."""
    own = (F.col("status") == "FAILED") & F.col("error_type").isNotNull() & (F.col("error_type") != "REINDEX_REQUIRED")
    return documents.withColumn("status", F.lit("FAILED")).withColumn("error_type", F.when(own, F.col("error_type")).otherwise("REINDEX_REQUIRED")).withColumn("chunk_count", F.lit(0))


def stale(chunks: DataFrame, model: str) -> DataFrame:
    """Documents whose chunks are of another model than ``model``."""
    current = chunks.where(F.col("embedding_model") == model).select("document_id").distinct()
    return chunks.select("document_id").distinct().join(current, "document_id", "left_anti")


def changed(old: Column, new: Column) -> Column:
    return ~old.eqNullSafe(new)


def corpora(documents: DataFrame) -> DataFrame:
    """Indexed documents and chunks of each corpus and classification."""
    return documents.where("status = 'INDEXED'").groupBy("corpus", "classification").agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def health(chunks: DataFrame, documents: DataFrame, dimension: int) -> DataFrame:
    """Models in the index, vectors of another dimension, and documents waiting to be indexed anew."""
    a = chunks.agg(F.array_sort(F.collect_set("embedding_model")).alias("models"), F.count_if(F.size("embedding") != dimension).alias("wrong_dimension"))
    return a.join(documents.agg(F.count_if(F.col("error_type") == "REINDEX_REQUIRED").alias("pending")))


def chunks_by_corpus(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    joined = chunks.join(documents.select("document_id", "corpus"), "document_id", "left")
    return joined.groupBy(F.coalesce("corpus", F.lit("(none)")).alias("corpus")).agg(F.count("*").alias("chunks"))


def model_name(c: Column) -> Column:
    return F.regexp_replace(c, ":latest$", "")

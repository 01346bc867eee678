"""Incremental indexing: files that have arrived since the last run, each batch written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from larkspur.sources.files import describe

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the files below ``root``, as ``sources.files.scan`` describes them."""
    found = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(SCHEMA).load(root)
    return describe(found, root)


def run_available(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand all files not seen under ``checkpoint`` to ``handle`` in batches, and end."""
    query = arriving(spark, root).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

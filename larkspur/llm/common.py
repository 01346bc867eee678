"""Shared plumbing of the training-data operators: staged tables, ordered positions, Arrow helpers.

Intermediate tables are written as Parquet below the folder named by ``spark.checkpoint.dir``, so that lost
executors cost a re-read and never a recomputation of the lineage.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = r"[\x20\x09-\x0D]+"
_POSITION_BITS = 33
_staged: set[str] = set()
#: Bits of the filters that ``slots`` makes, and rows of the one that ``keep_marked`` broadcasts at most.
FILTER_BITS = 24
KEPT_SLOTS = 1 << 18
#: Rows that go to a Python worker at once while a table is staged.
STAGED_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set and the session runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    spark.conf.set("spark.checkpoint.dir", folder)
    atexit.register(_remove_local, folder[len("file://"):])
    return folder


def _remove_local(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, fixes row identities, prunes columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(STAGED_ROWS if int(rows) <= 0 else min(int(rows), STAGED_ROWS)))  # texts can be long
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, rows)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._larkspur_path = path
    _staged.add(path)
    return staged


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in one partition for each core at most, for aggregates that are small beside the number of shuffle partitions:
    each file of a task costs requests to the store, and on local disks processes of their own."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        remove(df.sparkSession, df._larkspur_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _staged.discard(path)


def staged_tables() -> set[str]:
    """Paths of the staged tables that are left."""
    return set(_staged)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slots(values: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the low bits of a long column ``slot``, as 64-bit words; its size doesn't grow with the data."""
    low = F.col("slot").bitwiseAND(F.lit((1 << bits) - 1))
    words = values.select(F.shiftright(low, 6).alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    found = words.toArrow()  # one row for each word at most
    out = np.zeros(1 << bits - 6, dtype=np.int64)
    out[found.column("w").to_numpy()] = found.column("m").to_numpy()
    return out


def passing(df: DataFrame, words: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose last column, ``slot``, is in a bitmap of ``slots``: all that were put in and few others."""
    mask, last = len(words) * 64 - 1, len(df.columns) - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(last).to_numpy() & mask
            yield b.filter(pa.array((words[p >> 6] >> (p & 63)) & 1 == 1))

    return df.mapInArrow(freeing(rows), df.schema)


def text_hash(column: Column | str = "text") -> Column:
    return F.xxhash64(F.coalesce(column, F.lit("")))


def keep_marked(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``marked`` (doc_id, text_hash, drop) says to drop, and with one row of those that it
    lists without dropping them. Only rows that share a slot with a marked one are shuffled; the table of slots that is
    broadcast has at most KEPT_SLOTS rows, whatever the data. Columns are unchanged, whatever their names."""
    own, slot, hit, m_id, m_hash, m_drop = fresh(docs, "own", "slot", "hit", "m_id", "m_hash", "m_drop")
    place = lambda doc, text: F.pmod(F.xxhash64(doc, text), F.lit(KEPT_SLOTS))
    marked = stage(marked, "marked-rows")
    hits = F.broadcast(marked.select(place("doc_id", "text_hash").alias(hit)).distinct())
    rows = docs.withColumn(own, text_hash()).withColumn(slot, place(F.col("doc_id").cast("long"), F.col(own)))
    rest = rows.join(hits, F.col(slot) == F.col(hit), "left_anti").select(*docs.columns)
    some = rows.join(hits, F.col(slot) == F.col(hit), "left_semi")
    marks = marked.select(F.col("doc_id").alias(m_id), F.col("text_hash").alias(m_hash), F.col("drop").alias(m_drop))
    some = some.join(marks, F.col("doc_id").eqNullSafe(F.col(m_id)) & (F.col(own) == F.col(m_hash)), "left")
    once = some.where(~F.col(m_drop)).dropDuplicates(["doc_id", own])
    return rest.unionByName(some.where(F.col(m_drop).isNull()).select(*docs.columns)).unionByName(once.select(*docs.columns))


def positions(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Number all rows from 0 in the order of ``order`` (column ``pos``) without a single-task window.

    Rows are range-partitioned and sorted; each carries its partition and its place there. Only one count per
    partition reaches the driver. Returns the numbered rows and the staged table below them.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    staged = stage(ranged, name)
    part = F.shiftright("_place", _POSITION_BITS)
    counts = sorted(staged.groupBy(part.alias("p")).count().collect())
    bases, total = [], 0
    for p, n in counts:
        bases.append((p, total))
        total += n
    base = F.broadcast(spark.createDataFrame(bases, "_part long, _base long"))
    numbered = (
        staged.withColumn("_part", part)
        .join(base, "_part", "left")
        .withColumn("pos", F.col("_base") + F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_part", "_base", "_place")
    )
    return numbered, staged


def slices(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each, to bound what is held at once; one text at least."""
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text or "") + 64
        if held >= limit:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few texts are held as Python strings at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def give_back() -> None:
    """Return this process's free memory to the system: Arrow's, and what malloc keeps between blocks in use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freeing(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows`` for mapInArrow, after whose last batch the worker gives back its free memory. Spark keeps workers beyond
    their tasks, more of them than there are cores, so that what idle ones hold counts beside a running task and the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return run


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)

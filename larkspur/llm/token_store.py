"""Token-id store: one zstandard frame per document under a shared dictionary, with an offset index.

Format (version 1). A store is a folder with three Parquet tables, so that any file system Spark reaches will do:

* ``dictionary`` - one row: ``version``, ``width`` (bytes per id, little-endian unsigned), ``dict_sha256``,
  ``dictionary`` (the shared zstandard dictionary; empty: none).
* ``segments`` - rows of about ``segment_bytes`` of concatenated frames: ``part`` and ``seg`` (order), ``first_doc``
  and ``last_doc`` (for pruning), ``dict_sha256``, ``payload`` and ``index``, one entry per document:
  ``doc_id, offset, length, n_tokens, local_start``.
* ``parts`` - ``part, base``: ids before each part; ``base + local_start`` is a document's ``start``.

The dictionary is trained on a bounded sample (``sample_docs`` documents of the smallest hash among those of at most
``sample_chars`` characters); it changes sizes only, never ids. Documents lie in ascending doc_id order, null ids
first, repeated rows side by side; null texts are empty and hold the end id alone. An empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import batch, shared_folder, small, stage, unstage
from larkspur.llm.tokenizing import encode_texts

VERSION = 1
_SEGMENTS = "part int, seg int, first_doc long, last_doc long, dict_sha256 string, n_docs long, n_tokens long, payload binary, index array<struct<doc_id:long,offset:long,length:long,n_tokens:long,local_start:long>>"
_INDEX = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "offset", "length", "n_tokens", "local_start")]))
_SEGMENT_ROWS = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("dict_sha256", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary()), ("index", _INDEX)])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])
_DECODED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


@dataclass(frozen=True)
class StoreOptions:
    tokenizer: str
    width: int = 2
    level: int = 3
    dict_bytes: int = 112_640
    sample_docs: int = 512
    sample_chars: int = 32_768
    segment_bytes: int = 4 << 20


def serialise(ids: np.ndarray, width: int) -> bytes:
    if ids.size and int(ids.max()) >> (8 * width):
        raise ValueError(f"an id does not fit {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def _compressor(dictionary: bytes, level: int):
    import zstandard as z

    if not dictionary:
        return z.ZstdCompressor(level=level)
    shared = z.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=level)  # else it is digested anew for each frame
    return z.ZstdCompressor(level=level, dict_data=shared)


def _decompressor(dictionary: bytes):
    import zstandard as z

    return z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(dictionary) if dictionary else None)


def train(samples: list[bytes], size: int) -> bytes:
    """A shared dictionary; raw sample content where the samples are too few to train one."""
    import zstandard as z

    total = sum(map(len, samples))
    if total < 256:
        return b""
    try:
        return z.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-min(size, total):]


def _candidates(docs: DataFrame, o: StoreOptions) -> DataFrame:
    """The texts that the sample is taken from: those up to the hash of its last, found among hashes alone, so that no
    partition sends as many texts as the sample has."""
    texts = docs.where(F.char_length("text").between(1, o.sample_chars)).select("text")
    last = texts.select(F.xxhash64("text").alias("h")).orderBy("h").limit(o.sample_docs).agg(F.max("h")).first()[0]
    return texts.where(F.xxhash64("text") <= F.lit(last))


def _sample(docs: DataFrame, o: StoreOptions) -> list[bytes]:
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([pa.array([serialise(x, o.width) for x in encode_texts(o.tokenizer, b.column(0).to_pylist())], pa.binary())], ["ids"])

    chosen = _candidates(docs, o).orderBy(F.xxhash64("text")).limit(o.sample_docs)
    return sorted(bytes(r.ids) for r in chosen.mapInArrow(ids, "ids binary").collect())


def write_store(docs: DataFrame, folder: str, o: StoreOptions) -> None:
    """Encode all ``docs`` (doc_id, text; other columns ignored) into a store at ``folder``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dictionary = train(_sample(docs, o), o.dict_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _compressor(dictionary, o.level)
        for b in small(batches):
            lengths, frames = [], []
            for ids in encode_texts(o.tokenizer, b.column(1).to_pylist()):
                lengths.append(len(ids))
                frames.append(press.compress(serialise(ids, o.width)))
            yield batch(_ENCODED, b.column(0).cast(pa.int64()), lengths, frames)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, start = TaskContext.get().partitionId(), 0, 0
        payload, index, held, tokens = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            known = [e["doc_id"] for e in index if e["doc_id"] is not None]
            return batch(_SEGMENT_ROWS, [part], [seg], [min(known, default=None)], [max(known, default=None)], [digest], [len(index)], [tokens], [b"".join(payload)], [index])

        for b in batches:
            for doc_id, n, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                index.append({"doc_id": doc_id, "offset": held, "length": len(frame), "n_tokens": n, "local_start": start})
                payload.append(frame)
                held, start, tokens = held + len(frame), start + n, tokens + n
                if held >= o.segment_bytes:
                    yield flush()
                    payload, index, held, tokens, seg = [], [], 0, 0, seg + 1
        if index:
            yield flush()

    encoded = stage(docs.mapInArrow(encode, "doc_id long, n_tokens long, frame binary"), "token-frames")
    order = ["doc_id", "n_tokens", "frame"]
    encoded.repartitionByRange("doc_id").sortWithinPartitions(*order).mapInArrow(segments, _SEGMENTS).write.option("compression", "none").parquet(f"{folder}/segments")
    unstage(encoded)
    sums = sorted(spark.read.parquet(f"{folder}/segments").groupBy("part").agg(F.sum("n_tokens")).collect())
    bases, total = [], 0
    for part, n in sums:
        bases.append((part, total))
        total += n
    spark.createDataFrame(bases, "part int, base long").coalesce(1).write.parquet(f"{folder}/parts")
    spark.createDataFrame([(VERSION, o.width, digest, bytearray(dictionary))], "version int, width int, dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")


def _open(spark: SparkSession, folder: str) -> tuple[int, bytes, str]:
    head = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(head.dictionary)
    if head.version != VERSION or hashlib.sha256(dictionary).hexdigest() != head.dict_sha256:
        raise ValueError("not a store of this version, or its dictionary is damaged")
    return head.width, dictionary, head.dict_sha256


def _frames(row: dict, unpack, digest: str, width: int) -> Iterator[tuple[dict, np.ndarray]]:
    if row["dict_sha256"] != digest:
        raise ValueError("a segment was written with another dictionary")
    payload = memoryview(row["payload"])
    for e in row["index"]:
        raw = unpack.decompress(payload[e["offset"] : e["offset"] + e["length"]])
        ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
        if len(ids) != e["n_tokens"]:
            raise ValueError("a frame does not hold the ids its index promises")
        yield e, ids


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    width, dictionary, digest = _open(spark, folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _decompressor(dictionary)
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                rows = [(e["doc_id"], row["part"], e["local_start"], len(ids), zlib.crc32(ids.tobytes())) for e, ids in _frames(row, unpack, digest, width)]
                yield batch(_DECODED, *zip(*rows))

    found = spark.read.parquet(f"{folder}/segments").select("part", "dict_sha256", "payload", "index").mapInArrow(decode, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    parts = F.broadcast(spark.read.parquet(f"{folder}/parts"))  # one row for each partition written
    return found.join(parts, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document: prunes to its segment, decompresses its frame alone; None where it isn't there."""
    width, dictionary, digest = _open(spark, folder)
    found = (
        spark.read.parquet(f"{folder}/segments")
        .where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
        .select("dict_sha256", "payload", F.explode(F.filter("index", lambda e: e.doc_id == doc_id)).alias("e"))
        .select("dict_sha256", "e", F.expr("substring(payload, cast(e.offset + 1 as int), cast(e.length as int))").alias("frame"))
        .first()
    )
    if found is None:
        return None
    e = {**found.e.asDict(), "offset": 0}
    return next(_frames({"dict_sha256": found.dict_sha256, "payload": bytes(found.frame), "index": [e]}, _decompressor(dictionary), digest, width))[1]


def token_digest(docs: DataFrame, o: StoreOptions) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and read every document back."""
    import uuid

    folder = f"{shared_folder(docs.sparkSession)}/larkspur/token-store-{uuid.uuid4().hex}"
    write_store(docs, folder, o)
    return read_digest(docs.sparkSession, folder)

"""Best-fit packing planned on the histogram of lengths, with documents placed by their rank within a length.

Pieces are counted by length; best-fit decreasing runs on those counts (at most ``capacity`` different lengths), so
the plan is made of a few thousand slot ranges whatever the corpus holds. A piece then finds its slot by joining its
rank within its length to the ranges of that length. Null texts are empty documents of the end id alone; an empty
table gives no rows; repeated rows are packed each; pieces of equal length take slots in any order. Texts of any length
are encoded whole; columns other than doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch, freeing, positions, small, stage, unstage
from larkspur.llm.tokenizing import encode_texts, forget

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: full ones at the end, a shorter first one if need be."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Ranges (length, rank_lo, rank_hi, first_sequence, per_sequence, offset):
    rank r of a length goes to sequence first + (r - lo) // per, at offset + (r - lo) % per * length."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, how many) that have just these
    free: list[int] = []  # its keys, ascending
    made, ranges = 0, []

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(free, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while count:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], free[at]
            else:
                space = capacity
                per = capacity // length
                first, n = made, -(-count // per)
                made += n
            per = space // length
            full = min(n, count // per)
            if full:
                ranges.append((length, rank, rank + full * per, first, per, capacity - space))
                put(space - per * length, first, full)
                rank, count = rank + full * per, count - full * per
            if full < n:
                some = min(count, per)
                if some:  # fewer than a sequence takes
                    ranges.append((length, rank, rank + some, first + full, some, capacity - space))
                    put(space - some * length, first + full, 1)
                    rank, count, full = rank + some, count - some, full + 1
                put(space, first + full, n - full)
    return ranges


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encode_texts(tokenizer, b.column(1).to_pylist())):
                raw = ids.astype("<u4").tobytes()
                rows += [(doc_id, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(piece_bounds(len(ids), capacity))]
            if rows:
                yield batch(_PIECES, *zip(*rows))
        forget()  # other operators use the same workers

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freeing(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Each piece of ``docs`` (doc_id, text) with its sequence_id and its offset there."""
    spark = docs.sparkSession
    pieces = stage(token_pieces(docs, tokenizer, capacity), "pieces")
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each length up to capacity
    numbered, _ = positions(pieces, ["length", "doc_id", "piece", "ids_crc32"], "ranked-pieces")
    unstage(pieces)
    first, before = [], 0
    for length in sorted(histogram):
        first.append((length, before))
        before += histogram[length]
    starts = dict(first)
    ranges = [(length, lo + starts[length], hi + starts[length], seq, per, off) for length, lo, hi, seq, per, off in plan(histogram, capacity)]
    slots = F.broadcast(spark.createDataFrame(ranges, "length long, lo long, hi long, seq long, per long, off long"))  # a few for each length
    at = F.col("pos") - F.col("lo")
    return (
        numbered.join(slots, "length")
        .where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"), (F.col("off") + at % F.col("per") * F.col("length")).alias("offset"))
    )

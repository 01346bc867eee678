"""Exact deduplication by composable polynomial fingerprints, equal ones compared chunk by chunk.

A text is normalised (each run of white space becomes one space) and cut into chunks of ``CHUNK`` bytes. Chunk hashes
are polynomials over two primes below 2^31 and are combined by length-shifted arithmetic, H(xy) = H(x) * r^|y| + H(y),
so chunks can be hashed anywhere and in any order: texts over ``HUGE_BYTES`` are dealt out in pieces to many tasks.
Documents of equal fingerprint and length are only candidates: each is compared with the text of the group's first
document, chunk by chunk, and what differs forms groups of its own. Only texts that are to be compared are shuffled
(a filter of fixed size goes before), and large groups are salted, so neither a group nor a text has to fit one task.

Null texts are empty; empty texts equal each other; null ids sort last; of repeated rows with one doc_id a single one
is kept; ties go to the row read first. An empty table gives no rows. Texts of any length are read whole. ``classes``
reads doc_id and text alone; other columns, whatever their names, pass through ``deduplicate`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch, freeing, keep_marked, passing, slots, stage, text_hash, unstage

CHUNK = 4096
COMPARE_BYTES = 65_536
COPIES_PER_TASK = 512
#: Longer texts are hashed in pieces of PIECE_BYTES.
HUGE_BYTES = 1 << 24
PIECE_BYTES = 1 << 22
#: Groups of copies that are broadcast at most; more are joined by sorting, where skewed keys are split.
GROUPS_BROADCAST = 100_000
#: Primes and bases of the fingerprint.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_013)

_HASHED = pa.schema([("doc_id", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("text_hash", pa.int64())])
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], dtype=np.int64)


_POWERS = [_powers(r, p, CHUNK) for r, p in zip(BASES, PRIMES)]


def normalise(raw: bytes) -> bytes:
    """Each run of white space becomes one space; on UTF-8 bytes, which white space never shares with other characters."""
    a = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[a]
    if not space.any():
        return raw
    keep = ~space
    keep[0] = True
    keep[1:] |= ~space[:-1]
    return np.where(space, np.uint8(0x20), a)[keep].tobytes()


def chunk_hash(raw: bytes) -> tuple[int, int]:
    """Polynomial hash of one chunk of at most CHUNK bytes."""
    a = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    return tuple(int((a @ w[CHUNK - len(a):]) % p) for w, p in zip(_POWERS, PRIMES))


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """(h0, h1, length) of a text from those of its two parts."""
    shifted = ((h * pow(r, right[2], p) + g) % p for h, g, r, p in zip(left, right, BASES, PRIMES))
    return (*shifted, left[2] + right[2])


def fingerprint(raw: bytes) -> tuple[int, int, int]:
    """(h0, h1, length) of a normalised text: all full chunks in one product, then combined in order."""
    full = len(raw) // CHUNK
    total = (0, 0, 0)
    if full:
        chunks = np.frombuffer(raw, dtype=np.uint8, count=full * CHUNK).reshape(full, CHUNK)
        hashes = [np.concatenate([(chunks[k : k + 64].astype(np.int64) @ w) % p for k in range(0, full, 64)]) for w, p in zip(_POWERS, PRIMES)]
        for h0, h1 in zip(*(h.tolist() for h in hashes)):
            total = combine(total, (h0, h1, CHUNK))
    rest = raw[full * CHUNK :]
    return combine(total, (*chunk_hash(rest), len(rest))) if rest else total


def _hashed(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts; h0 and h1 of huge ones are null, for their pieces are hashed apart."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1):
                raw = normalise((text.as_py() or "").encode())
                found = fingerprint(raw) if len(raw) <= HUGE_BYTES else (None, None, len(raw))
                out.append((*found, hashlib.sha256(raw).hexdigest()))
            yield batch(_HASHED, b.column(0).cast(pa.int64()), *(zip(*out) if out else ([],) * 4), b.column(2))

    return docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(freeing(rows), "doc_id long, h0 long, h1 long, n_bytes long, text_sha256 string, text_hash long")


_ROW = ["doc_id", "text_hash"]
_KEY = ["h0", "h1", "n_bytes"]


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"), text_hash().alias("text_hash"))


def _some(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, raw text and text_hash of the rows in ``rows`` and of few others."""
    words = slots(rows.select(F.xxhash64(*_ROW).alias("slot")))
    return passing(_own(docs).withColumn("slot", F.xxhash64(*_ROW)), words).drop("slot")


def _same_row(a: DataFrame, b: DataFrame):
    return a.doc_id.eqNullSafe(b.doc_id) & (a.text_hash == b.text_hash)


def pieces_hashed(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, h0, h1 of the texts in ``rows``: pieces are dealt out, hashed in parallel and combined in order."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k, raw in zip(b.column(2).to_pylist(), b.column(3)):
                # a piece begins with the byte before it, which tells whether it continues a run of white space
                found.append(fingerprint(normalise(raw.as_py())[1 if k else 0 :]))
            h0, h1, n = zip(*found) if found else ((), (), ())
            powers = [[pow(r, x, p) for x in n] for r, p in zip(BASES, PRIMES)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(x, pa.int64()) for x in (h0, h1, *powers))], ["doc_id", "text_hash", "k", "h0", "h1", "q0", "q1"])

    texts, rows = _some(docs, rows), rows.select(*_ROW).distinct()
    texts = texts.join(rows, _same_row(texts, rows), "left_semi").dropDuplicates(_ROW)
    starts = F.sequence(F.lit(0), F.ceil(F.octet_length("raw") / PIECE_BYTES).cast("int") - 1)
    cut = F.expr(f"substring(raw, greatest(k * {PIECE_BYTES}, 1), if(k = 0, {PIECE_BYTES} , {PIECE_BYTES} + 1))")
    dealt = texts.withColumn("k", F.explode(starts)).select(*_ROW, "k", cut.alias("piece")).repartition("text_hash", "k")
    done = dealt.mapInArrow(freeing(hashes), "doc_id long, text_hash long, k int, h0 long, h1 long, q0 long, q1 long")
    parts = F.sort_array(F.collect_list(F.struct("k", "h0", "h1", "q0", "q1")))  # one small row for each piece
    fold = lambda h, q, p: F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: (a * x[q] + x[h]) % p)
    return done.groupBy(*_ROW).agg(parts.alias("parts")).select(*_ROW, fold("h0", "q0", PRIMES[0]).alias("h0"), fold("h1", "q1", PRIMES[1]).alias("h1"))


def _fingerprints(docs: DataFrame) -> DataFrame:
    rows = stage(_hashed(docs).withColumn("rid", F.monotonically_increasing_id()), "fingerprints")
    huge = rows.where("h0 is null")
    if huge.isEmpty():
        return rows
    whole = pieces_hashed(docs, huge)
    filled = huge.join(whole, _same_row(huge, whole)).select(*(whole[c] if c in ("h0", "h1") else huge[c] for c in rows.columns))
    out = stage(rows.where("h0 is not null").unionByName(filled), "fingerprints")
    unstage(rows)
    return out


_CHUNKS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("c", pa.int32()), ("chunk", pa.binary())])


def _differing(docs: DataFrame, members: DataFrame, firsts: DataFrame) -> DataFrame:
    """Members (doc_id, text_hash, key, n) whose text isn't that of their group's first document."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                raw = normalise(b.column(1)[k].as_py())
                at = range(0, max(len(raw), 1), COMPARE_BYTES)
                for x in range(0, len(at), 64):
                    part = at[x : x + 64]
                    yield batch(_CHUNKS, *([b.column(c)[k].as_py()] * len(part) for c in (0, 2)), [p // COMPARE_BYTES for p in part], [raw[p : p + COMPARE_BYTES] for p in part])

    salts = F.ceil(F.col("n") / COPIES_PER_TASK).cast("int")
    wanted = stage(
        members.select(*_ROW, *_KEY, F.pmod(F.xxhash64(*_ROW), salts).cast("int").alias("salt"), F.lit(False).alias("is_first")).unionByName(
            firsts.select(*_ROW, *_KEY, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("is_first"))
        ),
        "compared-rows",
    )
    texts = _some(docs, wanted).mapInArrow(freeing(chunks), "doc_id long, text_hash long, c int, chunk binary")
    small = F.broadcast(wanted) if wanted.count() <= GROUPS_BROADCAST else wanted
    on = [*_KEY, "salt", "c"]
    found = texts.join(small, _same_row(texts, wanted)).select(*on, "is_first", wanted.doc_id, wanted.text_hash, "chunk")
    dealt = found.repartition(*on).sortWithinPartitions(*on, F.desc("is_first"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, chunk = None, None  # of the first document's chunk that is compared with
        for b in batches:
            places = list(zip(*(b.column(c).to_pylist() for c in range(len(on)))))
            out = []
            for k, first in enumerate(b.column(len(on)).to_pylist()):
                own = b.column(b.num_columns - 1)[k].as_buffer()
                if first:
                    place, chunk = places[k], own
                elif place != places[k] or not own.equals(chunk):
                    out.append(k)
            yield b.select([len(on) + 1, len(on) + 2, 0, 1, 2]).take(pa.array(out, pa.int64()))

    apart = dealt.mapInArrow(freeing(compare), "doc_id long, text_hash long, h0 long, h1 long, n_bytes long")
    out = stage(apart.distinct(), "differing")
    unstage(wanted)
    return out


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash of every row."""
    rows = _fingerprints(docs).withColumn("generation", F.lit(0))
    who = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")
    key = [*_KEY, "generation"]
    current = 0
    while True:
        large = rows.groupBy(*key).agg(F.min(who).alias("first"), F.count("*").alias("n"), F.min_by("text_hash", who).alias("first_hash")).where("n > 1")
        large = stage(large, "groups")
        small = large.count() <= GROUPS_BROADCAST
        group = large.select(*key, "n", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("first_rid"))
        group = F.broadcast(group) if small else group
        firsts = large.select(F.col("first.doc_id").alias("doc_id"), F.col("first_hash").alias("text_hash"), *key, "n").where(F.col("generation") == current)
        members = rows.where(F.col("generation") == current).join(group, key).where("rid <> first_rid").select(*_ROW, *key, "n").distinct()
        apart = _differing(docs, members, firsts)
        if apart.isEmpty():
            break
        # equal fingerprints of different texts: the rest of such a group is grouped anew
        apart = apart.withColumn("apart", F.lit(True))
        same = _same_row(rows, apart) & (rows.h0 == apart.h0) & (rows.h1 == apart.h1) & (rows.n_bytes == apart.n_bytes)
        marked = rows.join(apart, same, "left").select(rows["*"], "apart")
        rows = stage(marked.withColumn("generation", F.col("generation") + F.when(F.col("apart"), 1).otherwise(0)).drop("apart"), "fingerprints")
        current += 1
    alone = F.col("first_rid").isNull()
    return rows.join(group, key, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("first_rid"))).alias("kept"),
        "text_sha256",
        "text_hash",
    )


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return _classes(docs).drop("text_hash")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without later copies, columns unchanged."""
    found = _classes(docs).where("group_size > 1").groupBy(*_ROW).agg(F.count("*").alias("n"), (~F.bool_or("kept")).alias("drop"))
    return keep_marked(docs, found.where("drop or n > 1").select(*_ROW, "drop"))

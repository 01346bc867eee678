"""Exact n-gram Jaccard join by signature trees, and the connected components of its links.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct shingles of ``shingle`` words. The join is
exact (up to collisions of 64-bit hashes; common shingles are counted on 48 bits):

1. Documents of equal sets form a class; one of each class goes on.
2. Marks. A share of each document's shingles is counted; those found often are marked in a bitmap of fixed size. Any
   marks would do, for they only order shingles: unmarked ones first, then by hash.
3. Blocks. Whatever the order, two linked documents share one of the first ``n - ceil(percent/100 n) + 1`` shingles of
   either, and their first common one has enough shingles behind it in both. So each member of a block has a reach: the
   largest document that it can link with there. Blocks of marked shingles only take documents that hold few others.
4. Hubs. Every block's members are held against the one whose common shingle comes first, the likeliest original. That
   joins most of a cluster with as many comparisons as members.
5. The rest of each block that isn't one component yet. Up to LEAF members: pairs within reach of different components.
   More: blocks of one main component are put together and dealt into cells; in each, signature trees are built over the
   members, whose nodes hold OR-combined bitmaps of shingles, ranges of sizes, reach and component. Two trees are
   descended together; pairs of nodes go when their largest possible overlap is below the least that a link takes. The
   bitmaps of a cell are exact, so leaves that are left link; those that join components are given out.
6. Pairs are verified on their whole sets. Components come from label propagation on the links.

Null and empty texts have no shingles, link with nothing and are components of their own; fewer words than a shingle has form
one shingle; null ids sort last; repeated rows are copies, ties of size or hash don't matter; an empty table gives no rows.
Texts of any length are read whole, in pieces. ``components`` reads doc_id and text alone; other columns, whatever their names,
are left out by it and unchanged by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import freeing, keep_marked, passing, slices, slots, small, stage, unstage

#: What op10's SQL takes; callers without it give their own.
SHINGLE = 4
PERCENT = 85
SIGNATURE_WORDS = 16  # of 64 bits each, at least
FANOUT = 16
#: Members of a block whose pairs are tried without trees.
LEAF = 64
#: A cell's documents and shingles, about.
CELL = 2048
CELL_SHINGLES = 400_000
#: One of so many shingles of a document is counted; from LEAST_COUNT on they are marked, but no more than MOST_MARKED.
SAMPLE = 8
LEAST_COUNT = 4
MARK_BITS = 24
MOST_MARKED = 1 << 21
SET_ROWS = 500  # documents whose sets are held at once
BUCKET_SHINGLES = 4_000_000

_PIECE = 1 << 19
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _PIECE + 4096)
        inverse = np.uint64(pow(int(_ROOT), -1, 1 << 64))
        _powers[:] = [np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size, r, dtype=np.uint64))]) for r in (_ROOT, inverse)]
    return _powers[0], _powers[1]


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw``, in which A-Z are lower-cased already, and where they begin."""
    a = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(a) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _power(len(a) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[a] * up[: len(a)])])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _long_words(raw: bytes) -> np.ndarray:
    """Hashes of the words of a long text, taken piece by piece."""
    out, at = [], 0
    while at < len(raw):
        cut = at + _PIECE
        while cut < len(raw) and not _SPACE[raw[cut]]:
            cut += 1
        out.append(_word_hashes(raw[at:cut])[0])
        at = cut
    return np.concatenate(out)


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    for a, b in slices(texts, _PIECE // 2):
        raws = [(t or "").encode().lower() for t in texts[a:b]]  # bytes.lower() changes A-Z alone
        if sum(map(len, raws)) > _PIECE:
            words = [_long_words(r) if r else np.zeros(0, dtype=np.uint64) for r in raws]
        else:
            joined, start = _word_hashes(b" ".join(raws))
            ends = np.cumsum([len(r) + 1 for r in raws])
            words = np.split(joined, np.searchsorted(start, ends)[:-1])
        for w in words:
            if len(w) >= shingle:
                s = w[: len(w) - shingle + 1]
                for k in range(1, shingle):
                    s = s * _ROOT + w[k : len(w) - shingle + 1 + k]
                yield np.unique(_mix(s))
            elif len(w):
                s = np.full(1, len(w), dtype=np.uint64)
                for k in range(len(w)):
                    s = s * _ROOT + w[k]
                yield _mix(s + np.uint64(0x5851F42D4C957F2D))
            else:
                yield w


def pack_set(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, six bytes each, ascending."""
    return (hashes >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_set(raw) -> np.ndarray:
    six = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), dtype=np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).reshape(-1)


def signature(hashes: np.ndarray) -> bytes:
    """A bitmap of the shingles, at least twice as wide as there are shingles; it folds to any narrower width."""
    words = SIGNATURE_WORDS
    while words * 32 < len(hashes):
        words *= 2
    bits = np.zeros(words * 64, dtype=np.uint8)
    bits[(hashes >> np.uint64(16)) % np.uint64(words * 64)] = 1
    return np.packbits(bits).tobytes()


def fold(raw, words: int) -> np.ndarray:
    """A bitmap at a narrower width."""
    return np.bitwise_or.reduce(np.frombuffer(raw, dtype=np.uint64).reshape(-1, words), axis=0)


def least_overlap(n: np.ndarray | int, percent: int = PERCENT):
    """The least number of shingles that a document of ``n`` has in common with one that it links with."""
    return -(-percent * n // 100)


def linked(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


# --- 1. sets ---------------------------------------------------------------------------------------------------

_SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("wide", pa.binary()), ("tokens", pa.binary())])


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, SET_ROWS):
            n, k1, k2, wide, tokens = [], [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), shingle):
                key = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
                n.append(len(s))
                k1.append(key[0])
                k2.append(key[1])
                wide.append(signature(s))
                tokens.append(pack_set(s))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), *(pa.array(c, f.type) for c, f in zip((n, k1, k2, wide, tokens), list(_SETS)[2:]))], schema=_SETS)

    own = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return own.mapInArrow(freeing(rows), "doc_id long, text_hash long, n long, k1 long, k2 long, wide binary, tokens binary")


# --- 2. blocks -------------------------------------------------------------------------------------------------


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a column of packed sets, and the row of each."""
    lengths = np.fromiter((len(x) // 6 for x in (v.as_buffer() for v in column)), dtype=np.int64, count=len(column)) if len(column) else np.zeros(0, dtype=np.int64)
    return unpack_set(b"".join(v.as_buffer() for v in column)), np.repeat(np.arange(len(column)), lengths)


def _dealt(values: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its values."""
    order = np.argsort(buckets, kind="stable")
    at = _runs(buckets[order])
    return ((int(buckets[order[x]]), order[x:y]) for x, y in zip(at, at[1:]) if y > x)


def _six(values: np.ndarray) -> bytes:
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _distinct_sets(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch (rid, k1, tokens) by ascending rid, without its copies. Files are read in any order, so rids need not ascend."""
    if b.num_rows:
        _, first = np.unique(b.column(1).to_numpy(), return_index=True)
        first = first[np.argsort(b.column(0).to_numpy()[first])]
        b = b.take(pa.array(first))
        for k in range(0, b.num_rows, SET_ROWS):
            yield b.slice(k, SET_ROWS)


def _marks(sets: DataFrame, buckets: int) -> np.ndarray:
    """Bitmap of the shingles that are found often, of 2^MARK_BITS bits. A shingle's place is its low bits."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _distinct_sets(whole)):
            values, row = _values(b.column(2))
            own = b.column(1).to_numpy().view(np.uint64)[row]
            values = values[_mix(values ^ own) % np.uint64(SAMPLE) == 0]
            dealt = list(_dealt(values, (values % np.uint64(buckets)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in dealt], pa.int32()), pa.array([_six(values[x]) for _, x in dealt], pa.binary())], ["bucket", "tokens"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_buckets(batches):
            tokens, n = np.unique(unpack_set(b"".join(x.as_buffer() for b in held for x in b.column(1))), return_counts=True)
            some = n >= LEAST_COUNT
            yield pa.RecordBatch.from_arrays([pa.array(tokens[some].astype(np.int64)), pa.array(n[some])], ["token", "c"])

    dealt = sets.where("n > 0").select("rid", "k1", "tokens").mapInArrow(freeing(sample), "bucket int, tokens binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = stage(dealt.mapInArrow(freeing(counts), "token long, c long"), "shingle-counts")
    levels = dict(found.groupBy(F.floor(F.log2("c")).cast("int")).count().collect())  # a row for each power of two
    least = max(levels, default=0) + 1
    while least > 0 and sum(n for level, n in levels.items() if level >= least - 1) <= MOST_MARKED:
        least -= 1
    bits = slots(found.where(F.col("c") >= 2**least).select(F.col("token").alias("slot")), MARK_BITS)
    unstage(found)
    return bits


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each bucket, from batches sorted by it (their first column)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            at = _runs(b.column(0).to_numpy())
            for x, y in zip(at, at[1:]):
                if held and b.column(0)[x] != held[0].column(0)[0]:
                    yield held
                    held = []
                held.append(b.slice(x, y - x))
    if held:
        yield held


_PLACES = 1 << 16


def _prefixes(sets: DataFrame, marks: np.ndarray, buckets: int, percent: int) -> DataFrame:
    """Prefixes as packed entries: bucket (-1: marked shingles), base, tokens (six bytes each), places (rid - base) and
    positions within the ordered set, two bytes each; positions beyond that count as its largest number, which only
    widens reach. Copies within a batch are left out here, the rest of them where blocks are made."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _distinct_sets(whole)):
            rid, at = b.column(0).to_numpy(), 0
            while at < b.num_rows:
                end = int(np.searchsorted(rid, rid[at] + _PLACES))
                values, row = _values(b.column(2).slice(at, end - at))
                low = (values & np.uint64((1 << MARK_BITS) - 1)).astype(np.int64)
                heavy = (marks[low >> 6] >> (low & 63)) & 1
                order = np.argsort(2 * row + heavy, kind="stable")  # sets are sorted already
                values, heavy, row = values[order], heavy[order], row[order]
                held = np.bincount(row, minlength=end - at)
                position = np.arange(len(row)) - (np.cumsum(held) - held)[row]
                keep = position < (held - least_overlap(held, percent) + 1)[row]
                values, heavy, row, position = values[keep], heavy[keep], row[keep], position[keep]
                place = rid[at:end] - rid[at]
                assert 0 <= place.min() and place.max() < _PLACES
                place, position = place.astype(np.uint16)[row], np.minimum(position, _PLACES - 1).astype(np.uint16)
                dealt = list(_dealt(values, np.where(heavy == 1, -1, (values % np.uint64(buckets)).astype(np.int64))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in dealt], pa.int32()), pa.array([int(rid[at])] * len(dealt), pa.int64()), *(pa.array([f(x) for _, x in dealt], pa.binary()) for f in (lambda x: _six(values[x]), lambda x: place[x].tobytes(), lambda x: position[x].tobytes()))],
                    ["bucket", "base", "tokens", "places", "positions"],
                )
                at = end

    return sets.where("n > 0").select("rid", "k1", "tokens").mapInArrow(freeing(rows), "bucket int, base long, tokens binary, places binary, positions binary")


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, rids and positions of packed entries."""
    tokens = unpack_set(b"".join(x.as_buffer() for x in b.column(2))).astype(np.int64)
    places, positions = (np.frombuffer(b"".join(x.as_buffer() for x in b.column(k)), dtype=np.uint16).astype(np.int64) for k in (3, 4))
    base = np.repeat(b.column(1).to_numpy(), [len(x.as_buffer()) // 2 for x in b.column(3)])
    return tokens, base + places, positions


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def _marked_blocks(prefixes: DataFrame) -> DataFrame:
    """Members of the blocks of marked shingles: b1 (the shingle), b2 (-1), rid and position."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _entries(b)], ["token", "rid", "position"])

    found = prefixes.where("bucket < 0").mapInArrow(freeing(rows), "token long, rid long, position long")
    return found.select(F.col("token").alias("b1"), F.lit(-1).cast("long").alias("b2"), "rid", "position")


def _other_blocks(prefixes: DataFrame, buckets: int) -> DataFrame:
    """Members of distinct sets of documents that share unmarked shingles: b1, b2 (their hash), rid and first position."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_buckets(batches):
            token, rid, position = (np.concatenate(x) for x in zip(*map(_entries, held)))
            order = np.lexsort((rid, token))
            token, rid, position = token[order], rid[order], position[order]
            at = _runs(token)
            found: dict[bytes, np.ndarray] = {}
            for k in np.flatnonzero(np.diff(at) > 1):
                ids, first = rid[at[k] : at[k + 1]].tobytes(), position[at[k] : at[k + 1]]
                found[ids] = np.minimum(found[ids], first) if ids in found else first
            keys = [np.frombuffer(hashlib.blake2b(ids, digest_size=16).digest(), dtype=np.int64) for ids in found]
            sizes = [len(ids) // 8 for ids in found]
            key = np.repeat(np.array(keys, dtype=np.int64).reshape(-1, 2), sizes, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array(np.frombuffer(b"".join(found), dtype=np.int64)), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found.values()]))], ["b1", "b2", "rid", "position"])

    dealt = prefixes.where("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(freeing(blocks), "b1 long, b2 long, rid long, position long")


# --- 4. trees --------------------------------------------------------------------------------------------------


class Tree:
    """Levels of nodes from single documents up: bitmap, least and largest size, reach, and component or -1 of each."""

    def __init__(self, sig: np.ndarray, n: np.ndarray, reach: np.ndarray, component: np.ndarray):
        self.order = np.lexsort((reach, n))
        sig, n, reach, component = (x[self.order] for x in (sig, n, reach, component))
        self.levels = [(sig, n, n, reach, component)]
        while len(self.levels[-1][1]) > FANOUT:
            sig, low, high, reach, component = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            least, most = np.minimum.reduceat(component, at), np.maximum.reduceat(component, at)
            self.levels.append((np.bitwise_or.reduceat(sig, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(reach, at), np.where(least == most, least, -1)))


def _possible(a, i: np.ndarray, b, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether nodes i of level a and j of level b may hold a link between different components; exact for documents."""
    fits = (a[1][i] <= b[3][j]) & (b[1][j] <= a[3][i]) & ((a[4][i] != b[4][j]) | (a[4][i] < 0))
    at = np.flatnonzero(fits)
    some = max(1, (1 << 20) // max(1, a[0].shape[1]))
    for k in range(0, len(at), some):
        x, y = i[at[k : k + some]], j[at[k : k + some]]
        common = np.bitwise_count(a[0][x] & b[0][y]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common, np.minimum(a[2][x], b[2][y]))
        fits[at[k : k + some]] = (100 + percent) * most >= percent * (a[1][x] + b[1][y])
    return fits


def tree_pairs(a: Tree, b: Tree, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b of documents that link, by descending both trees at once."""
    top = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(a.levels[-1][1])), np.arange(len(b.levels[-1][1])), indexing="ij"))
    todo = [(*top, i, j)]
    while todo:
        x, y, i, j = todo.pop()
        if len(i) > 1 << 15:
            half = len(i) // 2
            todo += [(x, y, i[:half], j[:half]), (x, y, i[half:], j[half:])]
            continue
        ok = _possible(a.levels[x], i, b.levels[y], j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if x == y == 0:
            yield a.order[i], b.order[j]
        elif x >= y:
            kids = i[:, None] * FANOUT + np.arange(FANOUT)
            real = kids < len(a.levels[x - 1][1])
            todo.append((x - 1, y, kids[real], np.repeat(j, FANOUT)[real.reshape(-1)]))
        else:
            kids = j[:, None] * FANOUT + np.arange(FANOUT)
            real = kids < len(b.levels[y - 1][1])
            todo.append((x, y - 1, np.repeat(i, FANOUT)[real.reshape(-1)], kids[real]))


_PAIRS = "a long, b long"


def exact_bitmaps(tokens: pa.Array) -> np.ndarray:
    """Bitmaps of packed sets over the shingles that two of them at least hold: two of them have as many bits in common as shingles."""
    values, row = _values(tokens)
    _, place, held = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1
    some = held[place] > 1
    place, row = number[place[some]], row[some]
    out = np.zeros((len(tokens), (int(number[-1]) if len(number) else 0) // 64 + 1), dtype=np.uint64)
    np.bitwise_or.at(out, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return out


class _Union:
    """Components of a cell that links have joined."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def joins(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Places of links that join two components, one for each join."""
        out: list[int] = []
        at = np.arange(len(a))
        while len(at):
            up = self.parent
            while (up[up] != up).any():
                up = up[up]
            self.parent = up
            x, y = up[a[at]], up[b[at]]
            apart = x != y
            at, x, y = at[apart], x[apart], y[apart]
            for k, low, high in zip(at[:1024].tolist(), x[:1024].tolist(), y[:1024].tolist()):
                low, high = self._root(low), self._root(high)
                if low != high:
                    self.parent[max(low, high)] = min(low, high)
                    out.append(k)
            at = at[1024:]
        return out

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            x = int(self.parent[x])
        return x


def _cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """Links of all cells that join components there: rows b1, i, j, outside, rid, n, reach, component, tokens."""

    def links(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        outside, rid, n, reach, component = (t.column(k).to_numpy() for k in range(3, 8))
        o, m = np.flatnonzero(outside), np.flatnonzero(~outside)
        if not len(o) or not len(m):
            return
        bits = exact_bitmaps(t.column(8).chunk(0))
        _, component = np.unique(component, return_inverse=True)
        a, b = (Tree(bits[x], n[x], reach[x], component[x]) for x in (o, m))
        union = _Union(len(rid))
        for i, j in tree_pairs(a, b, percent):
            i, j = o[i], m[j]
            k = union.joins(component[i], component[j])
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rid[i[k]], rid[j[k]])), pa.array(np.maximum(rid[i[k]], rid[j[k]]))], ["a", "b"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        cell = lambda b, k: tuple(b.column(c)[k].as_py() for c in range(3))
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            at = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [b.num_rows]])
            for x, y in zip(at, at[1:]):
                if rest and cell(rest[0], 0) != cell(b, x):
                    yield from links(rest)
                    rest = []
                rest.append(b.slice(x, y - x))
        if rest:
            yield from links(rest)

    order = ["b1", "i", "j"]
    return cells.select(*order, "outside", "rid", "n", "reach", "component", "tokens").repartition(*order).sortWithinPartitions(*order).mapInArrow(freeing(pairs), _PAIRS)


# --- 6. pairs --------------------------------------------------------------------------------------------------


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures admit a link."""
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"s_{x}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_a, n_b = b.column(2).to_numpy(), b.column(4).to_numpy()
            s_a, s_b = ([v.as_buffer() for v in b.column(k)] for k in (3, 5))
            words = np.array([min(len(x), len(y)) // 8 for x, y in zip(s_a, s_b)], dtype=np.int64)
            ok = np.zeros(b.num_rows, dtype=bool)
            for w in np.unique(words):
                at, some = np.flatnonzero(words == w), max(1, (1 << 20) // int(w))
                for k in range(0, len(at), some):
                    part = at[k : k + some]
                    x, y = (np.stack([fold(s[i], int(w)) for i in part]) for s in (s_a, s_b))
                    # of a document's shingles at least as many as its bits outside the other's bitmap are missing there
                    slack = np.minimum(*(n[part] - np.bitwise_count(sig).sum(axis=1) for n, sig in ((n_a, x), (n_b, y))))
                    most = np.minimum(slack + np.bitwise_count(x & y).sum(axis=1), np.minimum(n_a[part], n_b[part]))
                    ok[part] = (100 + percent) * most >= percent * (n_a[part] + n_b[part])
            yield b.select([0, 1]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(freeing(check), _PAIRS)


def _only(sets: DataFrame, ids: DataFrame, column: str = "tokens") -> DataFrame:
    """rid, n and ``column`` of the sets in ``ids`` (rid) and a few others. A filter of fixed size goes before any shuffle."""
    words = slots(ids.select(F.xxhash64("rid").alias("slot")))
    return passing(sets.select("rid", "n", column, F.xxhash64("rid").alias("slot")), words).drop("slot")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that link, by their whole sets."""
    some = _only(sets, pairs.select(F.col("a").alias("rid")).union(pairs.select("b")))
    side = lambda x: some.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, dtype=bool)
            n_a, n_b = b.column(2).to_numpy(), b.column(4).to_numpy()
            for k in range(b.num_rows):
                common = len(np.intersect1d(unpack_set(b.column(3)[k].as_buffer()), unpack_set(b.column(5)[k].as_buffer()), assume_unique=True))
                ok[k] = linked(common, int(n_a[k]), int(n_b[k]), percent)
            yield b.select([0, 1]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "t_a", "n_b", "t_b").mapInArrow(freeing(compare), _PAIRS)


# --- components ------------------------------------------------------------------------------------------------


def connected(links: DataFrame) -> DataFrame:
    """rid and component (the smallest rid reachable) of every end of ``links`` (a, b)."""
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("rid")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("rid").alias("b"), "component"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("component").alias("near"))
        low = labels.join(near, "rid").select("rid", "component", F.least("component", "near").alias("to"))
        jump = labels.select(F.col("rid").alias("to"), F.col("component").alias("beyond"))
        new = stage(low.join(jump, "to", "left").select("rid", F.least("to", F.coalesce("beyond", "to")).alias("component"), (F.least("to", F.coalesce("beyond", "to")) < F.col("component")).alias("moved")), "labels")
        done = new.where("moved").isEmpty()
        unstage(labels)
        labels = new
        if done:
            unstage(edges)
            return labels.select("rid", "component")


# --- the join --------------------------------------------------------------------------------------------------


_BLOCK = ["b1", "b2"]


def _within_reach(x: str, y: str) -> Column:
    return (F.col(f"{x}.n") <= F.col(f"{y}.reach")) & (F.col(f"{y}.n") <= F.col(f"{x}.reach"))


def _leaf_pairs(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs within reach and of different components of blocks of at most LEAF members; those with the hub are known."""
    rest = rows.join(blocks.where(F.col("all") <= LEAF).select(*_BLOCK, "hub"), _BLOCK).where("rid <> hub").select(*_BLOCK, "rid", "n", "reach", "component")
    x, y = rest.alias("x"), rest.alias("y")
    on = (F.col("x.b1") == F.col("y.b1")) & (F.col("x.b2") == F.col("y.b2")) & (F.col("x.rid") < F.col("y.rid")) & (F.col("x.component") != F.col("y.component")) & _within_reach("x", "y")
    return x.join(y, on).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()


def _cells(rows: DataFrame, blocks: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Members of larger blocks, those of one main component together, dealt into cells: documents outside it against all."""
    large = stage(blocks.where(F.col("all") > LEAF).select(*_BLOCK, F.col("main").alias("island")), "large-blocks")
    if large.isEmpty():
        return None
    members = rows.join(large, _BLOCK).groupBy(F.col("island").alias("b1"), "rid", "component").agg(F.max("n").alias("n"), F.max("reach").alias("reach"))
    members = stage(members, "island-members")
    outside = F.col("component") != F.col("b1")
    room = lambda rows, shingles: F.ceil(F.greatest(rows / CELL, shingles / CELL_SHINGLES)).cast("int")
    sizes = members.groupBy("b1").agg(
        room(F.count("*"), F.sum("n")).alias("across"), room(F.count(F.when(outside, 1)), F.sum(F.when(outside, F.col("n")))).alias("down")
    )
    dealt = members.join(sizes.where("down > 0"), "b1")
    own, upto = F.xxhash64("rid"), lambda n: F.sequence(F.lit(0), n - 1)
    every = dealt.select("b1", F.pmod(own, F.col("across")).cast("int").alias("i"), F.explode(upto(F.col("down"))).alias("j"), F.lit(False).alias("outside"), "rid", "reach", "component")
    others = dealt.where(outside).select("b1", F.explode(upto(F.col("across"))).alias("i"), F.pmod(own, F.col("down")).cast("int").alias("j"), F.lit(True).alias("outside"), "rid", "reach", "component")
    return every.unionByName(others).join(_only(sets, members), "rid")


def components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash of every row."""
    sets = stage(_sets(docs, shingle).withColumn("rid", F.monotonically_increasing_id()), "shingle-sets")
    key = ["k1", "k2", "n"]
    who = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")
    classes = stage(sets.where("n > 0").groupBy(*key).agg(F.min(who).alias("first")).select(*key, F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("rid")), "set-classes")
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_SHINGLES)
    prefixes = stage(_prefixes(sets, _marks(sets, buckets), buckets, percent), "prefixes")
    found = stage(_marked_blocks(prefixes).unionByName(_other_blocks(prefixes, buckets)), "block-rows")
    unstage(prefixes)
    # from here on each class counts once, by the rid of its first document
    one = sets.select(F.col("rid").alias("of"), *key).join(classes.select(*key, "rid"), key).select("of", "rid", "n")
    members = found.withColumnRenamed("rid", "of").join(one, "of").groupBy(*_BLOCK, "rid").agg(F.max("n").alias("n"), F.min("position").alias("position"))
    # n + m <= (100 + percent) / percent * the shingles from the common one on
    members = stage(members.withColumn("reach", F.expr(f"(n - position) * {100 + percent} div {percent} - n")), "members")
    unstage(found)

    hub = F.min(F.struct("position", "rid", "n", "reach")).alias("h")
    hubs = stage(members.groupBy(*_BLOCK).agg(hub, F.count("*").alias("all")).where("all > 1"), "hubs")
    stars = members.alias("x").join(hubs.alias("y"), _BLOCK).where((F.col("rid") != F.col("h.rid")) & (F.col("n") <= F.col("h.reach")) & (F.col("h.n") <= F.col("reach")))
    tried = stage(stars.select(F.least("h.rid", "rid").alias("a"), F.greatest("h.rid", "rid").alias("b")).distinct(), "hub-pairs")
    links = stage(_verified(stage(_plausible(tried, sets, percent), "close-hub-pairs"), sets, percent), "hub-links")
    labels = connected(links)

    rows = members.join(hubs.where("all > 2").select(*_BLOCK), _BLOCK).join(labels, "rid", "left")
    rows = stage(rows.select(*_BLOCK, "rid", "n", "reach", F.coalesce("component", "rid").alias("component")), "block-members")
    by = rows.groupBy(*_BLOCK, "component").agg(F.count("*").alias("c")).groupBy(*_BLOCK).agg(F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("component", F.struct("c", "component")).alias("main"))
    blocks = stage(by.where("all > most").join(hubs.select(*_BLOCK, F.col("h.rid").alias("hub")), _BLOCK), "blocks")
    pairs = stage(_leaf_pairs(rows, blocks).join(tried, ["a", "b"], "left_anti"), "leaf-pairs")
    more = _verified(stage(_plausible(pairs, sets, percent), "close-leaf-pairs"), sets, percent)
    cells = _cells(rows, blocks, sets)
    more = stage(more if cells is None else more.unionByName(_cell_links(cells, percent)), "more-links")
    if not more.isEmpty():
        labels = connected(links.unionByName(more))

    labelled = classes.join(labels, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(smallest, "component").select(*key, "component_id")
    found = sets.select("doc_id", "text_hash", *key).join(named, key, "left")
    found = stage(found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash"), "components")
    unstage(sets, classes, members, hubs, tried, links, rows, blocks, pairs, more)
    return found


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the document of the smallest id of each component, columns unchanged; repeated rows count as one."""
    rows = components(docs, shingle, percent).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), (~F.col("doc_id").eqNullSafe(F.min("component_id"))).alias("drop"))
    return keep_marked(docs, rows.where("drop or n > 1").select("doc_id", "text_hash", "drop"))

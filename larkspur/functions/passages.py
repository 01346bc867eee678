"""Trigram sets of many pieces of text at once, compared with those of a stated list of items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Characters whose lower case depends on what stands around them or is several characters; rows of one product.
UNEVEN, ROWS = "Σİ", 512


def letters(spark: SparkSession) -> np.ndarray:
    """For each code point its lower case where that is a letter or number, else 0, as Spark's own expressions have it."""
    ids = spark.range(1, 0x110000, 1, 4).where((F.col("id") < 0xD800) | (F.col("id") > 0xDFFF))
    low = F.lower(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    got = ids.select("id", low.alias("c")).where(F.col("c").rlike(r"(?U)^[\p{L}\p{N}]$")).toArrow()
    table = np.zeros(int(max(got.column("id").to_numpy(), default=0)) + 2, dtype=np.int32)
    table[got.column("id").to_numpy()] = np.frombuffer("".join(got.column("c").to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    return table


class Passages:
    """``known``: distinct trigrams of all items; ``held``: trigram by item, 0 or 1; ``sizes``: the items' numbers of trigrams."""

    def __init__(self, table: np.ndarray, known: list[str], held: np.ndarray, sizes: np.ndarray, least: float):
        self.table, self.held, self.sizes, self.least = table, held.astype(np.uint8), sizes, least
        points = np.frombuffer("".join(known).encode("utf-32-le"), dtype=np.uint32).reshape(-1, 3)
        points = np.where(points == 32, 0, points).astype(np.int64)
        alphabet = np.unique(np.concatenate([[0], points.ravel()]))
        code = np.full(max(int(table.max(initial=0)), int(alphabet[-1])) + 1, -1, dtype=np.int32)
        code[alphabet] = np.arange(len(alphabet))
        #: letters of the items have small codes, which stay; -1 stands for others
        self.known, self.letters, self.codes = code[points].astype(np.int64), len(alphabet), code[table]
        self.bits = max(7, (2 * len(alphabet)).bit_length())
        self.place = None
        if self.bits == 7:
            self.place = np.full(1 << 21, -1, dtype=np.int32)
            self.place[self._keys(7)] = np.arange(len(known))
        self.local = np.zeros(len(known), dtype=np.int64)

    def _keys(self, bits: int) -> np.ndarray:
        return (self.known[:, 0] << 2 * bits) + (self.known[:, 1] << bits) + self.known[:, 2]

    def compare(self, owners: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, place of the item and the largest similarity of the owner's pieces, wherever it is ``least`` at least. Pieces of
        one owner stand together."""
        points = np.minimum(np.frombuffer(" ".join([*pieces, " "]).encode("utf-32-le"), dtype=np.uint32), len(self.table) - 1)
        x, bits = self.codes[points], self.bits
        if len(other := np.flatnonzero(x < 0)):
            more, x[other] = np.unique(self.table[points[other]], return_inverse=True)
            x[other] += self.letters
            bits = max(bits, (self.letters + len(more)).bit_length())
        wide = 3 * bits + len(pieces).bit_length()
        if wide > 62:  # so many different characters that a code has no place for all pieces
            half = len(pieces) // 2
            return tuple(map(np.concatenate, zip(self.compare(owners[:half], pieces[:half]), self.compare(owners[half:], pieces[half:]))))
        x = x.astype(np.int32 if wide <= 31 else np.int64)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + 1
        piece = np.repeat(np.arange(len(pieces), dtype=x.dtype) << 3 * bits, lengths)
        size = len(piece)
        one = np.zeros(size + 1, dtype=x.dtype)
        one[1:] = x[:size]
        inside = np.flatnonzero(x[:size])
        now, prior = x[inside], one[inside]
        two = np.where(prior > 0, one[np.maximum(inside - 1, 0)], 0)
        at = piece[inside]
        end = np.flatnonzero(x[inside + 1] == 0)
        keys = np.concatenate([at + (two << 2 * bits) + (prior << bits) + now, at[end] + (prior[end] << 2 * bits) + (now[end] << bits)])
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        row = keys >> 3 * bits
        n = np.bincount(row, minlength=len(pieces))
        keys &= (1 << 3 * bits) - 1
        if bits == 7 and self.place is not None:
            known = self.place[keys]
        else:
            sought = self._keys(bits)
            order = np.argsort(sought)
            known = order[np.minimum(np.searchsorted(sought[order], keys), len(order) - 1)]
            known = np.where(sought[known] == keys, known, -1)
        here = known >= 0
        row, known = row[here], known[here]
        cuts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])).tolist() + [len(pieces)]
        found = [self._products(a, min(a + ROWS, stop), row, known, n) for start, stop in zip(cuts, cuts[1:]) for a in range(start, stop, ROWS)]
        at, item, similarity = (np.concatenate(f) for f in zip(*found))
        return owners[at], item, similarity

    def _products(self, begin: int, end: int, row: np.ndarray, known: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = np.searchsorted(row, (begin, end))
        row, known = row[a:b] - begin, known[a:b]
        there = np.zeros(len(self.local), dtype=bool)
        there[known] = True
        vocabulary = np.flatnonzero(there)
        self.local[vocabulary] = np.arange(len(vocabulary))
        held = self.held[vocabulary]
        # what has a similarity of ``least`` shares that part of the item's trigrams at least
        items = np.flatnonzero(held.sum(axis=0, dtype=np.int64) >= self.least * self.sizes * (1 - 1e-9))
        has = np.zeros((end - begin, len(vocabulary)), dtype=np.float32)
        has[row, self.local[known]] = 1
        both = (has @ held[:, items].astype(np.float32)).astype(np.float64)
        similarity = (both / (n[begin:end, None] + self.sizes[items][None] - both)).max(axis=0)
        y = np.flatnonzero(similarity >= self.least)
        return np.full(len(y), begin), items[y], similarity[y]

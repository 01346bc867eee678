"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

A document is described by statistics of its whole text (``STATISTICS``); language, source and ids are no inputs.
Standardised statistics are mapped to ``features`` random Fourier features, whose inner products approximate a
Gaussian kernel (Rahimi and Recht, 2007). Each partition sums its part of the normal equations for every fold; the
sums, of a size that the number of features fixes, are added by row and solved on the driver. Weights that leave out
a row's own fold give its score for calibration: scores are counted in ``BINS`` bins over all labelled rows, and
pooling adjacent violators on these counts gives the monotone map to probabilities. All labelled rows are used.

Null and empty texts have statistics (zeros) and a score like any other; null labels are ignored, of several labels
of a document the largest counts; without usable labels every score is 0.5. Repeated rows each give a row, an empty table
none; equal scores share a calibration block. Texts of any length are read whole, with a few numbers a word held at
once; columns other than doc_id, text and quality, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import stage

FOLDS = 4
BINS = 2048
SYMBOLS = "#*$%&|<>"
#: Classes of bytes; the rest of ASCII counts as "other".
_GROUPS = (" \t\r\x0b\x0c", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",;:", "!?", SYMBOLS, "\"'`()[]{}")
_CLASS = np.full(256, len(_GROUPS), dtype=np.uint8)
for _k, _chars in enumerate(_GROUPS):
    _CLASS[list(_chars.encode())] = _k
_CLASS[0x80:] = len(_GROUPS) + 1
STATISTICS = (
    *(f"share_{n}" for n in ("space", "newline", "lower", "upper", "digit", "stop", "comma", "shout", "symbol", "bracket", "other", "non_ascii")),
    "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "distinct_pairs", "distinct_triples", "lines_per_word", "distinct_lines", "entropy", "capitalised", "ends_in_mark",
)


def statistics(text: str) -> np.ndarray:
    """The numbers that describe a text; zeros for an empty one."""
    out = np.zeros(len(STATISTICS), dtype=np.float32)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return out
    counts = np.bincount(raw, minlength=256)
    out[:12] = np.bincount(_CLASS, weights=counts, minlength=12) / len(raw)
    words = text.split()
    if not words:
        return out
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in text.split("\n") if x.strip()]
    share = counts[counts > 0] / len(raw)
    seen: dict[str, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    pairs, place = np.unique(codes[:-1] * len(seen) + codes[1:], return_inverse=True)
    triples = np.unique(place[:-1] * len(seen) + codes[2:])
    out[12:] = (
        math.log1p(n), math.log1p(float(lengths.mean())), float(lengths.std()) / float(lengths.mean()), len(seen) / n, int(np.bincount(codes).max()) / n,
        len(pairs) / max(1, n - 1), len(triples) / max(1, n - 2), len(lines) / n, len(set(lines)) / len(lines), float(-(share * np.log2(share)).sum()),
        sum(w[0].isupper() for w in words) / n, sum(not w[-1].isalnum() for w in words) / n,
    )
    return out


def _described(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([statistics(t.as_py() or "") for t in b.column(1)])
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), _lists(x)], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, x array<float>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


@dataclass(frozen=True)
class Basis:
    """Standardisation and random Fourier features."""

    mean: np.ndarray
    spread: np.ndarray
    w: np.ndarray
    b: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([math.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _moments(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each statistic over all documents, from one row for each statistic."""
    rows = described.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    mean, spread = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
    for r in rows:
        mean[r.k], spread[r.k] = r.m, max(r.s, 1e-6)
    return mean, spread


def _normal_equations(train: DataFrame, basis: Basis) -> dict[int, np.ndarray]:
    """For each fold the matrix [Z'Z | Z'y] of its rows, summed within partitions first."""
    d = len(basis.b) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, d, d + 1))
        for b in batches:
            x, y, fold = _matrix(b.column(0), len(STATISTICS)), b.column(1).to_numpy(), b.column(2).to_numpy()
            for a in range(0, len(x), 4096):
                z = basis(x[a : a + 4096])
                zy = np.hstack([z, y[a : a + 4096, None]])
                for f in range(FOLDS):
                    own = fold[a : a + 4096] == f
                    total[f] += z[own].T @ zy[own]
        for f in range(FOLDS):
            if total[f].any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, f, dtype=np.int32)), pa.array(np.arange(d, dtype=np.int32)), _lists(total[f])], ["fold", "i", "v"])

    def add(key, frame):
        return pd.DataFrame({"fold": [key[0]], "i": [key[1]], "v": [np.sum(np.stack(frame["v"].to_list()), axis=0)]})

    sums = train.select("x", "y", "fold").mapInArrow(part, "fold int, i int, v array<double>").groupBy("fold", "i").applyInPandas(add, "fold int, i int, v array<double>")
    out: dict[int, np.ndarray] = {f: np.zeros((d, d + 1)) for f in range(FOLDS)}
    for r in sums.collect():  # as many numbers as folds times features squared
        out[r.fold][r.i] = r.v
    return out


def _solve(m: np.ndarray, ridge: float) -> np.ndarray:
    a = m[:, :-1].copy()
    a[np.diag_indices(len(a) - 1)] += ridge * max(1.0, m[-1, -2])  # the last feature is the constant; its sum counts the rows
    return np.linalg.solve(a + 1e-9 * np.eye(len(a)), m[:, -1])


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of means ``y`` with weights ``n`` at ascending ``x``: the centre and level of each block."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, n):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([s / w for s, _, w in blocks]), np.array([t / w for _, t, w in blocks])


def _bin(scores: np.ndarray) -> np.ndarray:
    return np.clip(((scores + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def score_quality(docs: DataFrame, labels: DataFrame, features: int = 256, width: float = 2.0, ridge: float = 1e-4, threshold: float = 0.7, seed: int = 7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows with crc32(doc_id) mod 4 = 2 are not learnt from."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    described = stage(_described(docs), "statistics")
    mean, spread = _moments(described)
    rng = np.random.default_rng(seed)
    basis = Basis(mean, spread, rng.normal(0, 1 / (width * math.sqrt(len(STATISTICS))), (len(STATISTICS), features)), rng.uniform(0, 2 * math.pi, features))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    train = described.join(known, "doc_id").where(hashed % 4 != 2).select("x", "y", (F.floor(hashed / 4) % FOLDS).cast("int").alias("fold"))
    train = stage(train, "training-rows")
    sums = _normal_equations(train, basis)
    total = sum(sums.values())
    if total[-1, -2] == 0:
        centres, levels, weights = np.array([0.0]), np.array([0.5]), np.zeros(features + 1)
    else:
        weights = _solve(total, ridge)
        without = {f: _solve(total - sums[f], ridge) for f in range(FOLDS)}

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z, y, fold = basis(_matrix(b.column(0), len(STATISTICS))), b.column(1).to_numpy(), b.column(2).to_numpy()
                s = np.zeros(len(z))
                for f in range(FOLDS):
                    s[fold == f] = z[fold == f] @ without[f]
                yield pa.RecordBatch.from_arrays([pa.array(_bin(s)), pa.array(y)], ["bin", "y"])

        counts = sorted(train.mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.avg("y"), F.count("*")).collect())
        centres, levels = pool_adjacent(*(np.array([(r[0] + 0.5) / (BINS / 2) - 0.5 if k == 0 else float(r[k]) for r in counts]) for k in range(3)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), len(STATISTICS))
                s = np.concatenate([basis(x[a : a + 4096]) @ weights for a in range(0, len(x), 4096)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(np.clip(np.interp(s, centres, levels), 0, 1), 6))], ["doc_id", "score"])

    scored = described.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (F.coalesce(hashed % 4, F.lit(0)) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

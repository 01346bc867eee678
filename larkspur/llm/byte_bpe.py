"""Byte-level BPE through sentencepiece: the model file is serialised from a rank vocabulary, nothing is trained.

Each byte stands for one printable character, so a token's bytes become a piece; its score is its negative rank, its
id its rank. With identity normalisation sentencepiece then merges just as a byte-level BPE does, lowest rank first
and leftmost among equals. Texts are split by the vocabulary's pattern, each pre-token is encoded for itself, and ids
are decoded by the inverse mapping. Null texts are empty and have no ids; repeated rows each give a row; an empty
table gives none. Of equal merges the leftmost comes first; texts of any length are encoded whole; columns other than
doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm import pretokens
from larkspur.llm.common import batch

CACHED = 400_000
CACHED_CHARS = 48

_ROWS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes | str) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose ids are the ranks; the unknown piece, never reached, follows them."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks bytes {missing}")
    pieces = [_field(1, _field(1, "".join(pretokens.BYTE_CHARS[b] for b in t)) + _field(2, -float(k))) for k, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))  # BPE, size, id of <unk>
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Ids of texts as little-endian 32-bit arrays, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.split = pretokens.split if pattern == pretokens.PATTERN else regex.compile(pattern).findall
        self.table = {b: pretokens.BYTE_CHARS[b] for b in range(256)}
        back = {c: b for b, c in self.table.items()}
        self.tokens = [bytes(back[c] for c in self.model.id_to_piece(k)) for k in range(len(ranks))]
        self.cache: dict[str, bytes] = {}

    def _learn(self, pre_tokens: list[str]) -> dict[str, bytes]:
        raws = [p.encode() for p in pre_tokens]
        coded = self.model.encode([raw.decode("latin-1").translate(self.table) for raw in raws], num_threads=1)
        # a pre-token that is a token as a whole is that token, whatever the merges give
        return {p: struct.pack(f"<{len(ids)}I", *ids) if (whole := self.ranks.get(raw)) is None else struct.pack("<I", whole) for p, raw, ids in zip(pre_tokens, raws, coded)}

    def encode(self, text: str) -> bytes:
        parts = self.split(text)
        try:
            return b"".join(map(self.cache.__getitem__, parts))
        except KeyError:
            new = [p for p in set(parts) if p not in self.cache]
        learnt = self._learn(new)
        got = {p: learnt[p] if p in learnt else self.cache[p] for p in set(parts)}
        if len(self.cache) + len(new) > CACHED:
            self.cache.clear()
        self.cache.update((p, ids) for p, ids in learnt.items() if len(p) <= CACHED_CHARS)
        return b"".join(map(got.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0), b.column(1)):
                ids = c.encode(text.as_py() or "")
                out.append((doc_id.as_py(), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            if out:
                yield batch(_ROWS, *zip(*out))

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

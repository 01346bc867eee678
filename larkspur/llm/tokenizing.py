"""Encode texts with a tokenizers file inside Arrow batches; long texts in pieces that cannot change the ids."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from larkspur.llm.common import slices
from larkspur.llm.pretokens import BYTE_CHARS, bounds

END_ID = 0
_SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_LONG = 1 << 18
#: Pre-tokens that each of two generations holds.
CACHED = 200_000
CACHED_BYTES = 64
#: Characters of the texts that are taken apart together; a longer piece of a text goes alone.
TOGETHER = 1 << 21
_BYTE_POINTS = np.array([ord(c) for c in BYTE_CHARS], dtype="<u2")


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut_points(text: str) -> list[str]:
    """A long text cut before single spaces between letters, where the byte-level pattern always ends a pre-token."""
    if len(text) <= _LONG:
        return [text]
    parts, start = [], 0
    while len(text) - start > _LONG:
        found = _SAFE_CUT.search(text, start + _LONG)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.start()
    parts.append(text[start:])
    return parts


class _Known:
    """Ids of pre-tokens, side by side in one array. Where it has grown too large, those of the last generation are kept
    that are asked for again."""

    def __init__(self, model):
        from tokenizers import Tokenizer

        self.model = model.model
        self.merge = Tokenizer(self.model).encode_batch_fast  # the library's model alone: words come as they are to be merged
        vocab = model.get_vocab()
        self.sizes = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)
        for token, k in vocab.items():
            self.sizes[k] = len(token)
        self.older: tuple[dict[bytes, int], array, array] = {}, array("I"), array("q", [0])
        self._renew()

    def _renew(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where those of each end."""
        ids = np.array(self.merge([words], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.uint32)
        upto, ends = np.cumsum(self.sizes[ids]), np.cumsum([len(w) for w in words])
        last = np.searchsorted(upto, ends)
        if len(upto) and upto[-1] == ends[-1] and (upto[last] == ends).all():
            return ids, last + 1
        each = [[t.id for t in self.model.tokenize(w)] for w in words]  # a vocabulary without some byte
        return np.array([i for e in each for i in e], dtype=np.uint32), np.cumsum([len(e) for e in each])

    def find(self, joined: bytes, at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many, and start and end there of each of the distinct pre-tokens that ``at`` cuts ``joined`` into."""
        if len(self.ends) > CACHED or len(self.ids) > 8 * CACHED:
            self.older = self.slots, self.ids, self.ends
            self._renew()
        keys = [joined[a:b] for a, b in zip(at, at[1:])]
        found = list(map(self.slots.get, keys))
        missing = [k for k, slot in enumerate(found) if slot is None]
        if missing:
            # the bytes of a pre-token as the characters that stand for them
            chars = _BYTE_POINTS[np.frombuffer(joined, dtype=np.uint8)].tobytes().decode("utf-16-le")
            older, ids, ends = self.older
            slots, new, first = self.slots, [], len(self.ends) - 1
            for k in missing:
                old = older.get(keys[k])
                if old is None:
                    new.append(k)
                else:
                    self.ids.extend(ids[ends[old] : ends[old + 1]])
                    self.ends.append(len(self.ids))
                    found[k] = slots[keys[k]] = first
                    first += 1
            if new:
                ids, ends = self._merged([chars[at[k] : at[k + 1]] for k in new])
                self.ends.frombytes((ends + len(self.ids)).tobytes())
                self.ids.frombytes(ids.tobytes())
                for slot, k in enumerate(new, first):
                    found[k] = slot
                    if len(keys[k]) <= CACHED_BYTES:
                        slots[keys[k]] = slot
        at_slot, edges = np.array(found, dtype=np.int64), np.array(self.ends)
        return np.array(self.ids), edges[at_slot], edges[at_slot + 1]


class Encoder:
    """Ids by the tokenizers library: each distinct pre-token is encoded once, occurrences are looked up."""

    def __init__(self, path: str):
        self.model = tokenizer(path)
        # pre-tokens are taken apart only where that is known to be what the library does
        head = json.loads(self.model.to_str())
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.splits = not head["normalizer"] and not head["post_processor"] and {k: (head["pre_tokenizer"] or {}).get(k) for k in plain} == plain
        self.special = [t["content"] for t in head["added_tokens"]]
        self.known = _Known(self.model)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if self.splits and not any(s in text for s in self.special):
                plain.append(k)
            else:
                out[k] = np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if plain:
            for k, ids in zip(plain, self._together([texts[k] for k in plain])):
                out[k] = ids
        return out

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join([*texts, ""])  # each text with a character behind it that is none of its own
        breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
        at = bounds(joined, breaks)
        raw = joined.encode()
        own = np.searchsorted(at, breaks)  # the pieces that part the texts
        if len(raw) > len(joined):
            first = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
            at = np.append(first[at[:-1]], len(raw))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        _, cuts, distinct = pieces.dictionary.buffers()
        ids, start, end = self.known.find(distinct.to_pybytes(), np.frombuffer(cuts, dtype=np.int64)[: len(pieces.dictionary) + 1].tolist())
        which = pieces.indices.to_numpy()
        n = (end - start)[which]
        n[own] = 0
        upto = np.cumsum(n)
        every = ids[np.repeat(start[which] - upto + n, n) + np.arange(upto[-1])]
        return np.split(every, upto[own[:-1]])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> None:
    """Drop the tokenizers and known pre-tokens that this process holds."""
    encoder.cache_clear()
    tokenizer.cache_clear()


def encode_texts(path: str, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of each text (null: empty) as uint32, the end id appended, in order."""
    code = encoder(path).encode
    for lo, hi in slices(texts, TOGETHER):
        cut = [cut_points(text or "") for text in texts[lo:hi]]
        parts = [p for pieces in cut for p in pieces]
        ids = iter([x for a, b in slices(parts, TOGETHER) for x in code(parts[a:b])])
        for pieces in cut:
            yield np.concatenate([*(next(ids) for _ in pieces), [END_ID]], dtype="<u4", casting="unsafe")

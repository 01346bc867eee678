"""Pre-tokens of the common byte-level pattern by array operations: the same pieces as its regular expression gives.

A code point is white space, letter, number or other. Pieces begin where the class changes; a single space belongs to
the piece that follows it, the last of several white-space characters stands apart from those before it, and an
apostrophe that begins a piece takes one of the endings of ``ENDINGS`` with it.
"""

from __future__ import annotations

import functools

import numpy as np

#: The pattern, as the vocabularies' README gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A character for each byte: itself where it is printable and not a space, else one from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = "".join(chr(b) if b in _PLAIN else chr(0x100 + b - sum(p < b for p in _PLAIN)) for b in range(256))
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACE, _LETTER, _NUMBER, _OTHER, _BREAK = range(5)


@functools.cache
def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\s+", _SPACE), (r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0xD800:0xE000] = _OTHER
    return table


def bounds(text: str, breaks: np.ndarray | None = None) -> np.ndarray:
    """Where the pre-tokens of ``text`` begin, and its length. ``breaks``: places of single characters that part texts which
    know nothing of each other; each is a piece of its own."""
    if not text:
        return np.zeros(1, dtype=np.int64)
    points = np.frombuffer(text.encode("ascii"), dtype=np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kinds = _classes()[points]
    if breaks is not None:
        kinds[breaks] = _BREAK
    change = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    begins = np.zeros(len(points) + 1, dtype=bool)
    begins[0] = begins[-1] = True
    begins[change] = True
    after = change[(kinds[change - 1] == _SPACE) & (kinds[change] != _BREAK)]
    begins[after - 1] = True
    begins[after[points[after - 1] == 0x20]] = False
    if breaks is not None:
        begins[breaks] = begins[breaks + 1] = True
    if "'" in text:
        quotes = np.flatnonzero(begins[:-1] & (points == 0x27))
        for k in quotes[begins[quotes + 1]].tolist():  # the quote alone: what follows is no other mark
            ending = next((e for e in ENDINGS if text.startswith(e, k + 1)), None)
            if ending and not (k and points[k - 1] == 0x20 and not begins[k]):
                begins[k + 1] = False
                begins[k + 1 + len(ending)] = True
    return np.flatnonzero(begins)


def split(text: str) -> list[str]:
    """The pre-tokens of ``text``, in order."""
    at = bounds(text).tolist()
    return [text[a:b] for a, b in zip(at, at[1:])]

"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

Each value found is validated, read as a number within its format (the digits it may have in each place, valid dates,
IPv4 octets), permuted within that format, and written back with the same separators and length (dates with single
digits may change theirs). Check digits are computed anew, so that pseudonyms validate as the values did. The permutation depends on the key and the format
alone: equal values get equal pseudonyms in every document, different values different ones.

Kinds, in order of precedence: ``secret`` (an assignment of a long letter-and-digit string to a name such as token),
``email`` (the local part), ``iban`` (mod 97), ``card`` (13 to 19 digits, Luhn), ``ssn`` (validated areas), ``phone``
(+country code; without one, an area code in brackets or the ten digits of North America), ``ip`` (four octets),
``date`` (a calendar date of 1900-2099; day first where both orders are valid). Digits that do not validate are left.

E-mail addresses that differ in the case of ASCII letters, phones, cards and IBANs that differ in separators, and dates
written in different orders are equal values: their pseudonyms differ in that alone.

Null texts stay null and have no findings; empty texts stay empty; repeated rows each give a row; an empty table gives none.
Texts of any length are read whole; where matches of several kinds overlap, the first kind's wins. ``findings`` reads doc_id
and text alone; ``pseudonymise`` leaves other columns unchanged, whatever their names.
"""

from __future__ import annotations

import bisect
import datetime as dt
import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import freeing, small

ROUNDS = 8
#: The setting that holds the key of ``session_key``.
KEY_SETTING = "spark.larkspur.pseudonymKey"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_LATIN_LOWER = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_LATIN_UPPER = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_CLASS = {c: a for a in (_LOWER, _UPPER, _DIGITS, _LATIN_LOWER, _LATIN_UPPER) for c in a}
#: Country codes of two digits; +1 and +7 have one, all others three.
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_DAY0, _DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def permute(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on its bits, walked until it is in range."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    base = hashlib.blake2b(f"{tweak}|{size}|".encode(), key=hashlib.sha256(key).digest(), digest_size=max(8, width))
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            h = base.copy()
            h.update(bytes([r]) + right.to_bytes(width, "little"))
            left, right = right, left ^ (int.from_bytes(h.digest(), "little") & mask)
        x = left << half | right
        if x < size:
            return x


def permute_places(key: bytes, kind: str, text: str, fixed: int = 0, alphabet: str | None = None) -> str:
    """Letters and digits of ``text`` from place ``fixed`` on, permuted together, each within its alphabet."""
    alphabets = [alphabet or _CLASS.get(c) if k >= fixed else None for k, c in enumerate(text)]
    x, size = 0, 1
    for c, a in zip(text, alphabets):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    form = "".join(a[0] if a else c for c, a in zip(text, alphabets))
    x = permute(key, f"{kind}|{form}", x, size)
    out = list(text)
    for k in range(len(text) - 1, -1, -1):
        if a := alphabets[k]:
            x, d = divmod(x, len(a))
            out[k] = a[d]
    return "".join(out)


def luhn_digit(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def card(key: bytes, m: re.Match) -> str | None:
    digits = re.sub(r"[ -]", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = permute_places(key, "card", digits[:-1], 1)
    return _refill(m[0], f"{body}{luhn_digit(body)}")


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def iban(key: bytes, m: re.Match) -> str | None:
    value = m[0].replace(" ", "")
    if not 15 <= len(value) <= 34 or _mod97(value) != 1:
        return None
    body = permute_places(key, f"iban{value[:2]}", value[4:])
    check = 98 - _mod97(f"{value[:2]}00{body}")
    it = iter(f"{value[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in m[0])


def ssn(key: bytes, m: re.Match) -> str | None:
    area, group, serial = map(int, m[0].split("-"))
    valid = lambda a, g, s: a not in (0, 666) and a < 900 and g and s
    if not valid(area, group, serial):
        return None
    x = (area * 100 + group) * 10_000 + serial
    while True:
        x = permute(key, "ssn", x, 10**9)
        a, rest = divmod(x, 10**6)
        g, s = divmod(rest, 10_000)
        if valid(a, g, s):
            return f"{a:03d}-{g:02d}-{s:04d}"


def country_code(digits: str) -> str:
    """The country code that an international number begins with."""
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGIT_CODES else 3]


def phone(key: bytes, m: re.Match) -> str | None:
    form = m[0].replace("(0)", "(x)")  # a trunk prefix, not dialled after a country code
    digits = "".join(c for c in form if c.isdigit())
    if form[0] == "+":
        if not 8 <= len(digits) <= 15:
            return None
        code, body = country_code(digits), digits[len(country_code(digits)) :]
    elif len(digits) == 11 and digits[0] == "1":
        code, body = "1", digits[1:]
    elif 9 <= len(digits) <= 11:
        code, body = "1" if len(digits) == 10 else "", digits
    else:
        return None
    new = permute_places(key, f"phone{code}", body)
    return _refill(form, digits[: len(digits) - len(body)] + new).replace("(x)", "(0)")


def ip(key: bytes, m: re.Match) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if any(x > 255 for x in octets) or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    x = permute(key, "ip", int.from_bytes(bytes(octets), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _calendar(y: str, mo: str, d: str) -> dt.date | None:
    try:
        day = dt.date(int(y), int(mo), int(d))
    except ValueError:
        return None
    return day if 0 <= (day - _DAY0).days < _DAYS else None


def date(key: bytes, m: re.Match) -> str | None:
    first, second, s = (m["mo"], m["d"], m["s"]) if m["y"] else (m["p1"], m["p2"], m["s2"])
    month_first = bool(m["y"])
    day = _calendar(m["y"], first, second) if m["y"] else _calendar(m["y2"], second, first)
    if day is None and not m["y"]:
        day, month_first = _calendar(m["y2"], first, second), True
    if day is None:
        return None
    new = _DAY0 + dt.timedelta(days=permute(key, "date", (day - _DAY0).days, _DAYS))
    width = 1 if 1 in (len(first), len(second)) else 2
    a, b = (f"{x:0{width}d}" for x in ((new.month, new.day) if month_first else (new.day, new.month)))
    return f"{new.year:04d}{s}{a}{s}{b}" if m["y"] else f"{a}{s}{b}{s}{new.year:04d}"


def email(key: bytes, m: re.Match) -> str | None:
    lower = "".join(c.lower() if c.isascii() else c for c in m["local"])
    new = permute_places(key, "email", lower)
    return "".join(c.upper() if old in _UPPER else c for c, old in zip(new, m["local"])) + m["host"]


def secret(key: bytes, m: re.Match) -> str | None:
    hexadecimal = next((a for a in (_DIGITS + "abcdef", _DIGITS + "ABCDEF") if set(m["value"]) <= set(a)), None)
    return m["name"] + permute_places(key, "secret", m["value"], alphabet=hexadecimal)


_PHONE = (
    r"(?:(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}"
    r"|(?<![\w+.-])(?:1[ .-]?)?\((?:[0-9]{3}|0[0-9]{1,3})\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}"
    r"|(?<![\w+.-])(?:1[ .-])?(?:[0-9]{3}[ .-][0-9]{3}[.-][0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}))(?![\w-])"
)
_DATE = (
    r"(?<![\w./-])(?:(?P<y>(?:19|20)[0-9]{2})(?P<s>[-/.])(?P<mo>[0-9]{1,2})(?P=s)(?P<d>[0-9]{1,2})"
    r"|(?P<p1>[0-9]{1,2})(?P<s2>[-/.])(?P<p2>[0-9]{1,2})(?P=s2)(?P<y2>(?:19|20)[0-9]{2}))(?:(?=[Tt][0-9]{2})|(?![\w-]))(?![./][0-9])"
)
KINDS: tuple[tuple[str, str, Callable[[bytes, re.Match], str | None]], ...] = (
    ("secret", r"(?P<name>(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?)(?P<value>[A-Za-z0-9_+/-]{16,512})(?![A-Za-z0-9_+/-])", secret),
    ("email", r"(?P<local>(?<![\w.%+-])[\w.%+-]{1,64})(?P<host>@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![\w-])", email),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", iban),
    ("card", r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![\w-])(?!\.[0-9])", card),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", ssn),
    ("phone", _PHONE, phone),
    ("ip", r"(?<![\w.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-])(?!\.[0-9])", ip),
    ("date", _DATE, date),
)
_HINT = re.compile("[0-9@]|(?i:passw|secret|token|key)")


class Pseudonymiser:
    def __init__(self, key: bytes):
        self.kinds = [(name, re.compile(p), functools.partial(f, key)) for name, p, f in KINDS]
        self.memory: dict[tuple[str, str], str | None] = {}

    def _new(self, kind: str, f, m: re.Match) -> str | None:
        known = self.memory.get((kind, m[0]), m)
        if known is m:
            if len(self.memory) > 50_000:
                self.memory.clear()
            known = self.memory[kind, m[0]] = f(m)
        return known

    def apply(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind were set. Earlier kinds' spans are not touched again."""
        if not _HINT.search(text):
            return text, {}
        taken: list[tuple[int, int, str]] = []
        found: dict[str, int] = {}
        for kind, pattern, f in self.kinds:
            for m in pattern.finditer(text):
                at = bisect.bisect_left(taken, (m.start(),))
                free = (at == 0 or taken[at - 1][1] <= m.start()) and (at == len(taken) or taken[at][0] >= m.end())
                if free and (new := self._new(kind, f, m)) is not None:
                    taken.insert(at, (m.start(), m.end(), new))
                    found[kind] = found.get(kind, 0) + 1
        out, at = [], 0
        for a, b, new in taken:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), found


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's KEY_SETTING. Where none is set, one is drawn at random and kept in that setting, so that
    pseudonyms are linked within the session and nobody can undo them."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        key = os.urandom(32).hex()
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


def pseudonymise(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``column``; other columns and their order unchanged."""
    at, schema = docs.columns.index(column), docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymiser(key)
        for b in small(batches):
            texts = pa.array([None if t is None else p.apply(t)[0] for t in b.column(at).to_pylist()], type=b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    return docs.mapInArrow(freeing(rows), schema)


def findings(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_found, kinds (kind:count, comma-joined) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_found", pa.int64()), ("kinds", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymiser(key)
        for b in small(batches):
            done = [(None, {}) if t is None else p.apply(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([t for t, _ in done], pa.string()), pa.array([sum(f.values()) for _, f in done], pa.int64()), pa.array([",".join(f"{k}:{n}" for k, n in sorted(f.items())) for _, f in done], pa.string())], schema=schema
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, text string, n_found long, kinds string")

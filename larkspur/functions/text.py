"""Text expressions: trigrams, citations, language tests, table rows, headings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL = "[가-힣]"
CITATION = r"\[(\d{1,2})\]"


def strip(c: Column) -> Column:
    """Without white space at either end, the Unicode kinds included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each lower-cased alphanumeric word, padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(c), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def ordered_trigrams(text: str) -> list[str]:
    import re

    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return [f"  {w} "[k : k + 3] for w in words for k in range(len(w) + 1)]


def best_extent(query: str, text: str) -> float:
    """The largest similarity of the query's trigram set to any run of the text's trigrams.

    Only runs from one of the query's trigrams to another can be best; others cost size and win nothing.
    """
    wanted = set(ordered_trigrams(query))
    have = ordered_trigrams(text)
    hits = [k for k, t in enumerate(have) if t in wanted]
    best = 0.0
    for a, start in enumerate(hits):
        seen, common, at = set(), 0, start
        for end in hits[a:]:
            for t in have[at : end + 1]:
                if t not in seen:
                    seen.add(t)
                    common += t in wanted
            at = end + 1
            best = max(best, common / (len(wanted) + len(seen) - common))
            if len(seen) - common > len(wanted) / max(best, 1e-9):
                break  # longer runs cannot win any more
    return best


def word_similarity(query: Column, text: Column) -> Column:
    def scores(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([best_extent(a or "", b or "") for a, b in zip(q, t)], dtype="float64")

    return F.pandas_udf(scores, "double")(query, text)


def citations(answer: Column, n: Column) -> Column:
    """0-based numbers of the contexts that ``[n]`` marks cite, in order, once each, those out of range left out."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(CITATION), 1), lambda x: x.cast("int") - 1)
    return F.array_distinct(F.filter(found, lambda i: (i >= 0) & (i < n)))


def is_refusal(answer: Column, phrase: str) -> Column:
    return answer.contains(phrase) & ~answer.rlike(CITATION)


def hangul_ratio(c: Column) -> Column:
    """Hangul syllables among all letters; 0 for a text without letters."""
    return F.coalesce(F.regexp_count(c, F.lit(HANGUL)) / F.nullif(F.regexp_count(c, F.lit(r"\p{L}")), F.lit(0)), F.lit(0.0))


def simple_lower(c: Column) -> Column:
    """Lower case code point by code point, whatever stands around: no final sigma, no second character for a dotted I."""
    return F.lower(F.translate(c, "Σİ", "σi"))


def simple_upper(c: Column) -> Column:
    """Upper case code point by code point: one whose capital is several characters, as SS for ß, stays as it is."""
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.char_length(F.upper(x)) == F.char_length(x), F.upper(x)).otherwise(x)), "")


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of keywords that the answer has, case aside; NULL without keywords."""
    hit = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return hit / F.nullif(F.size(keywords), F.lit(0))


def row_line(header: Column, row: Column) -> Column:
    """A table row as ``h1: v1; h2: v2``; as ``v1 | v2`` without a header of its width. Empty cells are left out."""
    full = F.zip_with(header, row, lambda h, v: F.when(v == "", None).when(h == "", v).otherwise(F.concat(h, F.lit(": "), v)))
    fits = (F.size(header) == F.size(row)) & (F.size(header) > 0)
    return F.when(fits, F.array_join(F.array_compact(full), "; ")).otherwise(F.array_join(F.filter(row, lambda v: v != ""), " | "))


def merged_header(rows: Column) -> Column:
    """Header rows merged column by column, repeated words once."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.array_join(F.array_distinct(F.filter(F.transform(rows, lambda r: F.coalesce(F.get(r, i), F.lit(""))), lambda x: x != "")), " "))


#: Heading patterns in the order they are tried; the first that fits decides. Kind, pattern with the title
#: as its last group, level (0: one more than the number's depth), whether the title may end like a sentence.
HEADINGS = (
    ("division", r"^제\s*\d+\s*[편장]\.?\s*(\S.*)?$", 1, False),
    ("section", r"^제\s*\d+\s*절\.?\s*(\S.*)?$", 2, False),
    ("appendix", r"^(?:APPENDIX|Appendix|ANNEX|Annex|부록)\s*[A-Z0-9IVX]*\s*[:.\-–]?\s*(.*)$", 1, False),
    ("table", r"^Table\s+(?:\d{1,3}(?:[.\-]\d{1,3})*|[A-Z]\d{0,2}(?:[.\-]\d{1,3})*)[.:]?\s+(\S.*)$", 9, True),
    ("roman", r"^(?:(?:X{0,3}(?:IX|IV|V?I{1,3})|X{1,3}|V|IV|IX)|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ])\.\s+(\S.*)$", 1, False),
    ("letter", r"^[A-H]\.\s+([A-Z][^\s]*.*)$", 2, True),
    ("decimal", r"^\d{1,2}(?:\.\d{1,2}){0,4}\.?\s+(\S.*)$", 0, False),
    ("item", r"^[가나다라마바사아자차카타파하]\.\s+(\S.*)$", 6, False),
)
#: Dot leaders of contents lines, ends of sentences, months, openings of a title.
LEADER = r"(?:\.\s?){5,}|(?:·\s?){5,}|(?:…\s?){2,}|(?:‥\s?){3,}"
SENTENCE_END = r"(?:[.;,:]|다|음|함|임)\s*$"
MONTH = r"(?i)^(?:january|february|march|april|may|june|july|august|september|october|november|december)\b"
OPENING = r'^[\p{Lu}\p{Nd}가-힣(“"]'
TITLE_CHARS, TITLE_WORDS = 80, 12


def _evened(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def _plausible(title: Column, may_end: Column | bool) -> Column:
    """Whether a title is short, not mostly digits, no sentence and no date, and begins as titles do."""
    return (
        (F.char_length(title) <= TITLE_CHARS)
        & (F.size(F.split(title, " ")) <= TITLE_WORDS)
        & (F.regexp_count(title, F.lit(r"\p{Nd}")) <= F.regexp_count(title, F.lit(r"\p{L}")))
        & ((F.lit(may_end) if isinstance(may_end, bool) else may_end) | ~title.rlike(SENTENCE_END))
        & ~F.contains(F.concat(F.lit(" "), title, F.lit(" ")), F.lit(" should "))
        & ~title.rlike(MONTH)
        & title.rlike(OPENING)
    )


def heading_kind(line: Column, following: Column) -> Column:
    """Kind of heading a line is, or NULL. The first pattern that fits decides, and its title has to be plausible; contents
    lines and lines that the following one continues in lower case are none."""
    text = _evened(line)
    out = F.lit(None).cast("string")
    for kind, pattern, _, may_end in reversed(HEADINGS):
        title = strip(F.regexp_extract(text, pattern, 1))
        ok = _plausible(title, title.endswith(":") if kind == "appendix" else may_end)
        if kind in ("division", "section", "appendix"):
            ok = (title == "") | ok
        if kind == "appendix":
            ok &= text.rlike(r"^(?:Appendix|Annex|부록)|^\P{Ll}+(?:\s|$)")
        if kind == "table":
            ok &= ~title.rlike(r"^\p{Nd}")
        if kind == "letter":
            ok &= F.size(F.split(title, " ")) <= 10
        if kind == "decimal":  # a single number before Korean words is mostly a wrapped sentence
            ok &= ~(title.rlike("^[가-힣]") & text.rlike(r"^\d+\s"))
        if kind == "item":
            ok &= (F.char_length(title) <= 25) & ~F.contains(title, F.lit(","))
        out = F.when(text.rlike(pattern), F.when(ok, F.lit(kind))).otherwise(out)
    whole = (text != "") & (F.char_length(text) <= TITLE_CHARS + 12) & ~text.rlike(LEADER) & ~F.coalesce(strip(following).rlike("^[a-z]"), F.lit(False))
    return F.when(whole, out)


def heading_number(line: Column) -> Column:
    """The numbers that a decimal heading begins with."""
    return F.split(F.regexp_extract(_evened(line), r"^(\d{1,2}(?:\.\d{1,2}){0,4})", 1), r"\.").cast("array<int>")


def heading_level(line: Column, kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(level) if level else 1 + F.size(heading_number(line))) for k, _, level, _ in HEADINGS))


def page_text(c: Column) -> Column:
    """Extracted page text, evened out: composed characters, Korean middle dots, common spaces, no NUL."""
    def composed(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unicodedata.normalize("NFC", x) for x in texts], dtype="object")

    plain = F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(F.pandas_udf(composed, "string")(c))
    return F.translate(plain, "\u119e\u318d\u00a0\u0000", "\u00b7\u00b7 ")


def markdown_level(line: Column) -> Column:
    """Level of an ATX heading, or NULL."""
    marks = F.regexp_extract(line, r"^(#{1,6})\s+\S", 1)
    return F.when(marks != "", F.char_length(marks))

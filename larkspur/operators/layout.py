"""Layout of page and line rows: running lines, tables of contents, markdown sections, heading paths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as t

EDGE_LINES = 3


def lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """document_id, page, line_no, line."""
    return pages.select("document_id", "page", F.posexplode(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")).alias("line_no", "line"))


def without_running_lines(rows: DataFrame, share: float = 0.4, least: int = 3) -> DataFrame:
    """Lines without headers and footers that recur at page edges, and without bare page numbers.

    A line's key evens out white space, case and digits. A page's lines come from one row, so its window is bounded.
    """
    key = F.regexp_replace(F.lower(F.trim(F.regexp_replace("line", r"\s+", " "))), r"\d+", "#")
    page = Window.partitionBy("document_id", "page")
    kept = rows.withColumn("key", key).where("key <> ''")
    kept = kept.withColumn("up", F.row_number().over(page.orderBy("line_no"))).withColumn("down", F.row_number().over(page.orderBy(F.desc("line_no")))).withColumn("edge", (F.col("up") <= EDGE_LINES) | (F.col("down") <= EDGE_LINES))
    pages = rows.groupBy("document_id").agg(F.countDistinct("page").alias("pages"))
    seen = kept.where("edge").groupBy("document_id", "key").agg(F.countDistinct("page").alias("on"))
    running = seen.join(pages, "document_id").where(F.col("on") >= F.greatest(F.lit(least), F.floor(share * F.col("pages")))).select("document_id", "key", F.lit(True).alias("running"))
    marked = kept.join(running, ["document_id", "key"], "left")
    return marked.where(~(F.col("edge") & F.coalesce("running", F.lit(False))) & ~F.col("line").rlike(r"^\s*[-–]?\s*\d{1,4}\s*[-–]?\s*$")).select("document_id", "page", "line_no", "line")


def without_contents(rows: DataFrame, least: int = 3) -> DataFrame:
    """Lines without those of dot leaders, and without pages that have ``least`` of them or more."""
    marked = rows.withColumn("leader", F.col("line").rlike(t.LEADER))
    pages = marked.groupBy("document_id", "page").agg(F.count_if("leader").alias("leaders")).where(F.col("leaders") >= least)
    return marked.where("not leader").join(pages, ["document_id", "page"], "left_anti").select("document_id", "page", "line_no", "line")


def markdown_sections(rows: DataFrame) -> DataFrame:
    """document_id, section_no, section_title, text of markdown lines (document_id, line_no, line): a heading outside
    fences begins a section; text before the first has no title; sections without text are left out."""
    order = Window.partitionBy("document_id").orderBy("line_no")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    marked = rows.withColumn("inside", F.sum(fence.cast("int")).over(order) % 2 == 1).withColumn("level", F.when(~F.col("inside") & ~fence, t.markdown_level(F.col("line"))))
    marked = marked.withColumn("section_no", F.sum(F.col("level").isNotNull().cast("int")).over(order))
    title = F.max(F.when(F.col("level").isNotNull(), F.trim(F.regexp_replace("line", r"^#{1,6}\s+|\s+#+\s*$", ""))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    return marked.groupBy("document_id", "section_no").agg(title.alias("section_title"), t.strip(body).alias("text")).where("text <> ''")


def heading_paths(headings: DataFrame, levels: int = 6, show: int = 3) -> DataFrame:
    """Adds path: titles of the open headings down to each one, the last ``show`` joined. Columns: document_id,
    line_no, level, title. A deeper title closes when one of its level or above comes."""
    order = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = headings
    for k in range(1, levels + 1):
        df = df.withColumn(f"_t{k}", F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(order))
        df = df.withColumn(f"_c{k}", F.max(F.when(F.col("level") < k, F.col("line_no"))).over(order))
    open_ = lambda k: F.when((F.col("level") >= k) & (F.col(f"_t{k}.line_no") > F.coalesce(F.col(f"_c{k}"), F.lit(-1))), F.col(f"_t{k}.title"))
    every = F.array_compact(F.array(*(open_(k) for k in range(1, levels + 1))))
    path = F.array_join(F.slice(every, F.greatest(F.lit(1), F.size(every) - show + 1), F.lit(show)), " > ")
    return df.withColumn("path", path).select(*headings.columns, "path")


#: How far a part of a number may step, from how many decimal headings on chains are asked for, how soon
#: "1.1" or "2" has to follow the first chapter, and on what endings a heading's title goes on in the next line.
GAP, LEAST_CHAIN, CHAPTER_WITHIN = 3, 8, 6
OPEN_END = r"(?:-|an|the|of|for|and|to|in)$"


def _predecessors(number: tuple[int, ...]) -> Iterator[tuple[str, tuple[int, ...]]]:
    """What a heading of ``number`` may follow: a heading of exactly some number, or of one that begins so. The first part that
    differs steps by 1 to GAP, and the parts behind it are GAP at most."""
    for k in range(len(number) - 1, -1, -1):
        if 1 <= number[k] <= GAP and k:
            yield "exact", number[:k]
        for step in range(1, min(GAP, number[k]) + 1):
            yield "begins", (*number[:k], number[k] - step)
        if number[k] > GAP:
            return


def consistent(numbers: list[tuple[int, ...]]) -> list[bool]:
    """Which headings are on the longest chain of steps. Best chains so far are looked up by number and by its beginnings, so
    headings are gone through once; of equal chains the one that ends first counts, and the earliest predecessors."""
    n = len(numbers)
    best, back = [0] * n, [-1] * n
    ends: dict[tuple[str, tuple[int, ...]], int] = {}
    for j, number in enumerate(numbers):
        best[j] = int(all(x <= GAP for x in number))
        for key in _predecessors(number):
            i = ends.get(key, -1)
            if i >= 0 and (best[i] + 1 > best[j] or (best[i] + 1 == best[j] and 0 <= i < back[j])):
                best[j], back[j] = best[i] + 1, i
        if best[j]:
            for key in (("exact", number), *(("begins", number[:k]) for k in range(1, len(number) + 1))):
                if key not in ends or best[j] > best[ends[key]]:
                    ends[key] = j
    keep = [False] * n
    at = max(range(n), key=lambda k: (best[k], -k), default=-1)
    while at >= 0 and best[at]:
        keep[at] = True
        at = back[at]
    return keep


def kept_headings(headings: list[dict]) -> list[bool]:
    """Which headings (kind, level, number, text) of a document are real. Decimal ones have to be on the longest chain of their
    segment; a segment ends at a heading of another kind and level 1 or 2. Appendices before the first chapter of a
    document are references. Documents with few decimal headings, and those with Korean ones, are left as they are."""
    decimal = [k for k, h in enumerate(headings) if h["kind"] == "decimal"]
    if len(decimal) < LEAST_CHAIN or any(re.search(t.HANGUL, h["text"]) for h in headings):
        return [True] * len(headings)
    number = {k: tuple(headings[k]["number"]) for k in decimal}
    follow = lambda at: {number[k] for k in decimal[at + 1 : at + 1 + CHAPTER_WITHIN]}
    chapter = next((k for at, k in enumerate(decimal) if number[k] == (1,) and {(1, 1), (2,)} & follow(at)), 0)
    keep = [not (k < chapter and h["kind"] == "appendix") for k, h in enumerate(headings)]
    ends = [k for k, h in enumerate(headings) if keep[k] and h["kind"] not in ("decimal", "table") and h["level"] <= 2]
    for low, high in zip([-1, *ends], [*ends, len(headings)]):
        segment = [k for k in decimal if low < k < high]
        for k, right in zip(segment, consistent([number[k] for k in segment])):
            keep[k] = right
    return keep


def consistent_headings(headings: DataFrame) -> DataFrame:
    """Adds consistent to rows of document_id, line_no, kind, level, number, text, document by document."""
    import pandas as pd

    def mark(frame):
        frame = frame.sort_values("line_no")
        return pd.DataFrame({"document_id": frame["document_id"], "line_no": frame["line_no"], "consistent": kept_headings(frame.to_dict("records"))})

    id_, line = (headings.schema[c].dataType.simpleString() for c in ("document_id", "line_no"))
    marked = headings.select("document_id", "line_no", "kind", "level", "number", "text").groupBy("document_id").applyInPandas(mark, f"document_id {id_}, line_no {line}, consistent boolean")
    return headings.join(marked, ["document_id", "line_no"])


def page_sections(pages: DataFrame) -> DataFrame:
    """Sections of page rows (document_id, page, text): document_id, error_type, sections as ``chunk_sections`` takes them.

    Running lines and contents pages go; a heading begins a section, a wrapped one takes its next line with it; a section
    is titled by the path of open headings and keeps the offset at which each page begins. A document without any
    text on its pages is NO_EXTRACTABLE_TEXT. Each document's lines are handled in one task, as its sections are one row.
    """
    even = pages.withColumn("text", t.page_text(F.coalesce("text", F.lit(""))))
    rows = without_contents(without_running_lines(lines(even)))
    own = Window.partitionBy("document_id").orderBy("page", "line_no")
    rows = rows.withColumn("next", F.lead("line").over(own))
    rows = rows.withColumn("kind", t.heading_kind(F.col("line"), F.col("next"))).withColumn("level", t.heading_level(F.col("line"), F.col("kind")))
    rows = rows.withColumn("number", F.when(F.col("kind") == "decimal", t.heading_number(F.col("line")))).withColumn("evened", t.strip(F.regexp_replace("line", r"(?U)\s+", " ")))
    one = F.array_sort(F.collect_list(F.struct("page", "line_no", "line", "evened", "kind", "level", "number")))
    grouped = rows.groupBy("document_id").agg(one.alias("lines"))
    section = "array<struct<text:string,page_number:int,section_title:string,page_spans:array<struct<offset:int,page:int>>>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_sections(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, _SECTIONS)], ["document_id", "sections"])

    made = grouped.mapInArrow(cut, f"document_id {pages.schema['document_id'].dataType.simpleString()}, sections {section}")
    any_text = even.groupBy("document_id").agg(F.bool_or(t.strip(F.col("text")) != "").alias("readable"))
    return any_text.join(made, "document_id", "left").select("document_id", F.when(~F.col("readable"), "NO_EXTRACTABLE_TEXT").alias("error_type"), F.when(F.col("readable"), F.coalesce("sections", F.from_json(F.lit("[]"), section))).alias("sections"))


_SECTIONS = pa.list_(pa.struct([("text", pa.string()), ("page_number", pa.int32()), ("section_title", pa.string()), ("page_spans", pa.list_(pa.struct([("offset", pa.int32()), ("page", pa.int32())])))]))


def _continues(line: dict, following: dict | None) -> bool:
    """Whether a heading's title goes on in the following line: a short one that is no heading, where both are in capitals,
    the title ends openly, or the following line makes it a question."""
    nxt = following["evened"] if following and not following["kind"] else ""
    if not nxt or len(nxt) > 60:
        return False
    letters = lambda x: [c for c in x if c.isalpha()]
    capitals = all(letters(x) and all(c.isupper() for c in letters(x)) for x in (line["evened"], nxt))
    return capitals or bool(re.search(OPEN_END, line["evened"])) or (nxt.endswith("?") and not line["evened"].endswith("?"))


def _sections(lines_: list[dict]) -> list[dict]:
    found: list[tuple[int, bool, dict]] = []
    skip = -1
    for k, x in enumerate(lines_):
        if x["kind"] and k != skip:
            wraps = _continues(x, lines_[k + 1] if k + 1 < len(lines_) else None)
            skip = k + 1 if wraps else skip
            found.append((k, wraps, x | {"text": f"{x['evened']} {lines_[k + 1]['evened']}" if wraps else x["evened"]}))
    heads = {k: (wraps, h) for (k, wraps, h), right in zip(found, kept_headings([h for _, _, h in found])) if right}
    out: list[dict] = []
    path: list[dict] = []
    body: list[dict] = []

    def flush() -> None:
        whole = "\n".join(x["line"].rstrip() for x in body)
        text, lead = whole.strip(), len(whole) - len(whole.lstrip())
        if text:
            at, spans = 0, []
            for x in body:
                if not spans or spans[-1]["page"] != x["page"]:
                    spans.append({"offset": max(0, at - lead), "page": x["page"]})
                at += len(x["line"].rstrip()) + 1
            out.append({"text": text, "page_number": spans[0]["page"], "section_title": " > ".join(h["text"] for h in path[-3:]) or None, "page_spans": spans})
        body.clear()

    skip = -1
    for k, x in enumerate(lines_):
        if k == skip:
            continue
        if k not in heads:
            body.append(x)
            continue
        flush()
        wraps, head = heads[k]
        skip = k + 1 if wraps else skip
        while path and (path[-1]["level"] >= head["level"] or _other_branch(path[-1]["number"], head["number"])):
            path.pop()
        path.append(head)
    flush()
    return out


def _other_branch(above: list[int] | None, number: list[int] | None) -> bool:
    """Whether two numbers say that the one isn't below the other."""
    return bool(above and number) and list(number[: len(above)]) != list(above)

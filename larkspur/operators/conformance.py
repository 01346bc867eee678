"""Header conformance: tag rows held against rule tables.

Tags come in long form, one row for each element: ``file, path, parent, depth, tag, keyword, vr, state, vals`` with
state absent from the table, ``empty`` or ``exists``. Rule tables are small, of a published standard's size, and are
broadcast. Findings: ``file, code, severity, source, attribute, tag, action, path, n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("1", "1C", "2", "2C", "3")  # strictest first
FINDING = ("file", "code", "severity", "source", "attribute", "tag", "action", "path", "n")


def finding(df: DataFrame, code: Column | str, severity: Column | str, source: str, *, action: Column | None = None, n: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    column = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select("file", lit(code).alias("code"), lit(severity).alias("severity"), F.lit(source).alias("source"), column("keyword").alias("attribute"), column("tag").alias("tag"), (action if action is not None else F.lit(None).cast("string")).alias("action"), column("path").alias("path"), (n if n is not None else F.lit(1)).cast("long").alias("n"))


def object_kind(files: DataFrame, by_class: DataFrame, by_modality: DataFrame) -> DataFrame:
    """Adds iod and iod_from: by SOP class, else by modality, else unknown. One row for each file."""
    a = F.broadcast(by_class.select("sop_class", F.col("iod").alias("_c")))
    b = F.broadcast(by_modality.groupBy("modality").agg(F.min("iod").alias("_m")))
    joined = files.join(a, "sop_class", "left").join(b, "modality", "left")
    return joined.withColumn("iod", F.coalesce("_c", "_m")).withColumn("iod_from", F.when(F.col("_c").isNotNull(), "class").when(F.col("_m").isNotNull(), "modality").otherwise("unknown")).drop("_c", "_m")


def strictest(rules: DataFrame) -> DataFrame:
    """For each iod and tag the strictest type over mandatory modules; of equals, the first module's rule."""
    rank = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    best = rules.where("usage = 'M'").groupBy("iod", "tag").agg(F.min_by(F.struct("type", "module", "keyword"), F.struct(rank, "ord")).alias("r"))
    return best.select("iod", "tag", "r.type", "r.module", "r.keyword")


def type_findings(files: DataFrame, tags: DataFrame, rules: DataFrame) -> DataFrame:
    """Required attributes that are absent or empty. Absent conditional ones give one line for each file."""
    need = files.select("file", "iod").join(F.broadcast(strictest(rules)), "iod")
    top = tags.where("depth = 0").select("file", "tag", "state")
    held = need.join(top, ["file", "tag"], "left").withColumn("state", F.coalesce("state", F.lit("absent")))
    hard = held.where("(type = '1' and state <> 'exists') or (type = '2' and state = 'absent')")
    found = finding(hard, F.concat(F.lit("L1-TYPE"), F.col("type"), F.lit("-"), F.upper("state")), "error", "conformance")
    soft = held.where("type in ('1C', '2C') and state = 'absent'").groupBy("file").agg(F.count("*").alias("c"))
    return found.unionByName(finding(soft, "L1-CONDITIONAL", "info", "conformance", n=F.col("c")))


def ui_problem(x: Column) -> Column:
    return F.when(F.char_length(x) > 64, "length").when(~x.rlike(r"^[0-9.]*$"), "characters").when(x.rlike(r"(^|\.)(\.|$)"), "empty component").when(x.rlike(r"(^|\.)0[0-9]"), "leading zero")


def da_problem(x: Column) -> Column:
    return F.when(~x.rlike(r"^[0-9]{8}$"), "format").when(F.try_to_date(x, "yyyyMMdd").isNull(), "calendar")


def tm_problem(x: Column) -> Column:
    return F.when(~x.rlike(r"^([01][0-9]|2[0-3])([0-5][0-9]([0-5][0-9]|60)?)?$|^([01][0-9]|2[0-3])[0-5][0-9]([0-5][0-9]|60)\.[0-9]{1,6}$"), "format")


def cs_problem(x: Column) -> Column:
    return F.when(F.char_length(F.trim(x)) > 16, "length").when(~x.rlike(r"^[A-Z0-9 _]*$"), "characters")


def format_findings(tags: DataFrame) -> DataFrame:
    """Values of the wrong form, a row for each element with its distinct problems, sorted, in ``action``."""
    x = F.col("x")
    one = lambda p: F.when(x != "", p)
    by_vr = F.when(F.col("vr") == "UI", one(ui_problem(x))).when(F.col("vr") == "DA", one(da_problem(x))).when(F.col("vr") == "TM", one(tm_problem(x))).when(F.col("vr") == "CS", one(cs_problem(x)))
    rows = tags.where("vr in ('UI', 'DA', 'TM', 'CS') and state = 'exists'").withColumn("x", F.explode("vals")).withColumn("problem", by_vr).where("problem is not null")
    rows = rows.groupBy("file", "path", "tag", "keyword", "vr").agg(F.array_join(F.array_sort(F.collect_set("problem")), ",").alias("p"))
    return finding(rows, F.concat(F.lit("L1-FORMAT-"), F.col("vr")), "error", "conformance", action=F.col("p"))


def term_findings(values: DataFrame, terms: DataFrame) -> DataFrame:
    """Values of a defined-term attribute that are retired or unknown. values: file, keyword, value; terms: keyword,
    value, retired."""
    known = values.join(F.broadcast(terms.select("keyword", "value", "retired")), ["keyword", "value"], "left")
    bad = known.where("retired is null or retired")
    return finding(bad, F.when(F.col("retired").isNull(), "L1-TERM-UNKNOWN").otherwise("L1-TERM-RETIRED"), "warning", "conformance")


def group_findings(groups: DataFrame, frames: DataFrame, macros: DataFrame) -> DataFrame:
    """Functional groups: required macros in the shared item or in every frame. groups: file, macro, place (shared or
    frame), frame; frames: file, iod, n_frames; macros: iod, macro, usage, shared_allowed."""
    have = groups.groupBy("file", "macro").agg(F.max(F.col("place") == "shared").alias("shared"), F.countDistinct(F.when(F.col("place") == "frame", F.col("frame"))).alias("in_frames"))
    need = frames.join(F.broadcast(macros), "iod").join(have, ["file", "macro"], "left").withColumn("shared", F.coalesce("shared", F.lit(False))).withColumn("in_frames", F.coalesce("in_frames", F.lit(0))).withColumn("keyword", F.col("macro"))
    missing = need.where("usage = 'M' and not shared and in_frames < n_frames")
    found = finding(missing, F.when(F.col("in_frames") == 0, "L1-FG-MISSING").otherwise("L1-FG-INCOMPLETE"), "error", "conformance", n=F.col("n_frames") - F.col("in_frames"))
    return found.unionByName(finding(need.where("shared and not shared_allowed"), "L1-FG-SHARED", "error", "conformance"))


def macro_findings(items: DataFrame, inner: DataFrame) -> DataFrame:
    """Attributes inside macro items. items: file, path, macro, tags (those present); inner: macro, tag, keyword, type."""
    need = items.join(F.broadcast(inner), "macro").where(F.col("type").isin("1", "2") & ~F.array_contains("tags", F.col("tag")))
    return finding(need, F.concat(F.lit("L1-FG-TYPE"), F.col("type"), F.lit("-ABSENT")), "error", "conformance")


def quantitation_findings(files: DataFrame, tags: DataFrame, required: DataFrame) -> DataFrame:
    """Attributes that quantitative PET needs: absent ones, and values other than the one asked for, as warnings.
    required: iod, tag, keyword, expected (NULL: any)."""
    need = files.select("file", "iod").join(F.broadcast(required), "iod").join(tags.select("file", "tag", "state", "vals"), ["file", "tag"], "left")
    absent = F.col("state").isNull() | (F.col("state") != "exists")
    other = F.col("expected").isNotNull() & (F.get("vals", F.lit(0)) != F.col("expected"))
    return finding(need.where(absent | other), F.when(absent, "L1-QUANT-MISSING").otherwise("L1-QUANT-VALUE"), "warning", "conformance")

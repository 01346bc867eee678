"""Findings: merging, order, histograms, values that may leave, summaries and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEVERITIES = ("error", "warning", "info")
PATHS = 5


def merge(findings: DataFrame) -> DataFrame:
    """Equal findings of a file as one: counts added, up to five distinct paths (the smallest).

    Paths are ranked by a window, so a group's paths are never gathered beyond the five that stay.
    """
    key = ["file", "code", "severity", "source", "attribute", "tag", "action"]
    paths = findings.where("path is not null").groupBy(*key, "path").agg(F.lit(1).alias("one"))
    kept = paths.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("path"))).where(F.col("r") <= PATHS).groupBy(*key).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    sums = findings.groupBy(*key).agg(F.sum("n").alias("n"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in key]
    on = same[0]
    for c in same[1:]:
        on &= c
    return sums.alias("s").join(kept.alias("p"), on, "left").select("s.*", F.coalesce("p.paths", F.array().cast("array<string>")).alias("paths"))


def severity_rank(c: str = "severity") -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(c))


def ordered(findings: DataFrame) -> DataFrame:
    """By file, severity and code."""
    return findings.orderBy("file", severity_rank(), "code", "tag")


def severity_counts(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Findings of each severity, zeros filled in."""
    return findings.groupBy(*(by or [])).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def safe_value(state: Column, allowed: Column, well_formed: Column, value: Column) -> Column:
    """The value only where it is listed and well formed, else a marker of presence."""
    return F.when(F.coalesce(allowed, F.lit(False)) & F.coalesce(well_formed, F.lit(False)), value).when(state == "exists", "[present]").when(state == "empty", "[empty]").otherwise("[absent]")


def safe_summary(tags: DataFrame, allowlist: DataFrame) -> DataFrame:
    """file, keyword, shown: top-level attributes, values of the allowlist (keyword, pattern) if they match it."""
    joined = tags.where("depth = 0").join(F.broadcast(allowlist), "keyword", "left")
    value = F.get("vals", F.lit(0))
    return joined.select("file", "keyword", safe_value(F.col("state"), F.col("pattern").isNotNull(), F.expr("element_at(vals, 1) rlike concat('^(?:', pattern, ')$')"), value).alias("shown"))


def from_groups(shared: Column, first_frame: Column) -> Column:
    """A spatial attribute from the shared group, else from the first frame."""
    return F.coalesce(shared, first_frame)


def derived_lists(findings: DataFrame) -> DataFrame:
    """For each file: attributes missing, attributes with privacy findings, and whether no error was found."""
    of = lambda c: F.array_sort(F.collect_set(F.when(c, F.coalesce("attribute", "tag"))))
    return findings.groupBy("file").agg(of(F.col("code").startswith("L1-TYPE")).alias("missing"), of((F.col("source") == "deid") & (F.col("severity") != "info")).alias("privacy"), (F.count_if(F.col("severity") == "error") == 0).alias("passed"))


def payload(findings: DataFrame) -> DataFrame:
    """What a model may see: codes, keywords and counts, no values and no paths."""
    return findings.groupBy("file", "code", "attribute").agg(F.sum("n").alias("n"))


def template_summary(counts: DataFrame) -> DataFrame:
    """A sentence for each file from its severity counts."""
    text = F.concat_ws("; ", *(F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"), F.when(F.col(s) > 1, "s").otherwise(""))) for s in SEVERITIES))
    return counts.select("file", F.when(text == "", "No findings.").otherwise(F.concat(text, F.lit("."))).alias("summary"))


#: Fixed value: what every report ends with.
DISCLAIMER = "Automated check of header elements; it replaces no review."


def report_summary(findings: DataFrame, top: int = 3) -> DataFrame:
    """For each file its sentence, the ``top`` gravest findings as ``code (attribute)``, and the disclaimer."""
    order = Window.partitionBy("file").orderBy(severity_rank(), "code", "attribute")
    gravest = findings.select("file", "severity", "code", "attribute").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    name = F.concat("code", F.coalesce(F.concat(F.lit(" ("), "attribute", F.lit(")")), F.lit("")))
    first = gravest.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", name.alias("x")))), lambda s: s["x"]), "; ").alias("top"))
    counts = template_summary(severity_counts(findings, ["file"]))
    return counts.join(first, "file").select("file", F.concat_ws(" ", "summary", F.concat(F.lit("First: "), "top", F.lit(".")), F.lit(DISCLAIMER)).alias("summary"))


def folder_totals(files: DataFrame, findings: DataFrame, fail_on: str | None = None) -> DataFrame:
    """One row for a folder: files, files of each object kind, findings of each severity, and whether it fails: whether any
    finding is as grave as ``fail_on``."""
    kinds = files.groupBy(F.coalesce("iod", F.lit("unknown")).alias("iod")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("iod", "count")))).alias("iods"), F.sum("count").alias("files"))
    grave = F.count_if(severity_rank() <= SEVERITIES.index(fail_on) + 1) > 0 if fail_on else F.lit(False)
    return kinds.join(findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), grave.alias("fails")))


def rollup(findings: DataFrame, top: int = 15) -> DataFrame:
    """The most frequent codes of a folder: code, files, total; ``top`` of them, as a report shows."""
    return findings.groupBy("code").agg(F.countDistinct("file").alias("files"), F.sum("n").alias("total")).orderBy(F.desc("total"), "code").limit(top)

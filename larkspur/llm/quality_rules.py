"""Quality rules with adaptive thresholds, as DataFrame expressions alone.

Each document's rates (``METRICS``, integers in thousandths) go into quantile sketches for every language and source:
histograms whose buckets keep the leading ``PRECISION`` bits of a value, hence a relative error below 2 %. Sketches
merge by adding counts, so those of small groups (under ``SMALL`` rows) give way to the merged sketch of the language,
then of the corpus. A rate is an outlier beyond its group's quartile by ``REACH`` times the distance of the quartiles,
which counts as ``slack`` at least where a group is uniform. Documents are joined to their group's fences.

``judge`` takes the low fence by differences, as op4's SQL does; with ``word_chars``' slack it lies near or below the
least rate that words can have. ``keep_good`` takes it by ratios instead (``LOW_RATIO``), so that it stays above that.

Null texts have no words and fail; null and empty languages or sources form one group; repeated rows each count and
each give a row; ties of a rate share a bucket; an empty table gives no rows. Texts of any length are read whole. Columns other
than doc_id, text, lang and source, whatever their names, are left out by ``judge`` and unchanged by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import few_files, fresh, stage

MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
PRECISION = 7
SMALL = 200
REACH = 3
GROUPS_BROADCAST = 20_000
#: Least ratio of the third quartile to the first, in thousandths, for low fences by ratios.
LOW_RATIO = 1333
#: Metric, numerator, denominator, least distance of the quartiles (thousandths), whether low values are outliers too.
METRICS = (
    ("symbols", "n_symbols", "n_words", 100, False),
    ("dup_lines", "n_dup_lines", "n_lines", 150, False),
    ("repeats", "n_repeat_words", "n_words", 50, False),
    ("capitals", "n_capitals", "word_chars", 100, False),
    ("marks", "n_marks", "n_words", 200, False),
    ("word_chars", "word_chars", "n_words", 1500, True),
)
_SPACES = r"[\x20\x09-\x0D]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def with_counts(docs: DataFrame, out: str = "counts") -> DataFrame:
    """``docs`` with a struct column ``out`` of COUNTS; every column in between is dropped again."""
    text, words, hashes, windows, ranked = fresh(docs.withColumn(out, F.lit(None)), "q_text", "q_words", "q_hashes", "q_windows", "q_ranked")
    n = F.size(words)
    df = docs.withColumn(text, F.coalesce("text", F.lit("")))
    df = df.withColumn(words, F.array_remove(F.split(text, _SPACES + "+"), ""))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get(F.col(hashes), i + k)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(windows, F.transform(starts, lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))
    # windows of equal hash side by side, in the order of the text; only where some are equal
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    df = df.withColumn(ranked, F.when(some, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get(F.col(ranked), j)["h"] == x["h"], F.lit(False))
    repeated = F.sort_array(F.transform(F.filter(ranked, lambda x, j: ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))) | same(x, j + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        repeated,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(windows, lines)
    counts = {
        "n_words": n,
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size(windows) - F.size(F.array_distinct(windows)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size(windows),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")),
        "n_marks": F.regexp_count(text, F.lit("[!?]")),
    }
    # an outer generator, since filters on the counts would otherwise be pushed below and compute every step again for each word
    one = F.array(F.struct(*(c.cast("long").alias(k) for k, c in counts.items())))
    return df.withColumn(windows, one).drop(text, words, hashes, ranked).select("*", F.explode_outer(windows).alias(out)).drop(windows)


def base_failed(c: str) -> Column:
    return (F.col(f"{c}.n_words") < MIN_WORDS) | (100 * F.col(f"{c}.n_repeat_words") > REPEAT_PERCENT * F.col(f"{c}.n_words"))


def rate(c: str, top: str, below: str) -> Column:
    return F.expr(f"{c}.{top} * 1000 div greatest({c}.{below}, 1)")


def bucket(v: Column) -> Column:
    """The value with its leading bits kept; exact below 2^PRECISION."""
    unit = F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - PRECISION, F.lit(0))).cast("long")
    return v - v % unit


def _group(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def thresholds(counted: DataFrame, c: str, by_ratio: bool = False) -> DataFrame:
    """Fences of each language and source: lang, source, and ``{metric}_low`` and ``{metric}_high``. Low ones are below
    the first quartile by REACH distances of the quartiles, or ``by_ratio`` by their ratio to the power REACH."""
    rates = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(rate(c, top, below)).alias("bucket")) for m, top, below, _, _ in METRICS))
    sketch = (
        counted.select(_group("lang").alias("lang"), _group("source").alias("source"), F.explode(rates).alias("r"))
        .groupBy("lang", "source", "r.metric", "r.bucket")
        .agg(F.count("*").alias("n"))
    )
    sketch = stage(few_files(sketch), "quantile-sketches")
    total = F.sum("n").over(Window.partitionBy("lang", "source", "metric"))
    groups = sketch.groupBy("lang", "source", "metric").agg(F.sum("n").alias("rows")).where(F.col("metric") == METRICS[0][0]).select("lang", "source", "rows")
    levels = [
        sketch.withColumn("rows", total).where(F.col("rows") >= SMALL).select("lang", "source", "metric", "bucket", "n"),
        sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), "metric", "bucket", "n"),
        sketch.groupBy("metric", "bucket").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "metric", "bucket", "n"),
    ]
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2])
    own = Window.partitionBy("lang", "source", "metric")
    merged = merged.withColumn("upto", F.sum("n").over(own.orderBy("bucket"))).withColumn("rows", F.sum("n").over(own))
    quartiles = merged.groupBy("lang", "source", "metric").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("rows"), F.col("bucket"))).alias("q1"), F.min(F.when(4 * F.col("upto") >= 3 * F.col("rows"), F.col("bucket"))).alias("q3"), F.max("rows").alias("rows")
    )
    slack = F.create_map(*(F.lit(x) for m, _, _, s, _ in METRICS for x in (m, s)))[F.col("metric")]
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), slack)
    ratio = F.greatest(F.col("q3") / F.nullif(F.col("q1"), F.lit(0)), F.lit(LOW_RATIO / 1000))
    low = F.floor(F.col("q1") / F.pow(ratio, F.lit(REACH))) if by_ratio else F.col("q1") - reach
    fences = quartiles.withColumn("low", low).withColumn("high", F.col("q3") + reach)
    wide = fences.groupBy("lang", "source").agg(
        F.max("rows").alias("level_rows"), *(F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m, *_ in METRICS for side in ("low", "high"))
    )
    by_lang, corpus = wide.where("source is null and lang is not null").drop("source"), wide.where("source is null and lang is null").drop("lang", "source")
    names = [n for n in wide.columns if n not in ("lang", "source")]
    joined = (
        groups.join(wide.where("source is not null"), ["lang", "source"], "left")
        .join(by_lang.select("lang", *(F.col(n).alias(f"l_{n}") for n in names)), "lang", "left")
        .join(F.broadcast(corpus.select(*(F.col(n).alias(f"c_{n}") for n in names))), F.lit(True), "left")  # one row
    )
    pick = lambda n: F.when(F.col("level_rows").isNotNull(), F.col(n)).when(F.col("l_level_rows") >= SMALL, F.col(f"l_{n}")).otherwise(F.col(f"c_{n}")).alias(n)
    return joined.select("lang", "source", *(pick(n) for n in names if n != "level_rows"))


def verdicts(counted: DataFrame, c: str, fences: DataFrame, out: str) -> DataFrame:
    """``counted`` with the boolean ``out``: whether the rules keep the row."""
    own = dict(zip(fences.columns, fresh(counted, *fences.columns)))
    fences = stage(few_files(fences.select(*(F.col(n).alias(m) for n, m in own.items()))), "fences")
    if fences.count() <= GROUPS_BROADCAST:  # else left to a sort-merge join, whose skewed groups are split
        fences = F.broadcast(fences)
    joined = counted.join(fences, (_group("lang") == F.col(own["lang"])) & (_group("source") == F.col(own["source"])), "left")
    inside = F.lit(True)
    for m, top, below, _, both in METRICS:
        inside &= rate(c, top, below) <= F.col(own[f"{m}_high"])
        if both:
            inside &= rate(c, top, below) >= F.col(own[f"{m}_low"])
    return joined.withColumn(out, ~base_failed(c) & inside).drop(*own.values())


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""
    counted = stage(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "rule-counts")
    judged = verdicts(counted, "counts", thresholds(counted, "counts"), "passed")
    return judged.select("doc_id", *(F.col(f"counts.{n}").alias(n) for n in COUNTS[:5]), base_failed("counts").alias("base_failed"), F.col("passed").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, columns unchanged. Rows are staged with their counts, which are made once."""
    counts, passed = fresh(docs, "counts", "passed")
    counted = stage(with_counts(docs, counts), "rule-counts")
    return verdicts(counted, counts, thresholds(counted, counts, by_ratio=True), passed).where(F.col(passed)).select(*(F.col(f"`{c}`") for c in docs.columns))

"""Evaluation: outcome metrics, percentiles, confusion matrices, splits and threshold replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(part: Column, whole: Column) -> Column:
    """Share of rows of ``whole`` that are in ``part``; NULL where there are none."""
    return F.count_if(part & whole) / F.nullif(F.count_if(whole), F.lit(0))


def percentile(value: Column | str, p: float) -> Column:
    """Exact percentile with linear interpolation; NULL of nothing."""
    return F.percentile(value, p)


def outcome_metrics() -> list[Column]:
    """Metrics of rows with answerable, refused, hit, section_hit, citation_correct, retrieval_ms, error."""
    answerable, refused = F.col("answerable"), F.col("refused")
    asked = F.col("error").isNull()
    return [
        F.count("*").alias("questions"), F.count_if(~asked).alias("errors"),
        ratio(F.col("hit"), asked & answerable).alias("hit_rate"), ratio(F.col("section_hit"), asked & answerable).alias("section_hit_rate"),
        ratio(F.col("citation_correct"), asked & answerable & ~refused).alias("citation_accuracy"),
        ratio(refused, asked & ~answerable).alias("refusal_accuracy"), ratio(refused, asked & answerable).alias("false_refusal_rate"),
        percentile("retrieval_ms", 0.5).alias("retrieval_p50"), percentile("retrieval_ms", 0.95).alias("retrieval_p95"),
    ]


def full_metrics() -> list[Column]:
    """All metrics of a run. Beyond the columns of ``outcome_metrics``: citation_located, keyword_coverage, partial, answer,
    schema_valid, generation_ms, input_tokens, output_tokens. Errors count as such alone; the rates named legacy take
    every answer that was flagged as insufficient for a refusal."""
    ok = F.col("error").isNull()
    answerable, unanswerable = ok & F.col("answerable"), ok & ~F.col("answerable")
    answered = answerable & ~F.col("refused")
    flagged = F.col("refused") | F.col("partial")
    only = lambda c, when: F.when(when, c)
    wrote = ok & (F.col("generation_ms") > 0)
    total = F.col("retrieval_ms") + F.col("generation_ms")
    return [
        F.count("*").alias("questions"), F.count_if(~ok).alias("errors"), F.count_if(answerable).alias("answerable"), F.count_if(unanswerable).alias("unanswerable"),
        ratio(F.col("hit"), answerable).alias("hit_rate"), ratio(F.col("section_hit"), answerable).alias("section_hit_rate"),
        ratio(F.col("citation_correct"), answered).alias("citation_accuracy"), ratio(F.col("citation_located"), answered).alias("citation_location"),
        F.avg(only(F.col("keyword_coverage"), answered)).alias("keyword_coverage"),
        ratio(F.col("refused"), unanswerable).alias("refusal_accuracy"), ratio(F.col("refused"), answerable).alias("false_refusal_rate"),
        ratio(F.col("partial"), answerable).alias("partial_answer_rate"), F.count_if(unanswerable & F.col("partial")).alias("must_refuse_partial"),
        ratio(flagged, answerable).alias("legacy_false_refusal_rate"), ratio(flagged, unanswerable).alias("legacy_refusal_accuracy"),
        ratio(F.col("answer").rlike("[가-힣]"), answered).alias("korean_answer_rate"),
        ratio(F.col("schema_valid"), ok & F.col("schema_valid").isNotNull()).alias("schema_valid_rate"),
        *(percentile(only(c, when), p).alias(f"{name}_p{round(100 * p)}") for name, c, when in (("retrieval", F.col("retrieval_ms"), ok), ("generation", F.col("generation_ms"), wrote), ("total", total, ok)) for p in (0.5, 0.95)),
        F.sum(only(F.col("input_tokens"), ok)).alias("input_tokens"), F.sum(only(F.col("output_tokens"), ok)).alias("output_tokens"),
    ]


def summarize(outcomes: DataFrame, by: tuple[str, str] = ("type", "lang")) -> DataFrame:
    """Overall and by each of two columns, in one pass by grouping sets; the other columns are NULL."""
    a, b = by
    out = outcomes.groupingSets([[], [a], [b]], a, b).agg(F.grouping_id().alias("g"), *outcome_metrics())
    return out.withColumn("level", F.when(F.col("g") == 3, "all").when(F.col("g") == 1, a).otherwise(b)).drop("g")


def matches(file: Column, gold_file: Column, section: Column, gold_section: Column, page: Column, gold_pages: Column) -> Column:
    """Whether a source is an expected one: the file, and its section or page where one is given."""
    by_section = F.contains(F.lower(section), F.lower(gold_section))
    located = gold_section.isNotNull() | gold_pages.isNotNull()
    return (file == gold_file) & (~located | F.coalesce(by_section, F.lit(False)) | F.coalesce(F.array_contains(gold_pages, page), F.lit(False)))


def hits(gold: Column, retrieved: Column, cited: Column) -> list[Column]:
    """hit and citation_correct: retrieved meets gold; what is cited is gold and not nothing."""
    return [F.arrays_overlap(gold, retrieved).alias("hit"), ((F.size(cited) > 0) & (F.size(F.array_except(cited, gold)) == 0)).alias("citation_correct")]


def refusal_reasons(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("refused").groupBy(F.coalesce("refusal_reason", F.lit("UNKNOWN")).alias("reason")).agg(F.count("*").alias("n"))


def failed(outcomes: DataFrame) -> DataFrame:
    """Questions that went wrong, with what went wrong."""
    why = F.array_compact(F.array(
        F.when(F.col("error").isNotNull(), "error"), F.when(F.col("answerable") & F.col("refused"), "refused"), F.when(~F.col("answerable") & ~F.col("refused"), "answered"),
        F.when(F.col("answerable") & ~F.col("hit"), "missed"), F.when(F.col("answerable") & ~F.col("refused") & ~F.col("citation_correct"), "citation"),
    ))
    return outcomes.withColumn("reasons", F.array_join(why, ",")).where("reasons <> ''").select("id", "reasons")


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of rows with truth and predicted (booleans)."""
    t, p = F.col("truth"), F.col("predicted")
    c = rows.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    over = lambda a, b: F.col(a) / F.nullif(F.expr(b), F.lit(0))
    c = c.withColumn("precision", over("tp", "tp + fp")).withColumn("recall", over("tp", "tp + fn"))
    return c.withColumn("f1", F.expr("2.0D * tp / nullif(2 * tp + fp + fn, 0)")).withColumn("accuracy", F.expr("(tp + tn) / nullif(tp + fp + fn + tn, 0)")).withColumn("false_refusal", over("fp", "fp + tn"))


def split(rows: DataFrame, by: str = "type", id_: str = "id") -> DataFrame:
    """Adds part: dev and test in turn within each type by id. Question sets are written by hand, so a type fits a task."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(id_))
    return rows.withColumn("part", F.when(place % 2 == 1, "dev").otherwise("test"))


def replay(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: how many answerable and unanswerable questions would be refused, and the objective (share
    of right decisions). Refused: refused already, or score below the threshold. The grid goes into columns, not rows."""
    gone = lambda t: F.col("refused") | (F.col("score") < t)
    cells = [F.struct(F.lit(t).alias("threshold"), F.count_if(gone(t) & F.col("answerable")).alias("false_refusals"), F.count_if(gone(t) & ~F.col("answerable")).alias("right_refusals")) for t in thresholds]
    wide = rows.agg(F.count_if("answerable").alias("a"), F.count_if(~F.col("answerable")).alias("u"), F.array(*cells).alias("cells"))
    long = wide.select("a", "u", F.explode("cells").alias("c")).select("a", "u", "c.*")
    return long.withColumn("objective", F.expr("(a - false_refusals + right_refusals) / nullif(a + u, 0)")).drop("a", "u")


def choose(replayed: DataFrame) -> DataFrame:
    """The largest objective; of equals the lowest threshold."""
    return replayed.orderBy(F.desc("objective"), "threshold").limit(1)


def widest_tie(replayed: DataFrame) -> DataFrame:
    """The middle of the widest unbroken run of thresholds that share the largest objective. One row for each
    threshold of a grid written by hand."""
    every = Window.orderBy("threshold")
    best = F.max("objective").over(Window.partitionBy())
    marked = replayed.withColumn("k", F.row_number().over(every)).withColumn("best", best).where("objective = best")
    runs = marked.withColumn("run", F.col("k") - F.row_number().over(every)).groupBy("run").agg(F.min("threshold").alias("low"), F.max("threshold").alias("high"))
    return runs.orderBy(F.desc(F.col("high") - F.col("low")), "low").limit(1).select(((F.col("low") + F.col("high")) / 2).alias("threshold"), "low", "high")


def write_run(outcomes: DataFrame, config: dict, folder: str, private: bool = False) -> None:
    """A run's folder: config, summary and questions as JSON, and a report. Of a private corpus only aggregates are written,
    and not into a git tree."""
    import json
    import pathlib

    root = pathlib.Path(folder)
    if private and any((p / ".git").exists() for p in (root.resolve(), *root.resolve().parents)):
        raise PermissionError("results of a private corpus don't go into a git tree")
    root.mkdir(parents=True)
    summary = outcomes.agg(*outcome_metrics()).first().asDict()  # one row
    (root / "config.json").write_text(json.dumps(config, indent=1, ensure_ascii=False))
    (root / "summary.json").write_text(json.dumps(summary, indent=1))
    (root / "report.md").write_text("\n".join(["# Run", "", "| Metric | Value |", "|---|---|", *(f"| {k} | {v} |" for k, v in summary.items())]) + "\n")
    if not private:
        outcomes.write.json(f"{root.resolve()}/questions.jsonl")


def compare_with_gold(modes: DataFrame, exact: str) -> DataFrame:
    """For each search mode (query_id, mode, ids, files, gold, ms): queries whose ids in order and whose files differ from
    mode ``exact``, share of gold files met, median milliseconds."""
    base = modes.where(F.col("mode") == exact).select("query_id", F.col("ids").alias("b_ids"), F.col("files").alias("b_files"))
    norm = lambda c: F.array_sort(F.array_distinct(c))
    return modes.join(base, "query_id").groupBy("mode").agg(
        F.count("*").alias("queries"), F.count_if(F.col("ids") != F.col("b_ids")).alias("ids_differ"), F.count_if(norm("files") != norm("b_files")).alias("files_differ"),
        F.avg(F.arrays_overlap("files", "gold").cast("double")).alias("hit"), F.median("ms").alias("median_ms"),
    )


def closed_book(answers: DataFrame) -> DataFrame:
    """Accuracy of option letters: in each order of the options, and in both at once. answers: id, rotation, answer, right."""
    scored = answers.withColumn("ok", F.coalesce(letter(F.col("answer")) == F.col("right"), F.lit(False)))
    every = scored.groupBy("id").agg(F.bool_and("ok").alias("both")).agg(F.avg(F.col("both").cast("double")).alias("accuracy")).select(F.lit(None).cast("int").alias("rotation"), "accuracy")
    return scored.groupBy("rotation").agg(F.avg(F.col("ok").cast("double")).alias("accuracy")).unionByName(every)


def compare_modes(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Two search modes (query_id, ids in order, files): whether ids or sets of files differ, and short results."""
    j = a.select("query_id", F.col("ids").alias("ia"), F.col("files").alias("fa")).join(b.select("query_id", F.col("ids").alias("ib"), F.col("files").alias("fb")), "query_id")
    norm = lambda c: F.array_sort(F.array_distinct(c))
    return j.agg(F.count("*").alias("queries"), F.count_if(F.col("ia") != F.col("ib")).alias("ids_differ"), F.count_if(norm("fa") != norm("fb")).alias("files_differ"), F.count_if(F.size("ib") < k).alias("short"))


def diagnostics(retrieved: DataFrame) -> DataFrame:
    """For each query: share of retrieved chunks of other groups, and whether a probe was met. Columns: query_id,
    group, own_group, probe."""
    return retrieved.groupBy("query_id").agg(F.avg((F.col("group") != F.col("own_group")).cast("double")).alias("other_share"), F.max("probe").alias("probe_hit"))


def located(evidence: DataFrame, sections: DataFrame) -> DataFrame:
    """Quotes found in their expected file after white space is evened out. evidence: id, file, quote; sections: file, text."""
    even = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    joined = evidence.join(sections.select("file", "text"), "file")
    return joined.groupBy("id", "quote").agg(F.bool_or(F.contains(even("text"), even("quote"))).alias("found"))


def sought(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes (id, q) found in texts (t): t, id. A quote is looked for only where its longest inner word occurs, so
    texts meet few quotes; quotes without inner words meet every text. Quotes are a list written by hand."""
    words = F.split("q", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    keyed = quotes.withColumn("w", F.get(F.array_sort(inner, lambda a, b: F.char_length(b) - F.char_length(a)), F.lit(0)))
    keys = keyed.where("w is not null").agg(F.collect_set("w").alias("keys"))  # one row
    met = texts.join(F.broadcast(keys)).select("t", F.explode(F.array_intersect(F.split("t", " "), F.col("keys"))).alias("w"))
    found = met.join(F.broadcast(keyed.select("id", "q", "w")), "w").where(F.contains("t", "q")).select("t", "id")
    short = texts.join(F.broadcast(keyed.where("w is null").select("id", "q")), F.contains("t", "q")).select("t", "id")
    return found.unionByName(short)


def letter(answer: Column) -> Column:
    """The option letter of a closed-book answer."""
    return F.nullif(F.upper(F.regexp_extract(answer, r"(?i)^\s*\(?([A-E])\b", 1)), F.lit(""))


def rotate(options: Column, by: int) -> Column:
    return F.concat(F.slice(options, by + 1, 99), F.slice(options, 1, by))

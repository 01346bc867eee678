"""Queries over questions, answers, the index and evaluation rows; inputs are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as t
from larkspur.operators import answers, evaluate, index, search
from larkspur.plans import dataflows
from larkspur.registry import query, table

# --- filters and retrieval ---------------------------------------------------------------------------------------

_CHUNKS = """c as (select vec_id as chunk_id, vec_id // 2 as document_id, case when vec_id % 9 = 0 then 'm0' else 'm1' end as embedding_model from embeddings),
d as (select doc_id as document_id, source as corpus, nullif(lang, 'fr') as classification, case when doc_id % 7 = 0 then 'FAILED' else 'INDEXED' end as status, case when doc_id % 3 = 0 then 'pdf' else 'txt' end as file_type, doc_id % 5 <> 0 as is_latest from documents)"""


def _chunks(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 2").alias("document_id"), F.when(F.col("vec_id") % 9 == 0, "m0").otherwise("m1").alias("embedding_model"), "embedding")


def _documents(spark, sf):
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        k.alias("document_id"), F.col("source").alias("corpus"), F.nullif("lang", F.lit("fr")).alias("classification"), F.when(k % 7 == 0, "FAILED").otherwise("INDEXED").alias("status"), F.when(k % 3 == 0, "pdf").otherwise("txt").alias("file_type"), (k % 5 != 0).alias("is_latest"),
    )


@query(f"""with {_CHUNKS}, j as (select * from c join d using (document_id) where status = 'INDEXED')
select chunk_id, 'indexed' as filter from j union all select chunk_id, 'type' from j where file_type = 'txt' union all select chunk_id, 'model' from j where embedding_model = 'm1'
union all select chunk_id, 'class' from j where classification in ('de', 'en') union all select chunk_id, 'latest' from j where is_latest
union all select chunk_id, 'corpus' from j where corpus = (select min(source) from documents) union all select chunk_id, 'all' from j where file_type = 'pdf' and embedding_model = 'm1' and classification in ('de', 'en') and is_latest""")
def search_filters(spark, sf):
    """Each filter of a search for itself, and several together."""
    chunks, docs = _chunks(spark, sf).drop("embedding"), _documents(spark, sf)
    first = docs.agg(F.min("corpus")).first()[0]
    cases = {"indexed": {}, "type": {"file_type": "txt"}, "model": {"model": "m1"}, "class": {"classifications": ("en", "de")}, "latest": {"latest_only": True}, "corpus": {"corpus": first}}
    cases["all"] = {"file_type": "pdf", "model": "m1", "classifications": ("en", "de"), "latest_only": True}
    out = None
    for name, filters in cases.items():
        found = search.searchable(chunks, docs, **filters).select("chunk_id", F.lit(name).alias("filter"))
        out = found if out is None else out.unionByName(found)
    return out


@query()
def hybrid_retrieval(spark, sf):
    """Both channels over every chunk of an indexed document that passes the filters, fused; the questions are the texts of
    conversations' first turns whose id is divisible by 50. Tests hold it against plain Python."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    chunks = _chunks(spark, sf).join(texts, "document_id")
    asked = table(spark, sf, "conversations").where("turn = 0 and conv_id % 50 = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("question"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    found = dataflows.retrieve(asked.join(vectors, "query_id"), chunks, 5, documents=_documents(spark, sf), filters={"latest_only": True}, hybrid=True)
    return found.select("query_id", "item_id", "rank", F.round("rrf", 8).alias("rrf"))


# --- scope -------------------------------------------------------------------------------------------------------

_PHRASES = (
    "", "우리 환자 영상 판독 결과", "이 CT 에서 전이인지", "어머니 약을 바꿔도 되나요", "처방해 주세요", "결절이 있나요", "재발인지 구분", "판독", "치료 방법", "My scan shows", "please interpret this", "Should we STOP it", "is the lesion benign",
    "what dose do we give", "how long does it last", "다이 환자", "diagnose", "this report", "용량을 얼마나", "수술해야 하나요 딸", "the imaging charter",
)


def _request_sql(column: str) -> str:
    """RE2 has no look-behind: what must not come before is taken as a character that is no syllable."""
    subject = answers.KO_SUBJECT.replace("(?<![가-힣])", "(^|[^가-힣])")
    pattern = answers.REQUEST.replace(answers.KO_SUBJECT, subject)
    return f"regexp_matches({column}, '(?i){pattern}')"


@query(f"""with p(k, phrase) as (values {", ".join(f"({k}, '{x}')" for k, x in enumerate(_PHRASES))}),
q as (select conv_id, turn, text || ' ' || phrase as question, (conv_id * 13 % 100) / 100.0::double as margin from conversations join p on k = (conv_id * 7 + turn) % {len(_PHRASES)}),
r as (select *, {_request_sql('question')} as request, regexp_matches(question, '(?i){answers.BASELINE}') as older from q)
select conv_id, turn, older, request or margin >= 0.9 as out_of_scope, case when request then 'regex' when margin >= 0.9 then 'embedding' else 'none' end as method from r""")
def scope_requests(spark, sf):
    """The request pattern, the older one, and the decision with an exemplar margin."""
    k = (F.col("conv_id") * 7 + F.col("turn")) % len(_PHRASES)
    q = table(spark, sf, "conversations").withColumn("question", F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, _PHRASES)), (k + 1).cast("int"))))
    decision = answers.scope_decision(F.col("question"), F.col("conv_id") * 13 % 100 / 100.0, 0.9)
    return q.withColumn("d", decision).select("conv_id", "turn", answers.request_scope(F.col("question"), answers.BASELINE).alias("older"), "d.out_of_scope", "d.method")


# --- answers -----------------------------------------------------------------------------------------------------


@query(r"""with a as (select conv_id, turn, conv_id % 5 as k, (turn % 5)::int as n from conversations),
b as (select *, case k when 0 then 'a [1]' when 1 then '{"answer": "b", "cited_context_ids": []}' when 2 then 'plain [2] and [' || turn || ']' when 3 then 'I cannot answer this' else 'no mark' end as answer, case when k = 0 then [1 + turn % 4, 9, 1 + conv_id % 3] end as ids from a),
c as (select *, list_filter(list_transform(coalesce(ids, []), lambda x: x - 1), lambda x: x >= 0 and x < n) as v, list_filter(list_transform(regexp_extract_all(answer, '\[(\d{1,2})\]', 1), lambda x: x::int - 1), lambda x: x >= 0 and x < n) as p, contains(answer, 'cannot answer') as r from b),
d as (select *, case when r then 'none' when len(v) > 0 then 'structured' when len(p) > 0 then 'parsed' else 'retrieved' end as mode from c),
e as (select *, case mode when 'structured' then list_filter(v, lambda x, i: list_position(v, x) = i) when 'parsed' then list_filter(p, lambda x, i: list_position(p, x) = i) when 'retrieved' then range(n) else [] end as cited from d)
select conv_id, turn, answer, mode as citation_mode, array_to_string(cited, ',') as cited, case when conv_id % 11 = 0 then 'OUT_OF_SCOPE' when n = 0 then 'NO_EVIDENCE' when r then 'MODEL_REFUSED' end as refusal_reason,
k = 0 and turn % 2 = 0 and len(cited) > 0 and not (conv_id % 11 = 0 or n = 0) as partial from e""")
def answer_citations(spark, sf):
    """Structured answers, those that lack a field, marks in plain text, refusals; what each cites and why none is given."""
    k, text = F.col("conv_id") % 5, lambda c: c.cast("string")
    structured = F.concat(F.lit('{"answer": "a [1]", "cited_context_ids": ['), text(1 + F.col("turn") % 4), F.lit(", 9, "), text(1 + F.col("conv_id") % 3), F.lit('], "insufficient_evidence": '), text(F.col("turn") % 2 == 0), F.lit("}"))
    raw = F.when(k == 0, structured).when(k == 1, '{"answer": "b", "cited_context_ids": []}').when(k == 2, F.concat(F.lit("plain [2] and ["), text(F.col("turn")), F.lit("]"))).when(k == 3, "I cannot answer this").otherwise("no mark")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"), (F.col("turn") % 5).cast("int").alias("n_contexts")).withColumn("g", answers.parse_grounded(F.col("raw")))
    rows = rows.withColumn("answer", F.coalesce("g.answer", "raw")).withColumn("structured_ids", F.col("g.cited_context_ids"))
    done = answers.cited(rows, "cannot answer")
    reason = answers.refusal_reason(F.col("conv_id") % 11 == 0, F.col("n_contexts"), t.is_refusal(F.col("answer"), "cannot answer"))
    done = done.withColumn("refusal_reason", reason)
    partial = answers.is_partial(F.col("g.insufficient_evidence"), F.size("cited"), F.col("refusal_reason").isNotNull())
    return done.select("conv_id", "turn", "answer", "citation_mode", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), "refusal_reason", partial.alias("partial"))


@query("""with d as (select conv_id, 'f' || (turn % 3) as name, turn, (turn + conv_id) % 4 <> 0 as is_latest from conversations), s as (select conv_id, name, min(turn) as first from d where not is_latest group by all)
select d.conv_id, coalesce((select string_agg(name, ',' order by first) from s where s.conv_id = d.conv_id), '') as superseded, round(avg((turn * 0.123456)::double), 4) as mean_score from d group by 1""")
def superseded_sources(spark, sf):
    """Names of cited sources that are not the latest edition."""
    source = F.struct("turn", F.concat(F.lit("f"), (F.col("turn") % 3).cast("string")).alias("name"), ((F.col("turn") + F.col("conv_id")) % 4 != 0).alias("is_latest"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(source)).alias("sources"), F.round(F.avg(F.col("turn") * 0.123456), 4).alias("mean_score"))
    return rows.select("conv_id", F.array_join(answers.superseded(F.col("sources")), ",").alias("superseded"), "mean_score")


# --- index -------------------------------------------------------------------------------------------------------


@query("""with p as (select doc_id as document_id, n_chars // 100 as n, case when doc_id % 13 = 0 then 'CORRUPTED_FILE' end as error_type, case when doc_id % 13 = 0 then text end as message from documents)
select document_id, case when error_type is not null or n = 0 then 'FAILED' else 'INDEXED' end as status, case when error_type is not null or n = 0 then 0 else n end as chunk_count, case when error_type is not null or n = 0 then coalesce(error_type, 'EMPTY_DOCUMENT') end as error_type, left(message, 2000) as error_message from p""")
def index_outcomes(spark, sf):
    bad = F.col("doc_id") % 13 == 0
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.expr("n_chars div 100").alias("n_chunks"), F.when(bad, "CORRUPTED_FILE").alias("error_type"), F.when(bad, F.col("text")).alias("error_message"))
    return index.outcomes(p)


@query(f"with {_CHUNKS} select distinct document_id from c where document_id not in (select document_id from c where embedding_model = 'm1')")
def stale_models(spark, sf):
    return index.stale(_chunks(spark, sf), "m1")


@query(f"""with {_CHUNKS} select (select string_agg(distinct embedding_model, ',' order by embedding_model) from c) as models, (select count(*) from embeddings where len(embedding) <> 64) as wrong_dimension,
(select count(*) from documents where doc_id % 7 = 0 and doc_id % 14 <> 0) as pending""")
def index_health(spark, sf):
    docs = _documents(spark, sf).withColumn("error_type", F.when(F.col("document_id") % 14 == 0, "CORRUPTED_FILE").when(F.col("document_id") % 7 == 0, "REINDEX_REQUIRED"))
    return index.health(_chunks(spark, sf), docs, 64).withColumn("models", F.array_join("models", ","))


@query("""select doc_id, replace(source || (case when doc_id % 2 = 0 then ':latest' else ':7b' end), ':latest', '') as model from documents""")
def model_names(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", index.model_name(F.concat("source", F.when(F.col("doc_id") % 2 == 0, ":latest").otherwise(":7b"))).alias("model"))


# --- evaluation --------------------------------------------------------------------------------------------------

_SOURCES = """s as (select event_id as id, 'f' || (event_id % 3) as file, 'f' || (user_id % 3) as gold_file, case when event_id % 4 <> 0 then 'Chapter ' || (event_id % 5) || ' ' || event_type end as section, case when event_id % 3 = 0 then 'CHAPTER ' || (event_id % 10) end as gold_section,
 case when event_id % 6 <> 0 then (event_id % 7)::int end as page, case when event_id % 5 < 2 then [(user_id % 7)::int, 3] end as gold_pages from events)"""


@query(f"""with {_SOURCES} select id, file = gold_file and ((gold_section is null and gold_pages is null) or coalesce(contains(lower(section), lower(gold_section)), false) or coalesce(list_contains(gold_pages, page), false)) as located,
 len(list_intersect([file, 'f9'], [gold_file, 'f8'])) > 0 as hit, len(list_filter([file], lambda x: not list_contains([gold_file, 'f8'], x))) = 0 as citation_correct from s""")
def source_matches(spark, sf):
    """Sources against expected ones: file, section or page; and whether lists of them meet."""
    k, text = F.col("event_id"), lambda c: c.cast("string")
    s = table(spark, sf, "events").select(
        k.alias("id"), F.concat(F.lit("f"), text(k % 3)).alias("file"), F.concat(F.lit("f"), text(F.col("user_id") % 3)).alias("gold_file"), F.when(k % 4 != 0, F.concat(F.lit("Chapter "), text(k % 5), F.lit(" "), "event_type")).alias("section"),
        F.when(k % 3 == 0, F.concat(F.lit("CHAPTER "), text(k % 10))).alias("gold_section"), F.when(k % 6 != 0, (k % 7).cast("int")).alias("page"), F.when(k % 5 < 2, F.array((F.col("user_id") % 7).cast("int"), F.lit(3))).alias("gold_pages"),
    )
    where = evaluate.matches(*(F.col(c) for c in ("file", "gold_file", "section", "gold_section", "page", "gold_pages")))
    return s.select("id", where.alias("located"), *evaluate.hits(F.array("gold_file", F.lit("f8")), F.array("file", F.lit("f9")), F.array("file")))


@query("""with k as (select conv_id, turn, text, [left(text, 3), 'THE', upper(right(text, 2)), 'zzz'] as keys from conversations)
select conv_id, turn, round(len(list_filter(keys, lambda k: contains(lower(text), lower(k))))::double / 4, 6) as coverage, nullif(upper(regexp_extract(case when turn % 2 = 0 then ' (b) because' else text end, '(?i)^\\s*\\(?([A-E])\\b', 1)), '') as letter from k""")
def keyword_coverage(spark, sf):
    """Keywords that an answer has, and the option letter that one begins with."""
    c = table(spark, sf, "conversations")
    keys = F.array(F.expr("left(text, 3)"), F.lit("THE"), t.simple_upper(F.expr("right(text, 2)")), F.lit("zzz"))
    # the SQL's upper and lower map each code point to one, Spark's don't
    return c.select("conv_id", "turn", F.round(t.keyword_coverage(t.simple_lower(F.col("text")), F.transform(keys, t.simple_lower)), 6).alias("coverage"), evaluate.letter(F.when(F.col("turn") % 2 == 0, " (b) because").otherwise(F.col("text"))).alias("letter"))


_FULL = """o as (select event_id as id, event_type as type, case when user_id % 2 = 0 then 'ko' else 'en' end as lang, event_id % 4 <> 0 as answerable, event_id % 6 = 0 as refused, event_id % 3 <> 0 as hit, event_id % 5 <> 0 as section_hit, event_id % 7 <> 0 as citation_correct,
 event_id % 8 <> 0 as citation_located, (event_id % 11) / 10.0::double as keyword_coverage, event_id % 9 = 0 as partial, case when event_id % 2 = 0 then '답 ' else 'answer ' end || event_id as answer, case when event_id % 10 <> 0 then event_id % 3 = 0 end as schema_valid,
 value as retrieval_ms, case when event_id % 6 = 0 then 0 else value * 3 end as generation_ms, case when event_id % 12 <> 0 then event_id % 500 end as input_tokens, case when event_id % 13 <> 0 then event_id % 70 end as output_tokens, case when event_id % 50 = 0 then 'timeout' end as error from events)"""


def _ratio_sql(part: str, whole: str) -> str:
    return f"round((count(*) filter (where ({part}) and ({whole})))::double / nullif(count(*) filter (where {whole}), 0), 6)"


_ANSWERED = "error is null and answerable and not refused"
_FULL_SQL = f"""with {_FULL} select type, count(*) as questions, count(*) filter (where error is not null) as errors, count(*) filter (where error is null and answerable) as answerable, count(*) filter (where error is null and not answerable) as unanswerable,
{_ratio_sql('hit', 'error is null and answerable')} as hit_rate, {_ratio_sql('section_hit', 'error is null and answerable')} as section_hit_rate, {_ratio_sql('citation_correct', _ANSWERED)} as citation_accuracy, {_ratio_sql('citation_located', _ANSWERED)} as citation_location,
round(avg(keyword_coverage) filter (where {_ANSWERED}), 6) as keyword_coverage, {_ratio_sql('refused', 'error is null and not answerable')} as refusal_accuracy, {_ratio_sql('refused', 'error is null and answerable')} as false_refusal_rate,
{_ratio_sql('partial', 'error is null and answerable')} as partial_answer_rate, count(*) filter (where error is null and not answerable and partial) as must_refuse_partial, {_ratio_sql('refused or partial', 'error is null and answerable')} as legacy_false_refusal_rate,
{_ratio_sql('refused or partial', 'error is null and not answerable')} as legacy_refusal_accuracy, {_ratio_sql("regexp_matches(answer, '[가-힣]')", _ANSWERED)} as korean_answer_rate, {_ratio_sql('schema_valid', 'error is null and schema_valid is not null')} as schema_valid_rate,
round(quantile_cont(retrieval_ms, 0.5) filter (where error is null), 4) as retrieval_p50, round(quantile_cont(retrieval_ms, 0.95) filter (where error is null), 4) as retrieval_p95,
round(quantile_cont(generation_ms, 0.5) filter (where error is null and generation_ms > 0), 4) as generation_p50, round(quantile_cont(generation_ms, 0.95) filter (where error is null and generation_ms > 0), 4) as generation_p95,
round(quantile_cont(retrieval_ms + generation_ms, 0.5) filter (where error is null), 4) as total_p50, round(quantile_cont(retrieval_ms + generation_ms, 0.95) filter (where error is null), 4) as total_p95,
sum(input_tokens) filter (where error is null)::bigint as input_tokens, sum(output_tokens) filter (where error is null)::bigint as output_tokens from o group by 1"""


@query(_FULL_SQL)
def full_summary(spark, sf):
    """All metrics of an evaluation run by question type."""
    k = F.col("event_id")
    o = table(spark, sf, "events").select(
        F.col("event_type").alias("type"), (k % 4 != 0).alias("answerable"), (k % 6 == 0).alias("refused"), (k % 3 != 0).alias("hit"), (k % 5 != 0).alias("section_hit"), (k % 7 != 0).alias("citation_correct"), (k % 8 != 0).alias("citation_located"),
        (k % 11 / 10.0).alias("keyword_coverage"), (k % 9 == 0).alias("partial"), F.concat(F.when(k % 2 == 0, "답 ").otherwise("answer "), k.cast("string")).alias("answer"), F.when(k % 10 != 0, k % 3 == 0).alias("schema_valid"), F.col("value").alias("retrieval_ms"),
        F.when(k % 6 == 0, 0.0).otherwise(F.col("value") * 3).alias("generation_ms"), F.when(k % 12 != 0, k % 500).alias("input_tokens"), F.when(k % 13 != 0, k % 70).alias("output_tokens"), F.when(k % 50 == 0, "timeout").alias("error"),
    )
    s = o.groupBy("type").agg(*evaluate.full_metrics())
    exact = {"type", "questions", "errors", "answerable", "unanswerable", "must_refuse_partial", "input_tokens", "output_tokens"}
    return s.select(*(c if c in exact else F.round(c, 4 if c.endswith(("p50", "p95")) else 6).alias(c) for c in s.columns))


@query("""select conv_id as query_id, round(avg(case when 'g' || (turn % 3) <> 'g' || (conv_id % 3) then 1.0::double else 0 end), 6) as other_share, bool_or(turn = conv_id % 5) as probe_hit from conversations group by 1""")
def retrieval_diagnostics(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.concat(F.lit("g"), (F.col("turn") % 3).cast("string")).alias("group"), F.concat(F.lit("g"), (F.col("conv_id") % 3).cast("string")).alias("own_group"), (F.col("turn") == F.col("conv_id") % 5).alias("probe"))
    return evaluate.diagnostics(rows).withColumn("other_share", F.round("other_share", 6))

"""Queries of the training-data operators: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import byte_bpe, exact_dedup, jaccard_join, license_scan, packing, pseudonyms, quality_model, quality_rules, sharding, token_store


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(_documents(spark, sf_dir), token_store.StoreOptions(_path("byte_bpe_50k.json")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_digest(_documents(spark, sf_dir), _path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_documents(spark, sf_dir), 16)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _path("byte_bpe_50k.json"), 2048)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.findings(_documents(spark, sf_dir), pseudonyms.session_key(spark))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (op1_quality_model, op2_token_store, op3_license_scan, op4_quality_rules, op5_byte_bpe, op6_jump_shards, op7_exact_dedup, op8_best_fit_packing, op9_pseudonyms, op10_jaccard_join)}


def _rules_sql() -> str:
    """The counts, sketches and fences of the quality rules as SQL."""
    r = quality_rules
    rates = " union all ".join(f"select doc_id, lang, source, '{m}' as metric, {top} * 1000 // greatest({below}, 1) as v from c" for m, top, below, _, _ in r.METRICS)
    slack = "case metric " + " ".join(f"when '{m}' then {s}" for m, _, _, s, _ in r.METRICS) + " end"
    both = ", ".join(f"'{m}'" for m, *_, b in r.METRICS if b)
    return rf"""
with w as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
g as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
h as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
p as (select doc_id, count(distinct i + k) as n_repeat_words from h, range(5) r(k) group by 1),
c as (select w.doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(ls)::bigint as n_lines, len(regexp_extract_all(t, '[A-Z]'))::bigint as n_capitals,
  len(regexp_extract_all(t, '[!?]'))::bigint as n_marks from w left join p using (doc_id)),
v as ({rates}),
b as (select *, v - v % (2 ** greatest(length(bin(v)) - {r.PRECISION}, 0))::bigint as bucket from v),
k as (select lang, source, metric, bucket, count(*) as n from b group by all),
l as (select * from (select lang, source, metric, bucket, n, sum(n) over (partition by lang, source, metric) as all_rows from k) where all_rows >= {r.SMALL}
  union all select lang, null, metric, bucket, n, sum(n) over (partition by lang, metric) from (select lang, metric, bucket, sum(n) as n from k group by all)
  union all select null, null, metric, bucket, n, sum(n) over (partition by metric) from (select metric, bucket, sum(n) as n from k group by all)),
u as (select *, sum(n) over (partition by lang, source, metric order by bucket) as upto from l),
q as (select lang, source, metric, max(all_rows) as all_rows, min(bucket) filter (where 4 * upto >= all_rows) as q1, min(bucket) filter (where 4 * upto >= 3 * all_rows) as q3 from u group by all),
f as (select *, q1 - {r.REACH} * greatest(q3 - q1, {slack}) as low, q3 + {r.REACH} * greatest(q3 - q1, {slack}) as high from q),
x as (select v.doc_id, bool_and(v.v <= coalesce(a.high, case when y.all_rows >= {r.SMALL} then y.high end, z.high) and (v.metric not in ({both}) or v.v >= coalesce(a.low, case when y.all_rows >= {r.SMALL} then y.low end, z.low))) as inside
  from v left join f a on a.lang = v.lang and a.source = v.source and a.metric = v.metric left join f y on y.lang = v.lang and y.source is null and y.metric = v.metric
  join f z on z.lang is null and z.metric = v.metric group by 1),
j as (select *, n_words < {r.MIN_WORDS} or 100 * n_repeat_words > {r.REPEAT_PERCENT} * n_words as base_failed from c)
select j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and inside as kept from j join x using (doc_id)"""


_COMPONENTS_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
l as (select a, b from e union all select b, a from e),
r as (select doc_id as a, doc_id as b from w union select r.a, l.b from r join l on l.a = r.b)
select w.doc_id, coalesce(n.n, 0) as n_shingles, min(r.b) as component_id from w join r on r.a = w.doc_id left join n on n.doc_id = w.doc_id group by all"""

ORACLE_SQL = {
    "op7_exact_dedup": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept,
       sha256(t) as text_sha256
from t window w as (partition by t)""",
    "op4_quality_rules": _rules_sql(),
    "op10_jaccard_join": _COMPONENTS_SQL,
}

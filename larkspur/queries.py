"""Registered queries over the driver's tables, each with the SQL it is held against where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as t
from larkspur.functions import vectors as v
from larkspur.operators import answers, chunking, conformance, deid, editions, evaluate, findings, index, layout, search
from larkspur.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from larkspur.registry import table as _table
from larkspur.sources import extract

def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors as items; the stated query set, ids divisible by 50."""
    e = _table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), "embedding", "label"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("q_label"))


_SCORED = """scored as (select q.vec_id as query_id, d.vec_id as item_id, d.label, q.label as q_label,
  list_cosine_similarity(d.embedding::double[], q.embedding::double[]) as score
  from embeddings d, embeddings q where q.vec_id % 50 = 0)"""


# --- search ----------------------------------------------------------------------------------------------------


@query(f"""with {_SCORED}, r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from scored)
select query_id, item_id, round(score, 5) as score, rank from r where rank <= 10""")
def vector_topk(spark, sf):
    items, q = _vectors(spark, sf)
    return search.cosine_topk(items, q.select("query_id", "embedding"), 10).withColumn("score", F.round("score", 5))


@query(f"""with {_SCORED}, r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from scored where label = q_label)
select query_id, item_id, round(score, 5) as score, rank from r where rank <= 5""")
def vector_topk_filtered(spark, sf):
    items, q = _vectors(spark, sf)
    return search.cosine_topk(items, q, 5, same=("label", "q_label")).withColumn("score", F.round("score", 5))


@query()
def vector_ann(spark, sf):
    items, q = _vectors(spark, sf)
    return search.cell_topk(items, q.select("query_id", "embedding"), 10)


def _rankings(spark, sf):
    items, q = _vectors(spark, sf)
    ranked = search.cosine_topk(items, q.select("query_id", "embedding"), 20)
    order = Window.partitionBy("query_id").orderBy(F.abs(F.col("item_id") - F.col("query_id")), "item_id")
    other = items.select("item_id").join(F.broadcast(q.select("query_id")), F.abs(F.col("item_id") - F.col("query_id")) <= 10).withColumn("rank", F.row_number().over(order))
    return ranked, other


_RANKINGS = f"""{_SCORED}, a as (select * from (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as vec_rank from scored) where vec_rank <= 20),
b as (select query_id, item_id, row_number() over (partition by query_id order by abs(item_id - query_id), item_id) as lex_rank from scored where abs(item_id - query_id) <= 10)"""


@query(f"""with {_RANKINGS}, f as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.item_id, b.item_id) as item_id, vec_rank, lex_rank,
  coalesce(1.0::double / (60 + vec_rank), 0) + coalesce(1.0::double / (60 + lex_rank), 0) as rrf from a full join b on a.query_id = b.query_id and a.item_id = b.item_id),
r as (select *, row_number() over (partition by query_id order by rrf desc, vec_rank nulls last, lex_rank nulls last) as rank from f)
select query_id, item_id, coalesce(vec_rank, 0) as vec_rank, coalesce(lex_rank, 0) as lex_rank, round(rrf, 8) as rrf, rank from r where rank <= 10""")
def rrf_fusion(spark, sf):
    return search.fuse(*_rankings(spark, sf), 10).withColumn("rrf", F.round("rrf", 8)).fillna(0, ["vec_rank", "lex_rank"])


@query(f"""with {_RANKINGS}, s as (select *, (item_id * 37 % 101) / 100.0::double as rerank_score from a),
r as (select *, row_number() over (partition by query_id order by rerank_score desc, vec_rank) as rank from s), k as (select * from r where rank <= 5),
g as (select query_id, max(score) as best from a group by 1), h as (select query_id, max(rerank_score) as top from k group by 1)
select k.query_id, k.item_id, k.rank, round(1 / (1 + exp(-k.rerank_score)), 6) as probability from k join g using (query_id) join h using (query_id) where best >= 0.45 and top >= 0.9""")
def rerank_gate(spark, sf):
    ranked, _ = _rankings(spark, sf)
    scores = ranked.select("query_id", "item_id", (F.col("item_id") * 37 % 101 / 100.0).alias("rerank_score"))
    best = search.gate_by_rerank(search.rerank(ranked, scores, 5), ranked, 0.45, 0.9)
    return best.select("query_id", "item_id", "rank", F.round(v.sigmoid(F.col("rerank_score")), 6).alias("probability"))


@query(f"with {_RANKINGS} select query_id, item_id, round(score, 5) as score from a where score >= 0.45")
def evidence_gate(spark, sf):
    return search.gate_by_score(_rankings(spark, sf)[0]).select("query_id", "item_id", F.round("score", 5).alias("score"))


_MARGIN = """pairs as (select q.vec_id as query_id, e.label = 0 as positive, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score
  from embeddings q, embeddings e where e.vec_id < 80 and {where}),
ranked as (select *, row_number() over (partition by query_id, positive order by score desc) as r from pairs),
m as (select query_id, coalesce(avg(score) filter (where positive), 0) - coalesce(avg(score) filter (where not positive), 0) as margin from ranked where r <= 3 group by 1)"""


def _exemplars(spark, sf):
    """A stated list of exemplars: the first 80 vectors, label 0 against the rest."""
    return _table(spark, sf, "embeddings").where("vec_id < 80").select(F.col("vec_id").alias("item_id"), "embedding", (F.col("label") == 0).alias("positive"))


@query(f"with {_MARGIN.format(where='true')} select query_id, round(margin, 5) as margin, margin >= 0.056 as out_of_scope from m")
def scope_margin(spark, sf):
    q = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.margins(q, _exemplars(spark, sf)).select("query_id", F.round("margin", 5).alias("margin"), (F.col("margin") >= 0.056).alias("out_of_scope"))


@query(f"""with {_MARGIN.format(where='q.vec_id < 80 and q.vec_id <> e.vec_id')}, t as (select m.margin, e.label = 0 as positive from m join embeddings e on e.vec_id = m.query_id),
d as (select margin, lead(margin) over (order by margin) as next from (select distinct margin from t)), c as (select (margin + next) / 2 as threshold from d where next is not null),
j as (select threshold, (count(*) filter (where positive and margin >= threshold))::double / nullif(count(*) filter (where positive), 0) - (count(*) filter (where not positive and margin >= threshold))::double / nullif(count(*) filter (where not positive), 0) as j from c, t group by 1)
select round(threshold, 5) as threshold, round(j, 5) as j from j order by round(j, 9) desc, threshold limit 1""")
def margin_tuning(spark, sf):
    own = _exemplars(spark, sf)
    m = search.margins(own.select(F.col("item_id").alias("query_id"), "embedding"), own, leave_out=True)
    scored = m.join(own.select(F.col("item_id").alias("query_id"), "positive"), "query_id")
    return search.tune_margin(scored).select(F.round("threshold", 5).alias("threshold"), F.round("j", 5).alias("j"))


@query("""with e as (select vec_id, embedding[1:16] as h from embeddings), n as (select vec_id, h, sqrt(list_sum(list_transform(h, lambda y: y::double * y::double))) as n from e)
select vec_id, k, round(h[k + 1]::double / n, 5) as value from n, range(16) r(k)""")
def truncated_vectors(spark, sf):
    short = _table(spark, sf, "embeddings").select("vec_id", F.posexplode(v.truncate(F.col("embedding"), 16)).alias("k", "value"))
    return short.select("vec_id", F.col("k").cast("long").alias("k"), F.round("value", 5).alias("value"))


@query("""with d as (select doc_id, lower(text) as s from documents), b as (select item_id, lower(text) as s from benchmark),
f as (select 'd' as k, doc_id as id, s from d union all select 'b', item_id, s from b),
w as (select k, id, unnest(list_filter(regexp_split_to_array(s, '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as w from f),
g as (select distinct k, id, substr('  ' || w || ' ', i, 3) as g from (select *, unnest(range(1, length(w) + 2)) as i from w)),
n as (select k, id, count(*) as n from g group by all),
p as (select x.id as doc_id, y.id as item_id, count(*) as both from g x join g y on x.g = y.g where x.k = 'd' and y.k = 'b' group by all)
select p.doc_id, p.item_id, round(p.both::double / (a.n + c.n - p.both), 6) as similarity from p join n a on a.k = 'd' and a.id = p.doc_id join n c on c.k = 'b' and c.id = p.item_id
where p.both::double / (a.n + c.n - p.both) >= 0.3""")
def trigram_similarity(spark, sf):
    d = _table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    b = _table(spark, sf, "benchmark").select("item_id", t.trigrams(F.col("text")).alias("b"))
    return search.trigram_passages(d, b, 0.3, passages=()).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


@query()
def trigram_similarity_whole(spark, sf):
    """The best similarity of each document of any length, or of a piece of it, with each benchmark text."""
    d = _table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    b = _table(spark, sf, "benchmark").select("item_id", t.trigrams(F.col("text")).alias("b"))
    return search.trigram_passages(d, b, 0.3).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


# --- chunks, sections, layout ----------------------------------------------------------------------------------


def _sectioned(spark, sf):
    section = "array(named_struct('text', text, 'page_number', cast(null as int), 'section_title', cast(null as string), 'page_spans', cast(null as array<struct<offset:int,page:int>>)))"
    return _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.expr(section).alias("sections"))


@query(r"""with recursive d as (select doc_id, coalesce(text, '') as t from documents),
e as (select doc_id, t, 0::bigint as s, 0::bigint as stop, false as done from d where false
  union all select doc_id, t, s, stop, done from (select doc_id, t, 0::bigint as s, -1::bigint as stop, length(t) = 0 as done from d)
  union all select doc_id, t, case when stop < 0 then 0 else next end, z, z >= length(t) from (
    select doc_id, t, stop, next, case when length(t) - b <= 1000 then length(t) else coalesce(
      case when strpos(r, chr(10) || chr(10)) > 0 then b + 1000 - strpos(r, chr(10) || chr(10)) + 1 end, case when strpos(r, chr(10)) > 0 then b + 1000 - strpos(r, chr(10)) + 1 end,
      case when strpos(r, ' .') > 0 then b + 1000 - strpos(r, ' .') + 1 end, case when strpos(r, ' .다') > 0 then b + 1000 - strpos(r, ' .다') + 1 end, case when strpos(r, ' ') > 0 then b + 1000 - strpos(r, ' ') + 1 end, b + 1000) end as z
    from (select *, reverse(substr(t, b + 801, 200)) as r from (select *, case when stop < 0 then 0 else next end as b from (
      select *, case when i > 0 and f + i < stop then f + i when j > 0 and f + j < stop then f + j else f end as next from (
        select *, strpos(v, chr(10)) as i, strpos(v, ' ') as j from (select *, substr(t, f + 1, stop - f) as v from (select *, greatest(stop - 150, s + 1) as f from e where not done))))))) ),
p as (select doc_id, s, substr(t, s + 1, stop - s) as raw from e where stop > 0),
q as (select doc_id, s + length(raw) - length(regexp_replace(raw, '^\s+', '')) as start, regexp_replace(raw, '^\s+|\s+$', '', 'g') as text from p where regexp_matches(raw, '\S'))
select doc_id::varchar as document_id, row_number() over (partition by doc_id order by start) - 1 as chunk_index, start, text from q""")
def chunk_documents(spark, sf):
    return chunking.chunk_sections(_sectioned(spark, sf)).select("document_id", "chunk_index", "start", "text")


@query()
def html_sections(spark, sf):
    files = _table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.lit("html").alias("file_type"), F.col("html").cast("binary").alias("content"))
    got = extract.extract_sections(files)
    return got.select("document_id", "error_type", F.size("sections").alias("n"), F.array_join(F.transform("sections", lambda s: s["text"]), "\n\n").alias("text"))


_LINES = "l as (select source as document_id, doc_id as page, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, unnest(string_split(text, chr(10))) as line from documents)"


def _lines(spark, sf):
    d = _table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d


@query(rf"""with {_LINES}, k as (select *, regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '\d+', '#', 'g') as key from l),
f as (select *, row_number() over (partition by document_id, page order by line_no) as up, row_number() over (partition by document_id, page order by line_no desc) as down from k where key <> ''),
e as (select *, up <= 3 or down <= 3 as edge from f), n as (select document_id, count(distinct page) as pages from l group by 1),
r as (select document_id, key from e join n using (document_id) where edge group by document_id, key, pages having count(distinct page) >= greatest(3, floor(0.01 * pages)))
select document_id, page, line_no, line from e where not (edge and exists (select 1 from r where r.document_id = e.document_id and r.key = e.key)) and not regexp_matches(line, '^\s*[-–]?\s*\d{{1,4}}\s*[-–]?\s*$')""")
def running_lines(spark, sf):
    return layout.without_running_lines(_lines(spark, sf), 0.01)


@query(r"""with w as (select doc_id, row_number() over (partition by doc_id order by i) as i, x from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
f as (select doc_id, i, string_split(x, ' ') as c from w)
select doc_id, i, case when len(c) = 3 then array_to_string(list_filter(['a: ' || c[1], 'b: ' || c[2], 'c: ' || c[3]], lambda y: length(y) > 3), '; ') else array_to_string(list_filter(c, lambda y: y <> ''), ' | ') end as line from f""")
def table_rows(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    return d.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), t.row_line(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.split("x", " ")).alias("line"))


#: Beginnings and titles of synthetic lines; every line of events takes one of each, and the next line follows it.
_HEADS = ("", "1 ", "1. ", "{a}.{b} ", "{a}.{b}.{c}. ", "123.4 ", "I. ", "XIV. ", "IIX. ", "Ⅳ. ", "A. ", "K. ", "APPENDIX B: ", "Annex 2 ", "appendix C ", "부록 3 ", "제{a}장 ", "제 {a} 절. ", "Table {a}-{b}. ", "TABLE 2 ", "가. ", "차. ")
_TITLES = (
    "Background", "Order Status Review", "the visit was moved", "Visits should be made", "Ends here.", "Ends with colon:", "November 2023", "B1-2006-2-001 2006.01", "임상시험의 실시", "기록, 및 보고", "보고한다", "(Optional) forms",
    "Words " * 13, "Contents . . . . . . 12", "Title……", "4 arms of a trial", "A Very Long Heading Whose Characters Alone Already Go Beyond What Any Title May Have In All",
)
_HEAD_ROWS = ", ".join(f"({k}, '{h}')" for k, h in enumerate(_HEADS))
_TITLE_ROWS = ", ".join(f"({k}, '{x}')" for k, x in enumerate(_TITLES))


def _plausible_sql(may_end: str) -> str:
    return rf"""(length(x) <= 80 and len(string_split(x, ' ')) <= 12 and len(regexp_extract_all(x, '\p{{Nd}}')) <= len(regexp_extract_all(x, '\p{{L}}')) and ({may_end} or not regexp_matches(x, '(?:[.;,:]|다|음|함|임)\s*$'))
 and not contains(' ' || x || ' ', ' should ') and not regexp_matches(x, '(?i)^(?:january|february|march|april|may|june|july|august|september|october|november|december)\b') and regexp_matches(x, '^[\p{{Lu}}\p{{Nd}}가-힣(“"]'))"""


def _headings_sql() -> str:
    """Titles are what follows the pattern's fixed part, taken by removing it, where Spark's side takes the pattern's group."""
    kinds = (
        ("division", r"^제\s*\d+\s*[편장]\.?\s*", "true", "(x = '' or {ok})", "1"),
        ("section", r"^제\s*\d+\s*절\.?\s*", "true", "(x = '' or {ok})", "2"),
        ("appendix", r"^(?:APPENDIX|Appendix|ANNEX|Annex|부록)\s*[A-Z0-9IVX]*\s*[:.\-–]?\s*", "true", "(x = '' or {end}) and (regexp_matches(y, '^(?:Appendix|Annex|부록)') or split_part(y, ' ', 1) = upper(split_part(y, ' ', 1)))", "1"),
        ("table", r"^Table\s+(?:\d{1,3}(?:[.\-]\d{1,3})*|[A-Z]\d{0,2}(?:[.\-]\d{1,3})*)[.:]?\s+", "x <> ''", "{any} and not regexp_matches(x, '^[0-9]')", "9"),
        ("roman", r"^(?:X{0,3}(?:IX|IV|V?I{1,3})|X{1,3}|V|IV|IX|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ])\.\s+", "x <> ''", "{ok}", "1"),
        ("letter", r"^[A-H]\.\s+", "regexp_matches(x, '^[A-Z]')", "{any} and len(string_split(x, ' ')) <= 10", "2"),
        ("decimal", r"^\d{1,2}(?:\.\d{1,2}){0,4}\.?\s+", "x <> ''", r"{ok} and not (regexp_matches(x, '^[가-힣]') and regexp_matches(y, '^\d+\s'))", r"1 + len(string_split(regexp_extract(y, '^(\d{1,2}(?:\.\d{1,2}){0,4})', 1), '.'))"),
        ("item", r"^[가나다라마바사아자차카타파하]\.\s+", "x <> ''", "{ok} and length(x) <= 25 and not contains(x, ',')", "6"),
    )
    tests = {"ok": _plausible_sql("false"), "any": _plausible_sql("true"), "end": _plausible_sql("suffix(x, ':')")}
    parts = []
    for k, (kind, head, fits, ok, level) in enumerate(kinds):
        rule = ok
        for name, sql in tests.items():
            rule = rule.replace("{" + name + "}", sql)
        parts.append(f"select id, {k} as ord, '{kind}' as kind, {level} as level, {rule} as ok from (select id, y, trim(regexp_replace(y, '{head}', '')) as x from z where regexp_matches(y, '{head}')) where {fits}")
    return rf"""with h(k, head) as (values {_HEAD_ROWS}), g(k, title) as (values {_TITLE_ROWS}),
l as (select event_id as id, user_id, replace(replace(replace(head, '{{a}}', (1 + event_id % 12)::varchar), '{{b}}', (1 + event_id % 5)::varchar), '{{c}}', (1 + event_id % 3)::varchar) || title as line from events join h on h.k = event_id % {len(_HEADS)} join g on g.k = event_id // {len(_HEADS)} % {len(_TITLES)}),
n as (select id, trim(regexp_replace(line, '\s+', ' ', 'g')) as y, coalesce(lead(trim(line)) over (partition by user_id order by id), '') as following from l),
z as (select id, y from n where y <> '' and length(y) <= 92 and not regexp_matches(following, '^[a-z]') and not regexp_matches(y, '(?:\.\s?){{5,}}|(?:·\s?){{5,}}|(?:…\s?){{2,}}|(?:‥\s?){{3,}}')),
u as ({" union all ".join(parts)}), f as (select * from (select *, row_number() over (partition by id order by ord) as first from u) where first = 1)
select id, kind, level::bigint as level from f where ok"""


@query(_headings_sql())
def heading_detection(spark, sf):
    k = F.col("event_id")
    one = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    line = F.concat(one(_HEADS, k % len(_HEADS)), one(_TITLES, F.floor(k / len(_HEADS)) % len(_TITLES)))
    for mark, n in (("{a}", 12), ("{b}", 5), ("{c}", 3)):
        line = F.replace(line, F.lit(mark), (1 + k % n).cast("string"))
    rows = _table(spark, sf, "events").select(k.alias("id"), "user_id", line.alias("line"))
    rows = rows.withColumn("next", F.lead("line").over(Window.partitionBy("user_id").orderBy("id"))).withColumn("kind", t.heading_kind(F.col("line"), F.col("next")))
    return rows.where("kind is not null").select("id", "kind", t.heading_level(F.col("line"), F.col("kind")).cast("long").alias("level"))


_EVENT_HEADINGS = "h as (select user_id::varchar as document_id, event_id as line_no, 1 + event_id % 4 as level, event_type || event_id as title from events)"


@query(f"""with {_EVENT_HEADINGS}, a as (select *, max(case when level = 1 then line_no end) over w as l1, max(case when level = 2 then line_no end) over w as l2, max(case when level = 3 then line_no end) over w as l3, max(case when level = 4 then line_no end) over w as l4 from h window w as (partition by document_id order by line_no)),
b as (select *, l1 as o1, case when level >= 2 and l2 > coalesce(l1, -1) then l2 end as o2, case when level >= 3 and l3 > greatest(coalesce(l1, -1), coalesce(l2, -1)) then l3 end as o3, case when level >= 4 then l4 end as o4 from a),
p as (select document_id, line_no, list_filter([o1, o2, o3, o4], lambda x: x is not null) as o from b),
u as (select document_id, line_no, unnest(o[greatest(len(o) - 2, 1):]) as x from p)
select u.document_id, u.line_no, string_agg(h.title, ' > ' order by x) as path from u join h on h.line_no = u.x group by all""")
def heading_paths(spark, sf):
    h = _table(spark, sf, "events").select(F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("line_no"), (1 + F.col("event_id") % 4).alias("level"), F.concat("event_type", F.col("event_id").cast("string")).alias("title"))
    return layout.heading_paths(h, 4).select("document_id", "line_no", "path")


# --- index -----------------------------------------------------------------------------------------------------


def _files(spark, sf):
    return _table(spark, sf, "documents").select(F.col("source").alias("corpus"), F.format_string("%08d.txt", "doc_id").alias("path"), F.format_string("%08d.txt", "doc_id").alias("rel_path"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), "lang")


_FILES = "f as (select source as corpus, format('{:08d}.txt', doc_id) as path, sha256(text) as checksum, lang from documents)"


@query(f"with {_FILES} select corpus, sha256(string_agg(path || ':' || checksum, chr(10) order by path || ':' || checksum) || chr(10)) as corpus_hash, count(*) as files from f group by 1")
def corpus_hash(spark, sf):
    return index.corpus_hash(_files(spark, sf))


@query(f"with {_FILES} select path, checksum, nullif(min(path) over (partition by checksum), path) as duplicate_of from f")
def run_duplicates(spark, sf):
    return index.mark_duplicates(_files(spark, sf)).select("path", "checksum", "duplicate_of")


_STORE = f"""{_FILES}, d as (select checksum, min(corpus) as corpus, min(lang) as classification, min(path) as edition from f group by 1),
n as (select * from d where not suffix(edition, '3.txt')),
s as (select checksum, case when suffix(edition, '5.txt') then 'old' else corpus end as corpus, classification, edition, case when suffix(edition, '1.txt') then 'FAILED' else 'INDEXED' end as status, case when suffix(edition, '2.txt') then 'm0' else 'm1' end as embedding_model from d where not suffix(edition, '4.txt'))"""


@query(f"""with {_STORE} select coalesce(n.checksum, s.checksum) as checksum, case when n.checksum is null then s.corpus else n.corpus end as corpus,
case when n.checksum is null then 'keep' when s.checksum is null then 'insert' when s.status = 'FAILED' or s.embedding_model <> 'm1' then 'reprocess' when n.corpus = s.corpus then 'keep' else 'retag' end as action
from n full join s on n.checksum = s.checksum""")
def register_files(spark, sf):
    d = _files(spark, sf).groupBy("checksum").agg(F.min("corpus").alias("corpus"), F.min("lang").alias("classification"), F.min("path").alias("edition"))
    ends = lambda x: F.endswith("edition", F.lit(x))
    store = d.where(~ends("4.txt")).withColumn("corpus", F.when(ends("5.txt"), "old").otherwise(F.col("corpus"))).withColumn("status", F.when(ends("1.txt"), "FAILED").otherwise("INDEXED")).withColumn("embedding_model", F.when(ends("2.txt"), "m0").otherwise("m1"))
    return index.register(d.where(~ends("3.txt")), store, "m1").select("checksum", "corpus", "action")


def _documents(spark, sf):
    d = _table(spark, sf, "documents")
    status = F.when(F.col("doc_id") % 7 == 0, "FAILED").when(F.col("doc_id") % 11 == 0, "SKIPPED_DUPLICATE").otherwise("INDEXED")
    return d.select(F.col("doc_id").alias("document_id"), F.col("source").alias("corpus"), F.col("lang").alias("classification"), status.alias("status"), F.ceil(F.col("n_chars") / 1000).alias("chunk_count"), F.when(F.col("doc_id") % 14 == 0, "CORRUPTED_FILE").alias("error_type"))


_DOCS = "d as (select doc_id as document_id, source as corpus, lang as classification, case when doc_id % 7 = 0 then 'FAILED' when doc_id % 11 = 0 then 'SKIPPED_DUPLICATE' else 'INDEXED' end as status, ceil(n_chars / 1000.0)::bigint as chunk_count, case when doc_id % 14 = 0 then 'CORRUPTED_FILE' end as error_type from documents)"


@query(f"with {_DOCS} select count(*) as total, count(*) filter (where status = 'INDEXED') as indexed, count(*) filter (where status = 'FAILED') as failed, count(*) filter (where status = 'SKIPPED_DUPLICATE') as skipped_duplicate from d")
def job_summary(spark, sf):
    return index.job_summary(_documents(spark, sf))


@query(f"with {_DOCS} select document_id, 'FAILED' as status, case when status = 'FAILED' and error_type is not null then error_type else 'REINDEX_REQUIRED' end as error_type, 0 as chunk_count from d")
def reset_index(spark, sf):
    return index.reset(_documents(spark, sf)).select("document_id", "status", "error_type", "chunk_count")


@query(f"with {_DOCS} select corpus, classification, count(*) as documents, coalesce(sum(chunk_count), 0)::bigint as chunks from d where status = 'INDEXED' group by all")
def corpora_rollup(spark, sf):
    return index.corpora(_documents(spark, sf))


@query("select coalesce(d.source, '(none)') as corpus, count(*) as chunks from embeddings e left join documents d on d.doc_id = e.vec_id group by 1")
def chunks_by_corpus(spark, sf):
    chunks = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"))
    return index.chunks_by_corpus(chunks, _documents(spark, sf))


@query(f"with {_DOCS} select corpus, bool_or(classification not in ('en', 'de')) as blocked from d group by 1")
def blocked_corpora(spark, sf):
    return answers.blocked_corpora(_documents(spark, sf), ("en", "de"))


# --- editions --------------------------------------------------------------------------------------------------

_EDITIONS = """e as (select o_orderkey as id, o_orderpriority as corpus, 'f' || (o_custkey % 50) as family, case when o_orderkey % 5 <> 0 then [1 + o_orderkey % 3, o_orderkey % 4] end as ver, case when o_orderkey % 3 = 0 then [o_orderkey % 6] end as rev, o_orderdate as date, o_orderkey % 4 = 0 as manifest, o_orderkey % 13 = 0 as superseded from orders),
p as (select *, not superseded or not bool_or(not superseded) over (partition by corpus, family) as pool from e),
k as (select distinct corpus, family, ver, rev, case when manifest then date end as date, manifest from p where pool),
old as (select distinct a.corpus, a.family, a.ver, a.rev, a.date, a.manifest from k a join k b on a.corpus = b.corpus and a.family = b.family where
 case when b.ver is not null and a.ver is not null and b.ver <> a.ver then b.ver > a.ver when b.rev is not null and a.rev is not null and b.rev <> a.rev then b.rev > a.rev else b.manifest and a.manifest and b.date > a.date end)"""


@query(f"""with {_EDITIONS} select p.id as document_id, p.pool and o.corpus is null as is_latest from p left join old o on o.corpus = p.corpus and o.family = p.family and o.ver is not distinct from p.ver and o.rev is not distinct from p.rev and o.manifest = p.manifest and o.date is not distinct from (case when p.manifest then p.date end)""")
def latest_editions(spark, sf):
    o = _table(spark, sf, "orders")
    k = F.col("o_orderkey")
    version = F.struct(F.when(k % 5 != 0, F.array((1 + k % 3).cast("int"), (k % 4).cast("int"))).alias("ver"), F.when(k % 3 == 0, F.array((k % 6).cast("int"))).alias("rev"), F.lit(None).cast("array<int>").alias("amd"))
    docs = o.select(k.alias("document_id"), F.col("o_orderpriority").alias("corpus"), F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("family"), version.alias("version"), F.when(k % 4 == 0, F.col("o_orderdate")).alias("date"), (k % 4 == 0).alias("manifest"), (k % 13 == 0).alias("superseded"))
    return editions.latest(docs).select("document_id", "is_latest")


# --- answers ---------------------------------------------------------------------------------------------------

_ANSWERS = "a as (select conv_id, turn, text || ' [' || (turn % 4) || '] and [' || (conv_id % 7) || '][2]' as answer, (turn % 5)::int as n from conversations)"


def _answers(spark, sf):
    mark = lambda c: F.col(c).cast("string")
    made = F.concat("text", F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("] and ["), (F.col("conv_id") % 7).cast("string"), F.lit("][2]"))
    return _table(spark, sf, "conversations").select("conv_id", "turn", made.alias("answer"), (F.col("turn") % 5).cast("int").alias("n"))


@query(rf"""with {_ANSWERS}, x as (select *, list_transform(regexp_extract_all(answer, '\[(\d{{1,2}})\]', 1), lambda i: i::int - 1) as m from a),
y as (select conv_id, turn, list_filter(m, lambda i: i >= 0 and i < n) as m from x)
select conv_id, turn, array_to_string(list_filter(m, lambda i, k: list_position(m, i) = k), ',') as cited from y""")
def citations(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", F.array_join(t.citations(F.col("answer"), F.col("n")).cast("array<string>"), ",").alias("cited"))


@query(f"""with {_RANKINGS}, e as (select query_id, vec_rank as rank, 'vec ' || item_id as label, 'text ' || item_id as text from a where vec_rank <= 3)
select query_id, string_agg('[' || rank || '] source: ' || label || chr(10) || text, chr(10) || chr(10) order by rank) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: q' || query_id as prompt from e group by 1""")
def rag_prompts(spark, sf):
    ranked, _ = _rankings(spark, sf)
    e = ranked.where("rank <= 3").select("query_id", "rank", F.concat(F.lit("vec "), F.col("item_id").cast("string")).alias("label"), F.concat(F.lit("text "), F.col("item_id").cast("string")).alias("text"))
    return answers.prompts(e, e.select("query_id").distinct().select("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("question")))


@query("""select conv_id, turn, hangul, letters_share from (select conv_id, turn, regexp_matches(text, '[가-힣]') as hangul, round(len(regexp_extract_all(text, '[가-힣]'))::double / greatest(len(regexp_extract_all(text, '[\\p{L}]')), 1), 6) as letters_share from (select conv_id, turn, text || case when conv_id % 3 = 0 then ' 이 결과는' when conv_id % 3 = 1 then ' [1] 가 12' else '' end as text from conversations))""")
def question_language(spark, sf):
    text = F.concat("text", F.when(F.col("conv_id") % 3 == 0, " 이 결과는").when(F.col("conv_id") % 3 == 1, " [1] 가 12").otherwise(""))
    return _table(spark, sf, "conversations").withColumn("text", text).select("conv_id", "turn", F.rlike("text", F.lit(t.HANGUL)).alias("hangul"), F.round(t.hangul_ratio(F.col("text")), 6).alias("letters_share"))


@query(r"""select b.item_id, count(*) filter (where contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(b.text, '\s+', ' ', 'g')))) > 0 as found from benchmark b, documents d group by 1""")
def evidence_locator(spark, sf):
    quotes = _table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("corpus").alias("file"), F.col("text").alias("quote"))
    sections = _table(spark, sf, "documents").select(F.lit("corpus").alias("file"), "text")
    even = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    hit = evaluate.sought(sections.select(even("text").alias("t")), quotes.select("id", even("quote").alias("q"))).select("id").distinct().withColumn("found", F.lit(True))
    return quotes.join(hit, "id", "left").select(F.col("id").alias("item_id"), F.coalesce("found", F.lit(False)).alias("found"))


# --- evaluation ------------------------------------------------------------------------------------------------

_OUT = """o as (select event_id as id, event_type as type, case when user_id % 2 = 0 then 'ko' else 'en' end as lang, event_id % 4 <> 0 as answerable, event_id % 6 = 0 as refused, event_id % 3 <> 0 as hit, event_id % 5 <> 0 as section_hit, event_id % 7 <> 0 as citation_correct, value as retrieval_ms, case when event_id % 50 = 0 then 'timeout' end as error, (event_id * 7919 % 1000) / 1000.0::double as score from events)"""


def _outcomes(spark, sf):
    k = F.col("event_id")
    return _table(spark, sf, "events").select(k.alias("id"), F.col("event_type").alias("type"), F.when(F.col("user_id") % 2 == 0, "ko").otherwise("en").alias("lang"), (k % 4 != 0).alias("answerable"), (k % 6 == 0).alias("refused"), (k % 3 != 0).alias("hit"), (k % 5 != 0).alias("section_hit"), (k % 7 != 0).alias("citation_correct"), F.col("value").alias("retrieval_ms"), F.when(k % 50 == 0, "timeout").alias("error"), (k * 7919 % 1000 / 1000.0).alias("score"))


_R = lambda part, whole: f"round((count(*) filter (where ({part}) and ({whole})))::double / nullif(count(*) filter (where {whole}), 0), 6)"


@query(f"""with {_OUT} select case when grouping(type) = 1 and grouping(lang) = 1 then 'all' when grouping(type) = 0 then 'type' else 'lang' end as level, type, lang, count(*) as questions, count(*) filter (where error is not null) as errors,
{_R('hit', 'error is null and answerable')} as hit_rate, {_R('section_hit', 'error is null and answerable')} as section_hit_rate, {_R('citation_correct', 'error is null and answerable and not refused')} as citation_accuracy,
{_R('refused', 'error is null and not answerable')} as refusal_accuracy, {_R('refused', 'error is null and answerable')} as false_refusal_rate,
round(quantile_cont(retrieval_ms, 0.5), 4) as retrieval_p50, round(quantile_cont(retrieval_ms, 0.95), 4) as retrieval_p95 from o group by grouping sets ((), (type), (lang))""")
def outcome_summary(spark, sf):
    s = evaluate.summarize(_outcomes(spark, sf))
    rates = ("hit_rate", "section_hit_rate", "citation_accuracy", "refusal_accuracy", "false_refusal_rate")
    return s.select("level", "type", "lang", "questions", "errors", *(F.round(c, 6).alias(c) for c in rates), F.round("retrieval_p50", 4).alias("retrieval_p50"), F.round("retrieval_p95", 4).alias("retrieval_p95"))


@query(f"""with {_OUT} select id, array_to_string(list_filter([case when error is not null then 'error' end, case when answerable and refused then 'refused' end, case when not answerable and not refused then 'answered' end, case when answerable and not hit then 'missed' end, case when answerable and not refused and not citation_correct then 'citation' end], lambda x: x is not null), ',') as reasons from o
where error is not null or (answerable and refused) or (not answerable and not refused) or (answerable and not hit) or (answerable and not refused and not citation_correct)""")
def failed_questions(spark, sf):
    return evaluate.failed(_outcomes(spark, sf))


@query("""with c as (select lang, quality = 1 as truth, n_chars > 1000 as predicted from documents join labels using (doc_id)),
m as (select lang, count(*) filter (where truth and predicted) as tp, count(*) filter (where not truth and predicted) as fp, count(*) filter (where truth and not predicted) as fn, count(*) filter (where not truth and not predicted) as tn from c group by 1)
select lang, tp, fp, fn, tn, round(tp::double / nullif(tp + fp, 0), 6) as precision, round(tp::double / nullif(tp + fn, 0), 6) as recall, round(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 6) as f1, round((tp + tn)::double / nullif(tp + fp + fn + tn, 0), 6) as accuracy, round(fp::double / nullif(fp + tn, 0), 6) as false_refusal from m""")
def confusion_matrix(spark, sf):
    rows = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1000).alias("predicted"))
    c = evaluate.confusion(rows, ["lang"])
    return c.select("lang", "tp", "fp", "fn", "tn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "accuracy", "false_refusal")))


@query(f"with {_OUT} select id, case when row_number() over (partition by type order by id) % 2 = 1 then 'dev' else 'test' end as part from o")
def dev_test_split(spark, sf):
    return evaluate.split(_outcomes(spark, sf)).select("id", "part")


_REPLAY = f"""{_OUT}, g as (select k / 20.0::double as threshold from range(21) r(k)), p as (select threshold, count(*) filter (where answerable and (refused or score < threshold)) as false_refusals, count(*) filter (where not answerable and (refused or score < threshold)) as right_refusals, count(*) filter (where answerable) as a, count(*) as n from o, g group by 1)"""


@query(f"with {_REPLAY} select threshold, false_refusals, right_refusals, round((a - false_refusals + right_refusals)::double / n, 6) as objective from p")
def threshold_replay(spark, sf):
    return evaluate.replay(_outcomes(spark, sf), [k / 20 for k in range(21)]).withColumn("objective", F.round("objective", 6))


@query(f"with {_REPLAY} select threshold, round((a - false_refusals + right_refusals)::double / n, 6) as objective from p order by 2 desc, 1 limit 1")
def chosen_threshold(spark, sf):
    return evaluate.choose(evaluate.replay(_outcomes(spark, sf), [k / 20 for k in range(21)]).select("threshold", F.round("objective", 6).alias("objective")))


@query(f"with {_OUT} select coalesce(error, 'UNKNOWN') as reason, count(*) as n from o where refused group by 1")
def refusal_reasons(spark, sf):
    return evaluate.refusal_reasons(_outcomes(spark, sf).withColumnRenamed("error", "refusal_reason"))


@query(f"""with {_RANKINGS}, x as (select query_id, list(item_id order by vec_rank) filter (where vec_rank <= 5) as ids from a group by 1), y as (select query_id, list(item_id order by lex_rank) filter (where lex_rank <= 5) as ids from b group by 1)
select count(*) as queries, count(*) filter (where x.ids <> y.ids) as ids_differ, count(*) filter (where list_sort(x.ids) <> list_sort(y.ids)) as files_differ, count(*) filter (where len(y.ids) < 5) as short from x join y using (query_id)""")
def compare_modes(spark, sf):
    lists = lambda r: r.where("rank <= 5").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda s: s["item_id"]).alias("ids")).withColumn("files", F.col("ids"))
    a, b = _rankings(spark, sf)
    return evaluate.compare_modes(lists(a), lists(b), 5)


# --- headers: tag rows made of line items, rules of parts --------------------------------------------------------

_TAGS = """t as (select 'f' || l_orderkey as file, l_linenumber::varchar as path, 0 as depth, 't' || (l_partkey % 12) as tag, 'K' || (l_partkey % 12) as keyword,
 case l_partkey % 4 when 0 then 'DA' when 1 then 'UI' when 2 then 'CS' else 'TM' end as vr, case when l_linenumber % 3 = 0 then 'empty' else 'exists' end as state,
 [case l_partkey % 4 when 0 then strftime(l_shipdate, '%Y%m') || lpad((l_suppkey % 40)::varchar, 2, '0') when 1 then '1.' || lpad((l_suppkey % 20)::varchar, 2, '0') || '.' || l_orderkey when 2 then l_returnflag || repeat('A', (l_suppkey % 20)::int) else lpad((l_suppkey % 30)::varchar, 2, '0') || '30' end] as vals from lineitem)"""


def _tags(spark, sf):
    k, two = F.col("l_partkey"), lambda n: F.lpad((F.col("l_suppkey") % n).cast("string"), 2, "0")
    value = F.when(k % 4 == 0, F.concat(F.date_format("l_shipdate", "yyyyMM"), two(40))).when(k % 4 == 1, F.concat(F.lit("1."), two(20), F.lit("."), F.col("l_orderkey").cast("string"))).when(k % 4 == 2, F.concat("l_returnflag", F.repeat(F.lit("A"), (F.col("l_suppkey") % 20).cast("int")))).otherwise(F.concat(two(30), F.lit("30")))
    return _table(spark, sf, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("file"), F.col("l_linenumber").cast("string").alias("path"), F.lit(0).alias("depth"), F.concat(F.lit("t"), (k % 12).cast("string")).alias("tag"), F.concat(F.lit("K"), (k % 12).cast("string")).alias("keyword"),
        F.when(k % 4 == 0, "DA").when(k % 4 == 1, "UI").when(k % 4 == 2, "CS").otherwise("TM").alias("vr"), F.when(F.col("l_linenumber") % 3 == 0, "empty").otherwise("exists").alias("state"), F.array(value).alias("vals"),
    )


_RULES = [(f"I{i}", f"t{k}", f"K{k}", f"M{m}", m, "M" if m < 3 else "C", conformance.TYPES[(i + k + m) % 5]) for i in range(3) for k in range(0, 12, 1 + i) for m in range(4)]


@query(f"""with {_TAGS}, rules(iod, tag, keyword, module, ord, usage, type) as (values {", ".join(map(str, _RULES))}),
s as (select iod, tag, arg_min(type, list_position(['1', '1C', '2', '2C', '3'], type) * 100 + ord) as type from rules where usage = 'M' group by all),
f as (select 'f' || o_orderkey as file, 'I' || (o_orderkey % 3) as iod from orders), u as (select file, tag, max(state) as state from t group by all),
h as (select f.file, s.tag, s.type, coalesce(u.state, 'absent') as state from f join s using (iod) left join u on u.file = f.file and u.tag = s.tag)
select file, tag, 'L1-TYPE' || type || '-' || upper(state) as code, 1::bigint as n from h where (type = '1' and state <> 'exists') or (type = '2' and state = 'absent')
union all select file, null, 'L1-CONDITIONAL', count(*) from h where type in ('1C', '2C') and state = 'absent' group by 1""")
def header_types(spark, sf):
    rules = spark.createDataFrame(_RULES, "iod string, tag string, keyword string, module string, ord int, usage string, type string")
    files = _table(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"), F.concat(F.lit("I"), (F.col("o_orderkey") % 3).cast("string")).alias("iod"))
    tags = _tags(spark, sf).groupBy("file", "tag").agg(F.max("state").alias("state")).withColumn("depth", F.lit(0))
    return conformance.type_findings(files, tags, rules).select("file", "tag", "code", "n")


@query(rf"""with {_TAGS}, p as (select *, vals[1] as x from t where state = 'exists'),
q as (select *, case vr when 'DA' then case when not regexp_matches(x, '^[0-9]{{8}}$') then 'format' when try_strptime(x, '%Y%m%d') is null then 'calendar' end
 when 'UI' then case when length(x) > 64 then 'length' when regexp_matches(x, '(^|\.)0[0-9]') then 'leading zero' end
 when 'CS' then case when length(trim(x)) > 16 then 'length' when not regexp_matches(x, '^[A-Z0-9 _]*$') then 'characters' end
 else case when not regexp_matches(x, '^([01][0-9]|2[0-3])([0-5][0-9]([0-5][0-9]|60)?)?$') then 'format' end end as problem from p)
select file, path, 'L1-FORMAT-' || vr as code, string_agg(distinct problem, ',' order by problem) as action from q where problem is not null group by file, path, tag, keyword, vr""")
def header_formats(spark, sf):
    return conformance.format_findings(_tags(spark, sf)).select("file", "path", "code", "action")


_PROFILE = [("t0", "X"), ("t1", "Z"), ("t2", "X/Z"), ("t3", "D"), ("t4", "U"), ("t5", "C"), ("t6", "X/Z/D"), ("t7", "X"), ("t1x", "Z")]


@query(f"""with {_TAGS}, rules(tag, basic) as (values {", ".join(map(str, _PROFILE))}), y as (select 't' || k as tag, ['1', '2', '3'][1 + k % 3] as type from range(12) r(k)), unknown as (select 'f' || l_orderkey as file, l_orderkey % 2 = 0 as u from lineitem group by all),
j as (select t.*, coalesce(r.basic, case when t.tag in ('t10', 't11') then 'Z' end) as basic, case when not u then y.type end as type from t left join rules r on r.tag = t.tag join y on y.tag = t.tag join unknown on unknown.file = t.file),
a as (select *, case when tag = 't0' then 'C' when basic = 'X/Z' then case type when '3' then 'X' else 'Z' end when basic = 'X/Z/D' then case type when '3' then 'X' when '2' then 'Z' else 'D' end else basic end as act from j where basic is not null)
select * from (select file, path, act as action, case when act = 'X' and state = 'exists' then 'L2-X-PRESENT' when act = 'X' then 'L2-X-EMPTY' when act = 'Z' and state = 'exists' then 'L2-Z-VALUE' when act = 'D' and state = 'exists' then 'L2-D-CHECK' when act = 'D' then 'L2-D-EMPTY' when act = 'U' and state = 'exists' then 'L2-U-CHECK' when act = 'C' and state = 'exists' then 'L2-C-CHECK' end as code from a) where code is not null""")
def deid_actions(spark, sf):
    profile = spark.createDataFrame([(tag, basic, {"clean": "C"} if tag == "t0" else {}) for tag, basic in _PROFILE], "tag string, basic string, options map<string,string>")
    tags = _tags(spark, sf)
    types = tags.where(F.substring("file", 2, 20).cast("long") % 2 != 0).select("file", "tag").distinct().withColumn("type", F.element_at(F.array(F.lit("1"), F.lit("2"), F.lit("3")), (1 + F.substring("tag", 2, 9).cast("int") % 3)))
    return deid.action_findings(tags, profile, types, ["clean"]).select("file", "path", "action", "code")


_FIND = f"""{_TAGS}, f as (select file, keyword as attribute, 'C' || (path::int % 3) as code, case path::int % 3 when 0 then 'error' when 1 then 'warning' else 'info' end as severity, path, path::bigint as n from t)"""


def _findings(spark, sf):
    k = F.col("path").cast("int") % 3
    return _tags(spark, sf).select("file", F.concat(F.lit("C"), k.cast("string")).alias("code"), F.when(k == 0, "error").when(k == 1, "warning").otherwise("info").alias("severity"), F.lit("conformance").alias("source"), F.col("keyword").alias("attribute"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("action"), "path", F.col("path").cast("long").alias("n"))


@query(f"with {_FIND} select file, code, attribute, sum(n)::bigint as n, array_to_string(list_sort(list(distinct path))[1:5], ',') as paths from f group by all")
def merged_findings(spark, sf):
    return findings.merge(_findings(spark, sf)).select("file", "code", "attribute", "n", F.array_join("paths", ",").alias("paths"))


@query(f"with {_FIND} select file, count(*) filter (where severity = 'error') as error, count(*) filter (where severity = 'warning') as warning, count(*) filter (where severity = 'info') as info from f group by 1")
def severity_counts(spark, sf):
    return findings.severity_counts(_findings(spark, sf), ["file"])


@query(f"with {_FIND} select code, count(distinct file) as files, sum(n)::bigint as total from f group by 1 order by 3 desc, 1 limit 15")
def finding_rollup(spark, sf):
    return findings.rollup(_findings(spark, sf))


@query(f"""with {_TAGS} select file, path, keyword, case when keyword in ('K2', 'K6') and regexp_full_match(vals[1], '[A-Z ]{{1,5}}') then vals[1] when state = 'exists' then '[present]' else '[empty]' end as shown from t""")
def safe_output(spark, sf):
    allow = spark.createDataFrame([("K2", "[A-Z ]{1,5}"), ("K6", "[A-Z ]{1,5}")], "keyword string, pattern string")
    tags = _tags(spark, sf)
    joined = tags.join(F.broadcast(allow), "keyword", "left")
    shown = findings.safe_value(F.col("state"), F.col("pattern").isNotNull(), F.expr("element_at(vals, 1) rlike concat('^(?:', pattern, ')$')"), F.get("vals", F.lit(0)))
    return joined.select("file", "path", "keyword", shown.alias("shown"))


from larkspur import answer_queries, header_queries  # noqa: E402, F401  they register their queries beside these

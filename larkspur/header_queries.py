"""Queries over header elements and their findings; elements are made from line items, files from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import conformance, deid, findings
from larkspur.registry import query, table

_TAGS = """t as (select 'f' || l_orderkey as file, l_linenumber::varchar as path, l_linenumber % 2 as depth, case when l_suppkey % 6 = 0 then '00' || (10 + l_partkey % 8) || '1' || '0' || (10 + l_partkey % 8) else '0010' || lpad((l_partkey % 12)::varchar, 4, '0') end as tag,
 'K' || (l_partkey % 12) as keyword, case l_partkey % 5 when 0 then 'DA' when 1 then 'TM' when 2 then 'DT' when 3 then 'CS' else 'LO' end as vr, case when l_linenumber % 3 = 0 then 'empty' else 'exists' end as state, l_returnflag || (l_suppkey % 9) as x from lineitem)"""


def _tags(spark, sf):
    k, s, text = F.col("l_partkey"), F.col("l_suppkey"), lambda c: c.cast("string")
    private = F.concat(F.lit("00"), text(10 + k % 8), F.lit("1"), F.lit("0"), text(10 + k % 8))
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("f"), text(F.col("l_orderkey"))).alias("file"), text(F.col("l_linenumber")).alias("path"), (F.col("l_linenumber") % 2).alias("depth"), F.when(s % 6 == 0, private).otherwise(F.concat(F.lit("0010"), F.lpad(text(k % 12), 4, "0"))).alias("tag"),
        F.concat(F.lit("K"), text(k % 12)).alias("keyword"), F.element_at(F.array(*map(F.lit, ("DA", "TM", "DT", "CS", "LO"))), (1 + k % 5).cast("int")).alias("vr"), F.when(F.col("l_linenumber") % 3 == 0, "empty").otherwise("exists").alias("state"), F.array(F.concat("l_returnflag", text(s % 9))).alias("vals"),
    )


_TERMS = [("K1", f"{flag}{k}", k > 4) for flag in "ANR" for k in range(7)]


@query(f"""with {_TAGS}, terms(keyword, value, retired) as (values {", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in _TERMS)})
select file, path, 'L1-TERM-' || case when retired is null then 'UNKNOWN' else 'RETIRED' end as code from t left join terms on terms.keyword = t.keyword and value = x where t.keyword = 'K1' and (retired is null or retired)""")
def defined_terms(spark, sf):
    values = _tags(spark, sf).where("keyword = 'K1'").withColumn("value", F.get("vals", F.lit(0)))
    return conformance.term_findings(values, spark.createDataFrame(_TERMS, "keyword string, value string, retired boolean")).select("file", "path", "code")


_MACROS = [("I0", "M0", "M", True), ("I0", "M1", "M", False), ("I0", "M2", "U", False), ("I1", "M0", "M", False), ("I1", "M3", "M", True)]
_GROUPS = "g as (select 'f' || l_orderkey as file, 'M' || (l_partkey % 4) as macro, case when l_linenumber = 1 then 'shared' else 'frame' end as place, l_suppkey % 3 as frame from lineitem), f as (select 'f' || o_orderkey as file, 'I' || (o_orderkey % 2) as iod, 1 + o_orderkey % 3 as n_frames from orders)"


@query(f"""with {_GROUPS}, m(iod, macro, usage, shared_allowed) as (values {", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in _MACROS)}),
h as (select file, macro, bool_or(place = 'shared') as shared, count(distinct frame) filter (where place = 'frame') as n from g group by all),
j as (select f.file, m.macro, usage, shared_allowed, n_frames, coalesce(shared, false) as shared, coalesce(n, 0) as n from f join m using (iod) left join h on h.file = f.file and h.macro = m.macro)
select file, macro as attribute, case when n = 0 then 'L1-FG-MISSING' else 'L1-FG-INCOMPLETE' end as code, n_frames - n as n from j where usage = 'M' and not shared and n < n_frames
union all select file, macro, 'L1-FG-SHARED', 1 from j where shared and not shared_allowed""")
def functional_groups(spark, sf):
    """Required macros in the shared item or in every frame, and macros that may not be shared."""
    groups = table(spark, sf, "lineitem").select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("file"), F.concat(F.lit("M"), (F.col("l_partkey") % 4).cast("string")).alias("macro"), F.when(F.col("l_linenumber") == 1, "shared").otherwise("frame").alias("place"), (F.col("l_suppkey") % 3).alias("frame"))
    k = F.col("o_orderkey")
    frames = table(spark, sf, "orders").select(F.concat(F.lit("f"), k.cast("string")).alias("file"), F.concat(F.lit("I"), (k % 2).cast("string")).alias("iod"), (1 + k % 3).alias("n_frames"))
    macros = spark.createDataFrame(_MACROS, "iod string, macro string, usage string, shared_allowed boolean")
    return conformance.group_findings(groups, frames, macros).select("file", "attribute", "code", "n")


_INNER = [(f"M{m}", f"t{k}", f"K{k}", ("1", "2", "3")[(m + k) % 3]) for m in range(4) for k in range(0, 6, 1 + m % 2)]


@query(f"""with i as (select 'f' || l_orderkey as file, l_linenumber::varchar as path, 'M' || (l_partkey % 4) as macro, ['t' || (l_suppkey % 3), 't' || (3 + l_partkey % 3)] as tags from lineitem),
n(macro, tag, keyword, type) as (values {", ".join(map(str, _INNER))})
select file, path, tag, 'L1-FG-TYPE' || type || '-ABSENT' as code from i join n using (macro) where type in ('1', '2') and not list_contains(tags, tag)""")
def inner_macros(spark, sf):
    text = lambda c: c.cast("string")
    items = table(spark, sf, "lineitem").select(F.concat(F.lit("f"), text(F.col("l_orderkey"))).alias("file"), text(F.col("l_linenumber")).alias("path"), F.concat(F.lit("M"), text(F.col("l_partkey") % 4)).alias("macro"), F.array(F.concat(F.lit("t"), text(F.col("l_suppkey") % 3)), F.concat(F.lit("t"), text(3 + F.col("l_partkey") % 3))).alias("tags"))
    return conformance.macro_findings(items, spark.createDataFrame(_INNER, "macro string, tag string, keyword string, type string")).select("file", "path", "tag", "code")


_REQUIRED = [("I0", "00100001", "K1", None), ("I0", "00100002", "K2", "N3"), ("I1", "00100005", "K5", "R1"), ("I1", "00100000", "K0", None)]


@query(f"""with {_TAGS}, u as (select file, tag, max(state) as state, max(x) as x from t group by all), r(iod, tag, keyword, expected) as (values {", ".join(f"('{a}', '{b}', '{c}', {'null' if d is None else repr(d)})" for a, b, c, d in _REQUIRED)}),
f as (select 'f' || o_orderkey as file, 'I' || (o_orderkey % 3) as iod from orders)
select f.file, r.tag, case when state is null or state <> 'exists' then 'L1-QUANT-MISSING' else 'L1-QUANT-VALUE' end as code from f join r using (iod) left join u on u.file = f.file and u.tag = r.tag where state is null or state <> 'exists' or (expected is not null and x <> expected)""")
def quantitation(spark, sf):
    files = table(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"), F.concat(F.lit("I"), (F.col("o_orderkey") % 3).cast("string")).alias("iod"))
    tags = _tags(spark, sf).groupBy("file", "tag").agg(F.max("state").alias("state"), F.array(F.max(F.get("vals", F.lit(0)))).alias("vals"))
    return conformance.quantitation_findings(files, tags, spark.createDataFrame(_REQUIRED, "iod string, tag string, keyword string, expected string")).select("file", "tag", "code")


@query(f"""with {_TAGS} select file, path, case when regexp_full_match(x, case keyword when 'K3' then '[AN][0-4]' else 'R.|N1' end) then 'L2-PSEUDONYM-OK' else 'L2-PSEUDONYM-MISMATCH' end as code from t where depth = 0 and state = 'exists' and keyword in ('K3', 'K4')""")
def pseudonym_policy(spark, sf):
    policy = spark.createDataFrame([("K3", "[AN][0-4]"), ("K4", "R.|N1")], "keyword string, pattern string")
    return deid.pseudonym_findings(_tags(spark, sf), policy).select("file", "path", "code")


_CODES = [(f"{flag}{k}", f"meaning {k}", ("clean", "dates", None)[k % 3]) for flag in "AN" for k in range(8)]
_CLAIMS = f"""{_TAGS}, n as (select *, case when path::int % 4 = 0 then 'PatientIdentityRemoved' when path::int % 4 = 1 then 'DeidentificationMethodCode' when path::int % 4 = 2 then 'DeidentificationMethod' else keyword end as k, case when path::int % 4 = 0 and length(file) % 2 = 0 then 'YES' else x end as y from t),
o(code, meaning, option) as (values {", ".join(f"('{a}', '{b}', {'null' if c is None else repr(c)})" for a, b, c in _CODES)}),
l as (select file, y as code, meaning, option from n left join o on o.code = y where k = 'DeidentificationMethodCode'),
b as (select file, list_sort(list(distinct option) filter (where option is not null)) as options, list_sort(list(distinct code) filter (where meaning is null)) as unknown, count(*) as n_codes from l group by 1),
c as (select n.file, bool_or(k = 'PatientIdentityRemoved' and y = 'YES') as claims, bool_or(k = 'DeidentificationMethod' and state = 'exists') as has_method from n where depth = 0 group by 1),
j as (select c.*, coalesce(options, []) as options, coalesce(unknown, []) as unknown, coalesce(n_codes, 0) as n_codes from c left join b using (file))"""


def _claims(spark, sf):
    at = F.col("path").cast("int") % 4
    tags = _tags(spark, sf).withColumn("keyword", F.when(at == 0, "PatientIdentityRemoved").when(at == 1, "DeidentificationMethodCode").when(at == 2, "DeidentificationMethod").otherwise(F.col("keyword")))
    tags = tags.withColumn("vals", F.when((at == 0) & (F.length("file") % 2 == 0), F.array(F.lit("YES"))).otherwise(F.col("vals")))
    return deid.claimed(tags, spark.createDataFrame(_CODES, "code string, meaning string, option string"))


@query(f"""with {_CLAIMS} select file, 'L2-NOT-CLAIMED' as code, 1::bigint as n from j where not claims union all select file, 'L2-CLAIM-INCOMPLETE', 1 from j where claims and not has_method and n_codes = 0
union all select file, 'L2-CODE-UNKNOWN', len(unknown) from j where len(unknown) > 0""")
def declared_deidentification(spark, sf):
    return deid.claim_findings(_claims(spark, sf)).select("file", "code", "n")


@query(f"""with {_CLAIMS} select file, array_to_string(list_filter([case when list_contains(options, 'dates') then 'dates:claimed' end, 'uids:policy', case when list_contains(options, 'clean') then 'clean:claimed' end], lambda x: x is not null), ',') as applied from j""")
def applied_options(spark, sf):
    """Options of the policy and those that files declare, in the profile's order, with their origin."""
    applied = deid.option_union(["uids"], _claims(spark, sf), ["dates", "uids", "clean"])
    return applied.select("file", F.array_join(F.transform("applied", lambda x: F.concat(x["option"], F.lit(":"), x["origin"])), ",").alias("applied"))


@query(f"""with {_TAGS} select file, string_agg(distinct substr(tag, 1, 4), ',' order by substr(tag, 1, 4)) as groups, count(*) as n, array_to_string(list_sort(list(distinct path))[1:5], ',') as path from t where regexp_matches(tag, '^...[13579BDF]') group by 1""")
def private_elements(spark, sf):
    return deid.private_findings(_tags(spark, sf), False).select("file", F.col("action").alias("groups"), "n", "path")


@query("""with p as (select 'f' || o_orderkey as file, case when o_orderkey % 5 = 0 then 'YES' when o_orderkey % 5 = 1 then 'NO' end as burned_in, case o_orderkey % 3 when 0 then 'US' when 1 then 'CT' else 'SC' end as modality from orders)
select file, case when burned_in = 'YES' then 'L2-BURNED-IN' else 'L2-PIXEL-RISK' end as code from p where burned_in = 'YES' or (burned_in is null and modality in ('US', 'SC'))""")
def pixel_risk(spark, sf):
    k = F.col("o_orderkey")
    files = table(spark, sf, "orders").select(F.concat(F.lit("f"), k.cast("string")).alias("file"), F.when(k % 5 == 0, "YES").when(k % 5 == 1, "NO").alias("burned_in"), F.element_at(F.array(*map(F.lit, ("US", "CT", "SC"))), (1 + k % 3).cast("int")).alias("modality"))
    return deid.pixel_findings(files, ["US", "SC"]).select("file", "code")


@query(f"with {_TAGS} select file, count(*) as n from t where vr in ('DA', 'DT', 'TM') and state = 'exists' group by 1")
def dates_present(spark, sf):
    return deid.date_findings(_tags(spark, sf)).select("file", "n")


_FOUND = f"""{_TAGS}, f as (select file, case path::int % 3 when 0 then 'L1-TYPE1-ABSENT' when 1 then 'L2-X-PRESENT' else 'L2-DATES' end as code, case path::int % 3 when 0 then 'error' when 1 then 'warning' else 'info' end as severity, case when path::int % 3 = 0 then 'conformance' else 'deid' end as source, keyword as attribute, path::bigint as n from t)"""


def _found(spark, sf):
    k = F.col("path").cast("int") % 3
    one = lambda *x: F.element_at(F.array(*map(F.lit, x)), k + 1)
    return _tags(spark, sf).select("file", one("L1-TYPE1-ABSENT", "L2-X-PRESENT", "L2-DATES").alias("code"), one("error", "warning", "info").alias("severity"), one("conformance", "deid", "deid").alias("source"), F.col("keyword").alias("attribute"), "tag", F.col("path").cast("long").alias("n"))


@query(f"""with {_FOUND} select file, coalesce(string_agg(distinct attribute, ',' order by attribute) filter (where code = 'L1-TYPE1-ABSENT'), '') as missing, coalesce(string_agg(distinct attribute, ',' order by attribute) filter (where code = 'L2-X-PRESENT'), '') as privacy, count(*) filter (where severity = 'error') = 0 as passed from f group by 1""")
def derived_lists(spark, sf):
    found = findings.derived_lists(_found(spark, sf))
    return found.select("file", F.array_join("missing", ",").alias("missing"), F.array_join("privacy", ",").alias("privacy"), "passed")


@query(f"with {_FOUND} select file, code, attribute, sum(n)::bigint as n from f group by all")
def model_payload(spark, sf):
    return findings.payload(_found(spark, sf))


@query(f"""with {_FOUND}, c as (select file, count(*) filter (where severity = 'error') as e, count(*) filter (where severity = 'warning') as w, count(*) filter (where severity = 'info') as i from f where file not like '%7' or severity = 'none' group by 1)
select file, array_to_string(list_filter([case when e > 0 then e || ' error' || case when e > 1 then 's' else '' end end, case when w > 0 then w || ' warning' || case when w > 1 then 's' else '' end end, case when i > 0 then i || ' info' || case when i > 1 then 's' else '' end end], lambda x: x is not null), '; ') || '.' as summary from c""")
def template_summaries(spark, sf):
    return findings.template_summary(findings.severity_counts(_found(spark, sf).where("file not like '%7'"), ["file"]))


@query(f"with {_FOUND} select file, code, row_number() over (partition by file order by case severity when 'error' then 1 when 'warning' then 2 else 3 end, code, n) as place, n from f")
def finding_order(spark, sf):
    """The order in which a file's findings are shown."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("file").orderBy(findings.severity_rank(), "code", "n")
    return _found(spark, sf).select("file", "code", F.row_number().over(order).cast("long").alias("place"), "n")

"""De-identification: actions for each element, pseudonym policy, declared methods, private and burned-in data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.conformance import finding

#: Combined actions, and the types an attribute can have.
COMBINED = ("X/Z", "X/D", "Z/D", "X/Z/D", "X/Z/U*")
TYPES = ("1", "2", "3")


def _combined(action: str, kind: str | None) -> str:
    """What a combined action comes to: its alternatives go from removal to the most lenient. Type 3 may be removed, type 2
    may be empty, type 1 takes the most lenient one, as does an unknown type."""
    choices = action.split("/")
    return choices[0] if kind == "3" else "Z" if kind == "2" and "Z" in choices else choices[-1]


def with_rules(tags: DataFrame, profile: DataFrame) -> DataFrame:
    """Each public element with its rule: by its tag, else by a repeating mask such as 60xx3000. Adds basic, options."""
    exact = F.broadcast(profile.where(~F.col("tag").contains("x")).select("tag", F.col("basic").alias("_b"), F.col("options").alias("_o")))
    masks = F.broadcast(profile.where(F.col("tag").contains("x")).select(F.translate("tag", "x", ".").alias("_mask"), F.substring("tag", 1, 2).alias("_head"), F.col("basic").alias("_mb"), F.col("options").alias("_mo")))
    joined = tags.withColumn("_head2", F.substring("tag", 1, 2)).join(exact, "tag", "left").join(masks, F.expr("_b is null and _head2 = _head and tag rlike _mask"), "left")
    return joined.withColumn("basic", F.coalesce("_b", "_mb")).withColumn("options", F.coalesce("_o", "_mo")).drop("_b", "_o", "_mb", "_mo", "_mask", "_head", "_head2").where("basic is not null")


def effective(options: Column, basic: Column, applied: list[str]) -> Column:
    """The action of the first applied option, in the profile's order, that defines one; else the basic action."""
    return F.coalesce(*(F.try_element_at(options, F.lit(o)) for o in applied), basic)


def resolve(action: Column, kind: Column) -> Column:
    """A combined action by the attribute's type (its C aside); an unknown type takes the most lenient. One look-up."""
    base = F.regexp_extract(F.coalesce(kind, F.lit("")), "^([123])C?$", 1)
    known = F.create_map(*(F.lit(x) for a in COMBINED for k in (*TYPES, None) for x in (f"{a}|{k or ''}", _combined(a, k))))
    return F.coalesce(F.try_element_at(known, F.concat(action, F.lit("|"), base)), action)


def action_findings(tags: DataFrame, profile: DataFrame, types: DataFrame, applied: list[str]) -> DataFrame:
    """Elements against their actions: X should be gone, Z empty, D and U replaced (to be verified), C cleaned.

    Sequences to be removed are reported once and not descended into. types: file, tag, type.
    """
    ruled = with_rules(tags.where(~F.col("tag").rlike("^...[13579BDF]")), profile).join(types.select("file", "tag", "type"), ["file", "tag"], "left")
    ruled = ruled.withColumn("action", resolve(effective(F.col("options"), F.col("basic"), applied), F.col("type")))
    gone = ruled.where("action = 'X' and vr = 'SQ'").select(F.col("file").alias("_f"), F.col("path").alias("_p"))
    open_ = ruled.join(gone, F.expr("file = _f and startswith(path, concat(_p, '.'))"), "left_anti")
    action, full = F.col("action"), F.col("state") == "exists"
    renewed = action.isin("U", "U*")
    code = F.when((action == "X") & full, "L2-X-PRESENT").when((action == "X") & ~full, "L2-X-EMPTY").when((action == "Z") & full, "L2-Z-VALUE").when((action == "D") & full, "L2-D-CHECK").when((action == "D") & ~full, "L2-D-EMPTY").when(renewed & full, "L2-U-CHECK").when((action == "C") & full, "L2-C-CHECK")
    severity = F.when(action == "X", F.when(full, "error").otherwise("warning")).when(action == "Z", "error").when((action == "D") & ~full, "warning").otherwise("info")
    return finding(open_.withColumn("_code", code).where("_code is not null"), F.col("_code"), severity, "deid", action=action)


def pseudonym_findings(tags: DataFrame, policy: DataFrame) -> DataFrame:
    """Top-level values held against the site's patterns (full match). Empty values are always right."""
    rows = tags.where("depth = 0 and state = 'exists'").join(F.broadcast(policy), "keyword")
    right = F.forall("vals", lambda x: F.rlike(x, F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))))
    return finding(rows, F.when(right, "L2-PSEUDONYM-OK").otherwise("L2-PSEUDONYM-MISMATCH"), F.when(right, "info").otherwise("error"), "deid")


def claimed(tags: DataFrame, codes: DataFrame) -> DataFrame:
    """What files declare: file, claims (the flag), methods, known and unknown codes. codes: code, meaning, option."""
    listed = tags.where("keyword = 'DeidentificationMethodCode'").select("file", F.explode("vals").alias("code")).join(F.broadcast(codes), "code", "left")
    by_code = listed.groupBy("file").agg(F.array_sort(F.collect_set("option")).alias("options"), F.array_sort(F.collect_set(F.when(F.col("meaning").isNull(), F.col("code")))).alias("unknown"), F.count("*").alias("n_codes"))
    flags = tags.where("depth = 0").groupBy("file").agg(F.max((F.col("keyword") == "PatientIdentityRemoved") & F.array_contains("vals", "YES")).alias("claims"), F.max((F.col("keyword") == "DeidentificationMethod") & (F.col("state") == "exists")).alias("has_method"))
    return flags.join(by_code, "file", "left").withColumn("n_codes", F.coalesce("n_codes", F.lit(0)))


def claim_findings(claims: DataFrame) -> DataFrame:
    none = finding(claims.where("not claims"), "L2-NOT-CLAIMED", "warning", "deid")
    half = finding(claims.where("claims and not has_method and n_codes = 0"), "L2-CLAIM-INCOMPLETE", "error", "deid")
    odd = finding(claims.where("size(unknown) > 0"), "L2-CODE-UNKNOWN", "warning", "deid", n=F.size("unknown"))
    return none.unionByName(half).unionByName(odd)


def option_union(policy: list[str], claims: DataFrame, order: list[str], honour: bool = True) -> DataFrame:
    """file and options: those of the policy and, if honoured, those claimed, in the profile's order, with origin."""
    own = F.coalesce("options", F.array().cast("array<string>")) if honour else F.array().cast("array<string>")
    each = F.array(*(F.when(F.lit(o in policy) | F.array_contains(own, o), F.struct(F.lit(o).alias("option"), F.when(F.lit(o in policy), "policy").otherwise("claimed").alias("origin"))) for o in order))
    return claims.select("file", F.array_compact(each).alias("applied"))


def private_findings(tags: DataFrame, retained: bool) -> DataFrame:
    """One line for each file with private elements: how many, in which groups, and the first five paths, comma-joined."""
    private = tags.where(F.col("tag").rlike("^...[13579BDF]")).groupBy("file").agg(F.count("*").alias("c"), F.array_join(F.slice(F.array_sort(F.collect_set(F.substring("tag", 1, 4))), 1, 50), ",").alias("groups"), F.array_join(F.slice(F.array_sort(F.collect_set("path")), 1, 5), ",").alias("path"))
    return finding(private, "L2-PRIVATE", "info" if retained else "error", "deid", action=F.col("groups"), n=F.col("c"))


def pixel_findings(files: DataFrame, high_risk: list[str]) -> DataFrame:
    """Burned-in annotation: declared, or not declared for a modality of high risk."""
    code = F.when(F.col("burned_in") == "YES", "L2-BURNED-IN").when(F.col("burned_in").isNull() & F.col("modality").isin(*high_risk), "L2-PIXEL-RISK")
    return finding(files.withColumn("_c", code).where("_c is not null"), F.col("_c"), F.when(F.col("_c") == "L2-BURNED-IN", "error").otherwise("warning"), "deid")


def date_findings(tags: DataFrame) -> DataFrame:
    """How many dates and times with values a file has."""
    dated = tags.where("vr in ('DA', 'DT', 'TM') and state = 'exists'").groupBy("file").agg(F.count("*").alias("c"))
    return finding(dated, "L2-DATES", "info", "deid", n=F.col("c"))

"""Editions: version tokens of file names, comparison in a partial order, latest flags, draft families."""

from __future__ import annotations

import re
import unicodedata
from datetime import date
from functools import reduce
from operator import add, and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("ver", "rev", "amd")
#: Token patterns in the order they are tried, with the kind of number they give. A Latin token touches no
#: ASCII letter or digit; a bare R needs brackets or an id such as E6 before it. Words without a number come last.
TOKENS = (
    ("amd", r"(?<![0-9A-Za-z])amend(?:ment)?\.?\s*(?P<n>\d+(?:\.\d+)*)(?![0-9A-Za-z])"),
    ("rev", r"제?\s*(?P<n>\d+)\s*차\s*개정"),
    ("rev", r"개정\s*(?P<n>\d+)"),
    ("rev", r"(?<![0-9A-Za-z])rev(?:ision)?\.?\s*(?P<n>\d+(?:\.\d+)*)(?![0-9A-Za-z])"),
    ("ver", r"(?<![0-9A-Za-z])ver(?:sion)?\.?\s*(?P<n>\d+(?:\.\d+)*)(?![0-9A-Za-z])"),
    ("ver", r"(?<![0-9A-Za-z])v\.?(?P<n>\d+(?:\.\d+)*)(?![0-9A-Za-z])"),
    ("rev", r"\(\s*(?P<label>r(?!0\d)(?P<n>\d+(?:\.\d+)*))\s*\)"),
    ("rev", r"(?:(?<=[A-Za-z]\d)|(?<=[A-Za-z]\d\d)|(?<=[A-Za-z]\d\d\d))(?P<label>r(?!0\d)(?P<n>\d+(?:\.\d+)*))(?![0-9A-Za-z])"),
    (None, r"개정|최종"),
)
#: A bare revision in a label, a date with one separator or none, the suffixes that names are freed of.
BARE_REVISION = r"(?<![0-9A-Za-z])r(?!0\d)(?P<n>\d+(?:\.\d+)*)(?![0-9A-Za-z])"
CALENDAR = r"(?<!\d)(?P<y>(?:19|20)\d{2})(?:(?P<s>[-._])?(?P<m>\d{2})(?P=s)(?P<d>\d{2})|(?P<m2>\d{2})(?P<d2>\d{2}))(?!\d)"
SUFFIXES = r"\.(?:pdf|docx|xlsx|md|markdown|txt|xml|html|htm)$"
VERSION = "struct<ver:array<int>,rev:array<int>,amd:array<int>>"


def numbers(label: str) -> tuple[int, ...]:
    """The numbers of a label, trailing zeros dropped, so that 2.0 equals 2."""
    out = [int(x) for x in label.split(".")]
    while len(out) > 1 and not out[-1]:
        out.pop()
    return tuple(out)


class Scan:
    """Edition tokens of a name: (place, kind, label, numbers), the first valid date, and the name with both blanked."""

    def __init__(self, name: str):
        self.rest, self.date = unicodedata.normalize("NFC", name), None
        self.tokens: list[tuple[int, str | None, str, tuple[int, ...] | None]] = []
        for m in re.finditer(CALENDAR, self.rest):
            try:
                day = date(int(m["y"]), int(m["m"] or m["m2"]), int(m["d"] or m["d2"]))
            except ValueError:
                continue
            self.date = self.date or day
            self._blank(m)
        for kind, pattern in TOKENS:
            self.take(kind, pattern)

    def _blank(self, m: re.Match) -> None:
        self.rest = self.rest[: m.start()] + " " * (m.end() - m.start()) + self.rest[m.end() :]

    def take(self, kind: str | None, pattern: str) -> None:
        for m in re.finditer(pattern, self.rest, re.IGNORECASE):
            parts = m.groupdict()
            self.tokens.append((m.start(), kind, (parts.get("label") or m[0]).strip(), numbers(parts["n"]) if kind else None))
            self._blank(m)

    def version(self) -> dict[str, list[int] | None]:
        """The first numbers of each kind."""
        found: dict[str, list[int]] = {}
        for _, kind, _, n in sorted(self.tokens, key=lambda x: x[0]):
            if kind:
                found.setdefault(kind, list(n))
        return {k: found.get(k) for k in KINDS}

    def about_a_change(self) -> bool:
        """Whether two tokens are of one kind: a document about a change between editions is an edition of neither."""
        kinds = [kind for _, kind, _, _ in self.tokens if kind]
        return len(kinds) != len(set(kinds))


def family(rest: str) -> str | None:
    return " ".join(re.sub(r"[^0-9a-zㄱ-ㆎ가-힣]+", " ", unicodedata.normalize("NFC", rest).casefold()).split()) or None


def _stem(name: str) -> str:
    return re.sub(SUFFIXES, "", name, flags=re.IGNORECASE)


def infer(name: str) -> dict:
    """family, label, version, date of a file name; two tokens of one kind mark a change document, which stands alone, a
    word such as "final" makes a family without a version, and a date alone makes no family."""
    found = Scan(_stem(name))
    if not found.tokens or found.about_a_change():
        return {"family": None, "label": None, "version": None, "date": found.date}
    label = " ".join(x for _, _, x, _ in sorted(found.tokens, key=lambda x: x[0]))
    return {"family": family(found.rest), "label": label, "version": found.version(), "date": found.date}


def core_name(name: str) -> str | None:
    """A name without its tokens and dates, evened out; None for a change document or where nothing is left."""
    found = Scan(_stem(name))
    return None if found.about_a_change() else family(found.rest)


def parse_label(label: str | None) -> dict | None:
    """Comparable numbers of a version label; a bare R is a revision and a bare number a version."""
    if not label:
        return None
    found = Scan(label)
    found.take("rev", BARE_REVISION)
    version = found.version()
    if not any(version.values()) and (m := re.fullmatch(r"\s*(\d+(?:\.\d+)*)\s*", label)):
        version["ver"] = list(numbers(m[1]))
    return version if any(version.values()) else None


def infer_column(name: Column) -> Column:
    def rows(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([infer(n or "") for n in names], columns=["family", "label", "version", "date"])

    return F.pandas_udf(rows, f"struct<family:string,label:string,version:{VERSION},date:date>")(name)


def compare(a: str, b: str) -> Column:
    """1, -1 or 0 as edition a is newer, older or equal; NULL where they cannot be compared. Columns: a.version,
    a.date, a.manifest and the same of b. The first kind that both have and that differs decides."""
    order = F.lit(None).cast("int")
    shared = F.lit(False)
    for k in reversed(KINDS):
        x, y = F.col(f"{a}.version.{k}"), F.col(f"{b}.version.{k}")
        both = x.isNotNull() & y.isNotNull()
        shared |= both
        order = F.when(both & (x > y), 1).when(both & (x < y), -1).otherwise(order)
    dated = F.col(f"{a}.manifest") & F.col(f"{b}.manifest") & F.col(f"{a}.date").isNotNull() & F.col(f"{b}.date").isNotNull()
    by_date = F.when(dated & (F.col(f"{a}.date") > F.col(f"{b}.date")), 1).when(dated & (F.col(f"{a}.date") < F.col(f"{b}.date")), -1)
    return F.coalesce(order, by_date, F.when(shared | dated, 0))


def latest(documents: DataFrame, by: str = "corpus") -> DataFrame:
    """Adds is_latest. ``documents``: document_id, ``by``, family, version, date, manifest, superseded.

    Superseded members are hidden while a live one exists; of the rest, one is not latest if another is strictly newer.
    The order is partial, but what decides is the first kind that both editions have and that differs, else the date. So an
    edition has a newer one among those of one pattern of kinds just where their largest numbers of the shared kinds, and
    date, are larger than its own: a family is folded into these maxima, and no edition meets another.
    """
    # documents without a family are latest; they would all meet in one group otherwise
    alone = documents.where("family is null").withColumn("is_latest", F.lit(True))
    docs = documents.where("family is not null").withColumn("_live", ~F.coalesce("superseded", F.lit(False)))
    docs = docs.withColumn("_at", F.when(F.col("manifest"), F.col("date")))
    own = [F.col(f"_{k}") for k in KINDS]
    docs = docs.select("*", *(F.col(f"version.{k}").alias(f"_{k}") for k in KINDS))
    pattern = reduce(add, (F.when(c.isNotNull(), 1 << n).otherwise(0) for n, c in enumerate(own)))
    first = docs.groupBy(by, "family", "_live", *own).agg(F.max("_at").alias("_at")).withColumn("_p", pattern)
    every = F.array(*map(F.lit, range(1 << len(KINDS))))
    kept = F.struct(*(F.when(F.col("_s").bitwiseAND(1 << n) != 0, c).alias(f"_{k}") for n, (k, c) in enumerate(zip(KINDS, own))))
    # the largest of each pattern by each set of kinds that it may share, live ones before all others
    tops = first.select("*", F.explode(F.filter(every, lambda s: s.bitwiseAND(F.col("_p")) == s)).alias("_s"))
    tops = tops.groupBy(F.col(by).alias("_by"), F.col("family").alias("_family"), F.col("_p").alias("_q"), F.col("_s").alias("_t")).agg(F.max(F.struct("_live", kept.alias("n"), "_at")).alias("_top"))
    live = first.groupBy(F.col(by).alias("_by"), F.col("family").alias("_family")).agg(F.max("_live").alias("_any"))
    asked = first.groupBy(by, "family", "_p", *own).agg(F.lit(1).alias("_1")).select("*", F.explode(every).alias("_o")).withColumn("_s", F.col("_p").bitwiseAND(F.col("_o")))
    group = F.col(by).eqNullSafe(F.col("_by")) & (F.col("family") == F.col("_family"))
    met = asked.join(live, group).drop("_by", "_family").join(tops, group & (F.col("_o") == F.col("_q")) & (F.col("_s") == F.col("_t")), "left")
    counts = F.col("_top._live") == F.col("_any")  # else no member of the pattern is in the pool
    newer = F.coalesce(F.max(counts & (F.col("_top.n") > kept)), F.lit(False)).alias("_newer")
    edition = met.groupBy(by, "family", "_any", *own).agg(newer, F.max(F.when(counts & (F.col("_top.n") == kept), F.col("_top._at"))).alias("_until"))
    edition = edition.select(F.col(by).alias("_by"), F.col("family").alias("_family"), "_any", "_newer", "_until", *(c.alias(f"_e{k}") for k, c in zip(KINDS, own)))
    joined = docs.join(edition, reduce(and_, (c.eqNullSafe(F.col(f"_e{k}")) for k, c in zip(KINDS, own)), group), "left")
    old = F.col("_newer") | F.coalesce(F.col("_at") < F.col("_until"), F.lit(False))
    # as NULL equals nothing, editions of a NULL ``by`` aren't compared
    flag = (F.col("_live") | ~F.col("_any")) & (F.col(by).isNull() | ~old)
    return joined.select(*documents.columns, flag.alias("is_latest")).unionByName(alone)


def glob_regex(glob: str) -> str:
    """A glob, matched from the right component by component, as a regular expression on paths."""
    part = lambda p: "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p)
    return ("^" if glob.startswith("/") else "(?:^|/)") + "/".join(part(p) for p in glob.strip("/").split("/")) + "$"


def resolve(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each document with its manifest entry: the first, by ``ord``, whose pattern matches the relative path or name.
    ``manifest``: ord, pattern (a regular expression), family, label, date, superseded - a list written by hand."""
    entry = F.struct("ord", F.col("m.family").alias("family"), F.col("m.label").alias("label"), F.col("m.date").alias("date"), F.col("m.superseded").alias("superseded"))
    hits = documents.select("document_id", "rel_path").join(F.broadcast(manifest).alias("m"), F.expr("rel_path rlike pattern")).groupBy("document_id").agg(F.min_by(entry, "ord").alias("entry"))
    return documents.join(hits, "document_id", "left")


def resolved(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """document_id with family, label, version, date, superseded, manifest: from the first entry that matches, else inferred from
    the file name, with the folder before the family. documents: document_id, rel_path."""
    def parsed(labels: pd.Series) -> pd.Series:
        return pd.Series([parse_label(x) for x in labels], dtype="object")

    def inferred(paths: pd.Series) -> pd.DataFrame:
        out = []
        for path in paths:
            folder, _, name = (path or "").rpartition("/")
            found = infer(name)
            if found["family"]:
                found["family"] = " ".join(x for x in (family(folder), found["family"]) if x)
            out.append(found)
        return pd.DataFrame(out, columns=["family", "label", "version", "date"])

    def normal(names: pd.Series) -> pd.Series:
        return pd.Series([family(x) if x else None for x in names], dtype="object")

    both = resolve(documents, manifest).withColumn("listed", F.col("entry").isNotNull())
    guess = F.pandas_udf(inferred, f"struct<family:string,label:string,version:{VERSION},date:date>")
    as_row = F.pandas_udf(lambda x: pd.DataFrame([v or {k: None for k in KINDS} for v in parsed(x)], columns=list(KINDS)), VERSION, F.PandasUDFType.SCALAR)
    both = both.withColumn("guess", guess("rel_path")).withColumn("known", as_row("entry.label"))
    pick = lambda a, b: F.when(F.col("listed"), a).otherwise(b)
    return both.select(
        "document_id", pick(F.pandas_udf(normal, "string")("entry.family"), F.col("guess.family")).alias("family"), pick(F.col("entry.label"), F.col("guess.label")).alias("label"), pick(F.col("known"), F.col("guess.version")).alias("version"),
        pick(F.col("entry.date").cast("date"), F.col("guess.date")).alias("date"), F.coalesce("entry.superseded", F.lit(False)).alias("superseded"), F.col("listed").alias("manifest"),
    )


def date_candidates(documents: DataFrame) -> DataFrame:
    """Documents whose date could decide: those of a family with another one that their versions don't tell apart."""
    a, b = documents.alias("a"), documents.alias("b")
    pairs = a.join(b, (F.col("a.family") == F.col("b.family")) & ~F.col("a.document_id").eqNullSafe(F.col("b.document_id")), "left_semi")
    edition = documents.where("family is not null").groupBy("family", "version").agg(F.count("*").alias("n"))
    kinds = edition.alias("x").join(edition.alias("y"), (F.col("x.family") == F.col("y.family")) & ((F.col("x.n") > 1) | ~F.col("x.version").eqNullSafe(F.col("y.version"))))
    none = lambda s: F.struct(F.col(f"{s}.version").alias("version"), F.lit(None).cast("date").alias("date"), F.lit(False).alias("manifest"))
    kinds = kinds.select(F.col("x.family").alias("family"), F.col("x.version").alias("version"), none("x").alias("p"), none("y").alias("q")).where(F.coalesce(compare("p", "q"), F.lit(0)) == 0).select("family", "version").distinct()
    return pairs.select("a.*").alias("d").join(kinds.alias("k"), (F.col("d.family") == F.col("k.family")) & F.col("d.version").eqNullSafe(F.col("k.version")), "left_semi")


def draft_similarity(a: str, b: str) -> float:
    """difflib ratio of two core names; 0 for short ones or where digit runs differ."""
    import difflib

    if min(len(a), len(b)) < 8 or re.findall(r"\d+", a) != re.findall(r"\d+", b):
        return 1.0 if a == b else 0.0
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def draft_families(files: DataFrame, threshold: float = 0.85) -> DataFrame:
    """file_id and family_id (the smallest id connected). ``files``: file_id, folder, format, core, family.

    Links: equal families, or names alike within one folder and format group; labels spread until none changes.
    """
    alike = F.pandas_udf(lambda a, b: pd.Series([draft_similarity(x, y) for x, y in zip(a, b)], dtype="float64"), "double", F.PandasUDFType.SCALAR)
    # names are alike only with equal digit runs and, as 2 * the shorter / both says, lengths near each other
    named = files.where("core is not null").withColumn("digits", F.array_join(F.regexp_extract_all("core", F.lit("[0-9]+"), 0), " ")).withColumn("length", F.char_length("core"))
    a, b = (named.select(*(F.col(c).alias(f"{c}_{s}") for c in named.columns)) for s in "ab")
    equal = [F.col(f"{c}_a") == F.col(f"{c}_b") for c in ("folder", "format", "digits")]
    close = 2 * F.least("length_a", "length_b") >= threshold * (F.col("length_a") + F.col("length_b"))
    near = a.join(b, [*equal, F.col("file_id_a") < F.col("file_id_b"), close])
    near = near.where(alike("core_a", "core_b") >= threshold).select(F.col("file_id_a").alias("x"), F.col("file_id_b").alias("y"))
    first = files.where("family is not null").withColumn("y", F.min("file_id").over(Window.partitionBy("family"))).select(F.col("file_id").alias("x"), "y").where("x <> y")
    edges = near.unionByName(first)
    edges = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).checkpoint()
    labels = files.select("file_id", F.col("file_id").alias("family_id"))
    while True:
        low = edges.join(labels, edges.y == labels.file_id).groupBy("x").agg(F.min("family_id").alias("low"))
        new = labels.join(low, labels.file_id == low.x, "left").select("file_id", F.least("family_id", "low").alias("family_id"), (F.col("low") < F.col("family_id")).alias("moved")).checkpoint()
        labels = new.select("file_id", "family_id")
        if new.where("moved").isEmpty():
            return labels

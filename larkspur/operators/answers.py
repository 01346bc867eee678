"""Question answering over ranked evidence: prompts, answers, citations, refusals, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as t

GROUNDED = "answer string, cited_context_ids array<int>, insufficient_evidence boolean"
EXTERNAL = ("public",)
REASONS = ("OUT_OF_SCOPE", "NO_EVIDENCE", "MODEL_REFUSED")
#: Patterns of requests about a person, a scan or a result. A subject and a request together, or a phrase that
#: is a request by itself; Korean and English. BASELINE is the older single pattern, kept to be measured against.
KO_SUBJECT = (
    r"(?<![가-힣])(이|그|저|우리|제|내)\s*(환자|영상|사진|CT|MRI|MR|PET|스캔|결절|병변|종양|림프절|검사|판독지|"
    r"결과지)|아버지|어머니|엄마|아빠|남편|아내|할머니|할아버지|가족|아들|딸"
)
KO_REQUEST = (
    r"판독|진단|처방|"
    r"(암|악성|양성|전이|재발|진행)(인가요|인지|일까|이에요|예요|일 확률|맞나요|인 거죠)|"
    r"(치료|약|항암제?|요법)(를|을)?\s*(바꿔|중단|그만|계속|추천|결정)|"
    r"(써도|맞아도|먹어도|투여해도|받아도)\s*(되|괜찮)|용량을?\s*(얼마|몇)|몇\s*mg|"
    r"수술해야|조직검사를?\s*해야|얼마나\s*(사실|살)"
)
KO_PHRASE = (
    r"(판독|진단|처방)\s*해\s*(줘|주세요|줄래|달라|주실)|처방해야|"
    r"(결절|병변|종양|종괴)(이|가)\s*(있나요|있어요|보이나요|맞나요)|"
    r"(암|악성)(인지|인가요|일까요?)\s*(알려|봐|판단)?|"
    r"(재발|전이|가성진행)(인지|일까요?)\s*(봐|알려|판단|구분)"
)
EN_SUBJECT = r"\b(my|our|this|the attached|the patient i)\s+(patient|scan|ct|mri|pet|x-ray|nodule|lesion|report|mother|father|dad|mom)"
EN_REQUEST = (
    r"\b(read|interpret)\s+(this|my|the attached)\b|\bdiagnose\b|"
    r"\bshould\s+(i|we)\s+(stop|continue|start|switch|change|give|escalate|prescribe)\b|"
    r"\bis\s+(it|this|the \w+)\s+(cancer|malignant|benign)\b|"
    r"\bwhat\s+(dose|drug|regimen)\b.*\b(i|we|my|our)\b|\bhow long does (my|our)\b"
)
REQUEST = rf"(({KO_SUBJECT}).*({KO_REQUEST}))|({KO_PHRASE})|({EN_SUBJECT})|({EN_REQUEST})"
BASELINE = (
    r"(결절|병변|종양|암\s*(이|인지|일까|여부)|악성|양성인지|"
    r"진단(해|을\s*내려|명)|판독\s*(해|결과|소견)|소견(을|이)\s*(알려|뭐)|"
    r"처방|투약|복용|용량을|치료\s*(방법|법|해야)|어떤\s*약)"
)


def source_label(file: Column, edition: Column, page: Column, section: Column) -> Column:
    """``file · edition / p.N / section: title``, parts that are NULL left out."""
    name = F.concat_ws(" · ", file, edition)
    return F.concat_ws(" / ", name, F.concat(F.lit("p."), page.cast("string")), F.concat(F.lit("section: "), section))


def prompts(evidence: DataFrame, questions: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """query_id and prompt: numbered evidence blocks in rank order, a separator, the question.

    ``evidence``: query_id, rank, label, text - a few rows for each question, as the top k bounds them.
    """
    block = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] source: "), F.col("label"), F.lit("\n"), F.col("text")).alias("block"))
    blocks = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    joined = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    return questions.join(blocks, "query_id").select("query_id", F.concat(joined, F.lit(f"{separator}Question: "), F.col("question")).alias("prompt"))


def parse_grounded(raw: Column) -> Column:
    """The structured answer, or NULL where the JSON lacks a field of the schema."""
    parsed = F.from_json(raw, GROUNDED, {"mode": "PERMISSIVE"})
    return F.when(parsed["answer"].isNotNull() & parsed["cited_context_ids"].isNotNull() & parsed["insufficient_evidence"].isNotNull(), parsed)


def cited(answers: DataFrame, refusal: str) -> DataFrame:
    """Adds cited (0-based) and citation_mode to rows of answer, structured_ids (1-based or NULL) and n_contexts:
    structured ids, else marks in the text, else everything retrieved, else none for a refusal."""
    valid = F.array_distinct(F.filter(F.transform(F.coalesce("structured_ids", F.array().cast("array<int>")), lambda i: i - 1), lambda i: (i >= 0) & (i < F.col("n_contexts"))))
    parsed = t.citations(F.col("answer"), F.col("n_contexts"))
    every = F.when(F.col("n_contexts") > 0, F.sequence(F.lit(0), F.col("n_contexts").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    out = answers.withColumn("_v", valid).withColumn("_p", parsed).withColumn("_r", t.is_refusal(F.col("answer"), refusal))
    mode = F.when(F.col("_r"), "none").when(F.size("_v") > 0, "structured").when(F.size("_p") > 0, "parsed").otherwise("retrieved")
    out = out.withColumn("citation_mode", mode)
    ids = F.when(F.col("citation_mode") == "structured", F.col("_v")).when(F.col("citation_mode") == "parsed", F.col("_p")).when(F.col("citation_mode") == "retrieved", every).otherwise(F.array().cast("array<int>"))
    return out.withColumn("cited", ids).drop("_v", "_p", "_r")


def refusal_reason(out_of_scope: Column, n_evidence: Column, model_refused: Column) -> Column:
    """The first reason that holds, in order of precedence; NULL where the question was answered."""
    return F.when(out_of_scope, REASONS[0]).when(n_evidence == 0, REASONS[1]).when(model_refused, REASONS[2])


def is_partial(insufficient: Column, n_cited: Column, refused: Column, allowed: bool = True) -> Column:
    return F.lit(allowed) & F.coalesce(insufficient, F.lit(False)) & (n_cited > 0) & ~F.coalesce(refused, F.lit(False))


def superseded(sources: Column) -> Column:
    """Names of cited sources that are not the latest edition, once each, in order. Elements: name, is_latest."""
    return F.array_distinct(F.transform(F.filter(sources, lambda s: ~F.coalesce(s["is_latest"], F.lit(True))), lambda s: s["name"]))


def allows_external(classification: Column, allowed: tuple[str, ...] = EXTERNAL) -> Column:
    """Whether text of this classification may go to an external provider; NULL may not."""
    return F.coalesce(classification.isin(*allowed), F.lit(False))


def blocked_corpora(documents: DataFrame, allowed: tuple[str, ...] = EXTERNAL) -> DataFrame:
    """Corpora with any classification that an external provider may not see."""
    return documents.select("corpus", "classification").distinct().groupBy("corpus").agg(F.bool_or(~allows_external(F.col("classification"), allowed)).alias("blocked"))


def check_provider(provider: str, known: tuple[str, ...], external: tuple[str, ...], corpora: DataFrame | None = None, corpus: str | None = None) -> None:
    """At start-up: the provider is known, and an external one only meets a corpus that it may see."""
    if provider not in known:
        raise ValueError(f"no provider {provider}; known are {', '.join(known)}")
    if provider in external and corpora is not None:
        blocked = blocked_corpora(corpora).where("blocked")
        blocked = blocked if corpus is None else blocked.where(F.col("corpus") == corpus)
        if not blocked.isEmpty():
            raise PermissionError(f"{provider} is external and may not see every document of the corpus")


def request_scope(question: Column, pattern: str = REQUEST) -> Column:
    """Whether the out-of-scope request pattern occurs, case aside."""
    return question.rlike(f"(?iu){pattern}")


def scope_decision(question: Column, margin: Column, threshold: float, classifier: str = "full") -> Column:
    """Struct of out_of_scope and method. full: the request pattern, else the margin of exemplars from ``threshold`` on;
    regex: the pattern alone; baseline: the older pattern alone; off: nothing is out of scope."""
    if classifier not in ("full", "regex", "baseline", "off"):
        raise ValueError(f"no classifier {classifier}")
    by_pattern = {"off": F.lit(False), "baseline": request_scope(question, BASELINE)}.get(classifier, request_scope(question))
    by_margin = F.coalesce(margin >= threshold, F.lit(False)) if classifier == "full" else F.lit(False)
    method = F.when(by_pattern, "regex").when(by_margin, "embedding").otherwise("none")
    return F.struct((by_pattern | by_margin).alias("out_of_scope"), method.alias("method"))


def log_rows(asked: DataFrame) -> DataFrame:
    """Rows of the request log; scores rounded to four places. ``sources``: array of (chunk_id, score)."""
    rounded = F.transform("sources", lambda s: F.struct(s["chunk_id"].alias("chunk_id"), F.round(s["score"], 4).alias("score")))
    return asked.select("question", F.transform("sources", lambda s: s["chunk_id"]).alias("retrieved_chunk_ids"), "answer", rounded.alias("sources"), "refusal_reason")

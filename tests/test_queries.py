import pytest

from larkspur.queries import ORACLE_SQL, QUERIES
from tests import oracle


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    oracle.check(spark, QUERIES[name], ORACLE_SQL[name])


def test_approximate_search_has_high_recall(spark):
    near = {(r.query_id, r.item_id) for r in QUERIES["vector_ann"](spark, oracle.DATA).collect()}
    exact = {(r.query_id, r.item_id) for r in QUERIES["vector_topk"](spark, oracle.DATA).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_html_sections_lose_no_words(spark):
    rows = QUERIES["html_sections"](spark, oracle.DATA).collect()
    assert rows and all(r.error_type is None and r.text and "<" not in r.text for r in rows)


def test_evidence_is_sought_to_its_end(spark, tmp_path):
    item = "a" * 20 + " opening words of the item that many texts share, then its own end"
    spark.createDataFrame([(1, item), (2, item[:60] + " another end"), (3, "absent")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, f"before\n{item.replace(' ', '  ')} after"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.item_id: r.found for r in QUERIES["evidence_locator"](spark, str(tmp_path)).collect()} == {1: True, 2: False, 3: False}


def test_hybrid_retrieval_equals_plain_python(spark):
    import math

    from larkspur.functions import text as t

    read = lambda name: spark.read.parquet(f"{oracle.DATA}/{name}.parquet").collect()
    docs = {r.doc_id: r for r in read("documents")}
    vectors = {r.vec_id: r.embedding for r in read("embeddings")}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    items = [i for i in vectors if i // 2 in docs and (i // 2) % 7 and (i // 2) % 5]
    got = QUERIES["hybrid_retrieval"](spark, oracle.DATA).collect()
    asked = {r.conv_id: r.text for r in read("conversations") if r.turn == 0 and r.conv_id % 50 == 0 and r.conv_id in vectors}
    assert asked and {r.query_id for r in got} == set(asked)
    for q, question in asked.items():
        score = {i: cosine(vectors[i], vectors[q]) for i in items}
        lexical = {i: t.best_extent(question, docs[i // 2].text or "") for i in items}
        a = sorted(items, key=lambda i: (-score[i], i))[:20]
        b = sorted(items, key=lambda i: (-lexical[i], -score[i], i))[:20]
        place = lambda x, i: x.index(i) + 1 if i in x else 10**9
        rrf = {i: sum(1 / (60 + x.index(i) + 1) for x in (a, b) if i in x) for i in {*a, *b}}
        want = sorted(rrf, key=lambda i: (-rrf[i], place(a, i), place(b, i)))[:5]
        assert [r.item_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_keyword_coverage_of_letters_with_long_capitals(spark, tmp_path):
    ends = ["geß.", "Straß", "ß", "ẞ", "of οδος", "ΟΔΟΣ", "Σ", "ἐν ᾧ", "ﬁ", "xﬃ", "ŉ", "ΰ", "İb ıb", "xİ", "ıb İb", "ſt", "naïve 🙂", "the end", "", " ", None]
    rows = [(k, turn, text) for k, text in enumerate(ends) for turn in (1, 2)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    frame = spark.read.parquet(f"{tmp_path}/conversations.parquet").toPandas()
    want = oracle.duckdb.connect().from_df(frame).query("conversations", ORACLE_SQL["keyword_coverage"]).df()
    assert oracle.rows(QUERIES["keyword_coverage"](spark, str(tmp_path)).toPandas()) == oracle.rows(want)

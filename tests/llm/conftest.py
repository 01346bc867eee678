import pytest

#: Shapes that every operator must take: nulls, empty and long texts, ties, repeated rows.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, and then the dog sleeps again.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "  \t\n ", "en", None),
    (5, "The  quick brown fox jumps\nover the lazy dog, and then the dog sleeps again.", "en", "b"),
    (6, "long words " * 4000 + "naïve 漢字 🙂 end", "xx", "a"),
    (7, "x", None, "b"),
    (7, "x", None, "b"),
    (9, "The quick brown fox jumps over the lazy dog, and then the dog sleeps again.", "en", "a"),
    (None, "no id at all", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with extra columns whose names operators might use themselves."""
    names = "kept string, score double, n long, own string, slot long, hit string, M_ID long, rid string, text_hash string, q_words string, Q_counts long, `_q_text` string, `drop` int"
    rows = [(*r, "extra", 1.5, 3, "mine", 7, "h", 8, "r", "t", "w", 9, "q", 1) for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {names}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")

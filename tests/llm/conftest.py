import pytest

#: Extra columns whose names clash with those that operators make.
CLASH = "score string, predicted string, cls string, text2 string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows, and clashing columns."""
    long = "word and more of it, " * 20_000
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, long), (4, "same text here twice over"), (5, "same text here twice over"), (5, "same text here twice over"), (None, "no id at all"), (6, "é"), (7, "日本 😀 text\x00"), (8, "!!!")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", "s", len(t or ""), "x", "y", "z", "w") for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

import pytest

#: Ids null, repeated and negative; texts null, empty, blank, very long and repeated.
LONG = "long " * 30000 + "ende"
ROWS = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (1, "the cat sat on the mat"), (None, "no id here but a text that has words"), (-7, "Der Hund liegt auf dem Sofa"), (8, "日本語のテキスト é ü"), (9, "1234 !!! ???")]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", 0.5) for i, t in ROWS], "doc_id long, text string, lang string, source string, _text string, _id string, score double")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)

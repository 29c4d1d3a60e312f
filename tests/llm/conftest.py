import pytest
from llm_helpers import DOCS, prose


@pytest.fixture(scope="session")
def odd_rows():
    """Null and clashing ids, null, empty, blank and very long texts, null languages and sources, repeated rows."""
    long = prose(1, 20_000)
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "b"), (4, long, "en", None), (4, long, "en", None),
        (None, prose(2, 60), "de", ""), (None, prose(2, 60), "de", ""), (None, prose(3, 60), None, None), (5, prose(4, 300), "xx", "a"),
        (5, prose(5, 300), "fr", "b"), (6, "x" * 50_000, "en", "a"), (7, "two words", "es", "c"), (8, "!!! ### ...", "en", "c"), (9, "!!! ### ??", "en", "c"),
        (10, 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b 9807915762804490 c', "en", "a"), (11, "naïve \U0001f600 \u2028 text\u00a0here", "fr", "a"),
    ]
    return [(i, t, g, s, None if t is None else len(t), "s", "r", "k", "b", "f", 1, 2) for i, t, g, s in texts]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

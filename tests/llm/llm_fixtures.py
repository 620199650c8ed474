"""Fixtures shared by the tests of this folder."""

import pytest

SF = "/root/testdata/sf0.001"



@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use inside."""
    long_ = " ".join(f"w{i % 997} v{i}" for i in range(20000))
    copy = " ".join(f"copy{i}" for i in range(80))
    data = [(1, None, None, None), (None, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", "a"),
            (5, long_, "en", "a"), (6, copy, "en", "a"), (7, copy, "en", None), (7, copy, "en", None), (None, copy, None, "a"),
            (8, copy + " end", "en", "a"), (8, "other text of the same id", "en", "a"), (9, "x " * 300, "en", "a"),
            (10, "reach me at joe@mail.example.org or 10.1.2.3", "en", "a")]
    schema = ("doc_id long, text string, lang string, source string, row int, kind int, h int, n int, _doc int, _vertex int, "
              "_spans int, vertex int, mark int, spans int, words int, length int, score int, n_words int, kept int")
    return spark.createDataFrame([(*d, *[0] * 15) for d in data], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string"

#: Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names.
ODD = [
    (1, None, None, None, None, None, "x"),
    (2, "", "en", "a", 0, "no", None),
    (3, "one", "en", "a", 3, None, None),
    (3, "one", "en", "a", 3, None, None),
    (None, "two words", "en", None, 9, None, None),
    (4, "The cat sat on the mat. " * 40, "en", "b", None, None, None),
    (5, "the CAT sat on the mat. " * 40, "en", "b", None, None, None),
    (6, " ".join(f"word{i}" for i in range(30000)), "en", "c", None, None, None),
    (7, "a\tb\x0bc\nd  e f g \U0001f600 \x00h", "en", "c", None, None, None),
    (8, "x\n\nx\nx \ny\nx\n \n", "en", "c", None, None, None),
    (9, "x" * 3000, "en", "", None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

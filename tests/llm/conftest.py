import pytest

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", "\n\n", "a", "A a\tA", "x" * 60_000, "word " * 30_000, "é ü 😀\r\n", "<|endoftext|> tail", "a\x1cb\x85c"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, None, "s", 0, "clash", -1) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[4], (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, group_size long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

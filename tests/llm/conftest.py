import hashlib

import pytest

#: Rows that every operator on documents must stand: null and empty texts, repeats, ties, long texts, clashing extra columns.
ODD_ROWS = [
    (1, None, "en", "a", 0, "x"),
    (2, "", "en", "a", 0, "x"),
    (3, "  \n ", None, None, 3, None),
    (4, "one", "en", "b", 3, "x"),
    (5, "the same text in two rows", "en", "b", 9, "x"),
    (6, "the same text in two rows", "en", None, 9, "x"),
    (7, "a row that repeats whole", "de", "b", 9, "x"),
    (7, "a row that repeats whole", "de", "b", 9, "x"),
    (8, "word " * 30_000, "en", "a", 9, "x"),
    (None, "a row without an id", None, None, None, None),
    (9, "Ünïcödé — 漢字 😀 MIT License", "en", "c", 9, "x"),
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame(ODD_ROWS, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return spark.createDataFrame([], odd_documents.schema)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Write named DataFrames as a folder of tables, like the test data."""

    def write(**frames):
        root = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(f"{root}/{name}.parquet")
        return str(root)

    return write


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()

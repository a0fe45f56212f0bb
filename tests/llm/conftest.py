import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing further columns."""
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [
        (1, "The first line of five words.\nAnother line of five words.", "en", "a", 10),
        (2, "The first line of five words.\nAnother line of five words.", "en", "a", 10),
        (2, "The first line of five words.\nAnother line of five words.", "en", "a", 10),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (5, long, "de", "b", len(long)),
        (None, "A text without an id and token = \"abcdef1234567890\".", None, "a", 5),
        (None, None, None, None, None),
        (6, "  \n\n \t ", "fr", "c", 7),
        (7, "x" * 50_000, "fr", "c", 50_000),
        (8, "Released under the MIT License.\nyou idiot", "en", None, 9),
    ]
    wide = [(*r, i, "t", 1.0, "g", [1], "s", 3, 4, "k") for i, r in enumerate(rows)]
    more = "size int, target string, score double, __gone string, ids array<int>, source_size string, copies int, fp long, __key string"
    return spark.createDataFrame(wide, f"{DOCS}, {more}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 0), (8, 1, 1), (8, None, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

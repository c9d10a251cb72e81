import pytest

LONG = " ".join(f"w{i}" for i in range(200))
OTHER = " ".join(f"v{i}" for i in range(120))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty texts, ties, repeated rows, and other columns with clashing names."""
    rows = [
        (1, LONG, "en", "a"),
        (2, LONG, "en", "a"),
        (3, OTHER + "\n" + LONG, "fr", None),
        (3, OTHER + "\n" + LONG, "fr", None),
        (4, None, None, "b"),
        (5, "", "de", "b"),
        (6, " \t\n\r\x0b\x0c ", "de", "a"),
        (7, "x", None, None),
        (8, "x\n\nx\ny y y\nx\n\nx\n" + "ab cd " * 40, "en", "c"),
        (None, "no id here, twice\nand\nmore", "en", "c"),
        (None, None, None, None),
        (9, "é🙂 ñandú 12%% $& " * 30, "es", "c"),
        (10, "word " * 5000, "en", "a"),
    ]
    frame = spark.createDataFrame(
        [(*r, "pos", "node", i) for i, r in enumerate(rows)],
        "doc_id long, text string, lang string, source string, TEXT string, node string, bucket long",
    )
    return frame


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")

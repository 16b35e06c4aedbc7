import tempfile

import pytest

from stopwise.llm.common import shipped


@pytest.fixture(scope="session", autouse=True)
def package_on_workers(spark):
    return shipped(spark)


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns that clash."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "a b c d e f g h i j", "en", "s1", 19),
        (2, "a  b c d e\tf g h i j", None, None, None),
        (2, "a  b c d e\tf g h i j", None, None, None),
        (3, None, "en", "s1", 0),
        (4, "", "en", "s1", 0),
        (5, " \n\t", "en", "s1", 3),
        (None, "some text without an id", "en", "s1", 23),
        (None, None, None, None, None),
        (6, long, "en", "s1", len(long)),
        (7, long + " end", "en", "s1", len(long) + 4),
        (8, "Ünïcödé " * 60 + "漢字", "de", "s2", 482),
    ]
    extra = ", row long, key long, sign long, packed string, score double, n string"
    return spark.createDataFrame([(*r, 7, 7, 7, "x", 0.5, "y") for r in rows], DOCS + extra)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

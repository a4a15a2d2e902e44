import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def words(seed, n, base=40):
    """A deterministic text of n invented words."""
    import random

    r = random.Random(seed)
    return " ".join("w" + format(r.randrange(base**2), "x") for _ in range(n))


#: doc_id, text, lang, source, and columns whose names clash with those of results and helpers.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, keep_id int, size double, `of` string, text_sha256 string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing columns."""
    long_text = words(1, 20000)
    near = words(2, 400)
    rows = [
        (1, words(3, 30), "en", "b"), (2, words(3, 30), "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, "   \n\t ", None, "b"), (6, long_text, "de", None),
        (7, long_text, "de", "c"), (8, near, "en", "c"), (9, near + " end", "en", "c"), (9, near + " end", "en", "c"), (None, "one word", "en", "a"), (None, None, None, None),
        (10, "single", "fr", "é"), (11, "UPPER lower", "fr", "Z"), (-5, words(3, 30), None, "a"), (12, "naïve ünïcode ▁ text  two spaces\nline", "de", "a"),
    ]
    return spark.createDataFrame([(*r, None, "x", None, 1.5, None, "y") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

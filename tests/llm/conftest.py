import pytest

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "a", 1),
    (2, None, "en", "a", 1),
    (3, "", None, None, 0),
    (4, "word", "de", "b", 4),
    (5, "the quick brown fox jumps over the lazy dog " * 3, "en", "b", 1),
    (5, "the quick brown fox jumps over the lazy dog " * 3, "en", "b", 1),
    (6, " ".join(f"w{i}" for i in range(60_000)), "en", "a", 1),
    (None, "no id but words", "fr", "c", 1),
    (7, "tabs\tand\nlines\nlines\n\nend é ß", "de", "c", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ties, with columns whose names clash with those the operators use."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"size": F.lit("x"), "label": F.lit("y"), "n": F.lit(1), "node": F.lit(2), "score": F.lit(0)})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

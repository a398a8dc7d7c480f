import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and blank texts, repeated rows, ties, a very long text and clashing extra columns."""
    long = " ".join(f"w{i % 97} x{i % 89}" for i in range(30_000)) + "."
    rows = [
        (1, "The cat sat on the mat and it was good. " * 4, "en", "a", 1), (2, None, "en", None, 2), (3, "", None, "a", 3), (4, " \n\t\n ", "de", "b", 4), (5, long, "en", "a", 5),
        (1, "The cat sat on the mat and it was good. " * 4, "en", "a", 1), (None, "No id here but some words are.", "en", "b", 6), (7, "Ünïcödé ▁ 漢字 \x00 <|endoftext|> don't.\nsecond line", "fr", "c", 7), (8, "second line\nTHIRD line", "fr", "c", 8),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("id", "fp", "h", "mark", "fingerprint", "n_lines", "score", "key", "ids")})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")

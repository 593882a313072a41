import pytest

#: Null, empty, very short, repeated and very long texts; equal ids; a null id; odd characters.
ODD = [
    (1, None, "en", "s1"),
    (2, "", "en", "s1"),
    (3, "one", None, None),
    (3, "one", "fr", "s2"),
    (3, "two words", "fr", "s2"),
    (None, "the words of a row without an id", "en", "s1"),
    (4, " \t\n\r\x0b\x0c ", "en", "s2"),
    (5, "İSTANBUL ΣΑΣ été naïve ﬁ 日本語 <|endoftext|> x", "en", "s2"),
    (6, "a b c d e f. " * 6000, "en", "s1"),
    (7, "x" * 70000, "en", "s1"),
    (8, "1234 5678 ### $$$", "de", "s3"),
    (9, "the same text of some words. It ends here.", "en", "s3"),
    (10, "the same text of some words. It ends here.", "en", "s3"),
    (2**40, "far away id with words", "en", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with every awkward case, and extra columns whose names clash with those the operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    clash = ("ids", "score", "start", "segment", "media", "run", "n", "words", "n_chars", "recipe", "h", "key", "part")
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

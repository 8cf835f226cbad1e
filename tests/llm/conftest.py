import pytest

#: Texts that every operator must survive: nulls, empties, white space, ties, odd characters, a long one.
AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (4, "one", "en", "b", 3),
    (5, "one two", None, "a", 7),
    (6, "the quick brown fox jumps over the lazy dog " * 12, "en", "a", 528),
    (7, "the quick brown fox jumps over the lazy dog " * 12, "en", "b", 528),
    (7, "the quick brown fox jumps over the lazy dog " * 12, "en", "b", 528),
    (8, "THE QUICK brown fox jumps over the lazy dog\n" * 12, "en", None, 528),
    (9, "naïve café 日本語 🙂 <|endoftext|> ́‍" * 9, "fr", "c", 99),
    (10, "x" * 200_000, "de", "c", 200_000),
    (None, "a null id", "de", "c", 9),
    (-5, "one", "de", None, 3),
    (11, "%%% $$$ ### &&& ***\n" * 30, "en", "a", 600),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows, with extra columns whose names operators use inside."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    for name in ("id", "key", "row", "size", "fp", "tag", "ord", "salt", "score", "kept", "f", "ids"):
        df = df.selectExpr("*", f"'extra' AS {name}")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")

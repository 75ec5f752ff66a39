import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, clashing extra columns."""
    words = " ".join(f"word{i} thing" for i in range(3000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (None, "a text without any id, but with words", None, "b", 5),
        (5, words, "en", "c", len(words)),
        (6, "x" * 100_000, "de", "c", 100_000),
        (7, "été\n\n\n日本語 🎉 \u0085 zwölf", "fr", "d", 3),
        (8, "\n\n", None, "d", 2),
        (9, "12345 67890", "es", "d", 11),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("_id", "_text", "key", "kept", "piece", "bands", "_lx_key", "length"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Awkward rows: nulls, empty and long texts, repeated rows, columns whose names the operators use themselves."""
    prose = "The quick brown fox and the lazy dog went to the river that was in the valley of the old mill. "
    rows = [
        (1, prose * 3, "en", "a", 1, "x"),
        (1, prose * 3, "en", "a", 1, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, "x"),
        (4, " \n\t ", "de", "b", 0, None),
        (None, "Der schnelle Fuchs und die alte Mühle in dem Tal mit der Brücke und den Bäumen", "de", "b", 9, "y"),
        (None, None, "de", None, None, "z"),
        (5, "one two", "en", "a", 7, "y"),
        (6, "1234 5678 --- 9", None, "a", 7, "y"),
        (7, "word " * 20_000, "en", "a", 7, "y"),
        (8, prose * 3 + "End.", "en", "c", 1, "y"),
        (9, "ÉTÉ \U0001f642 <|endoftext|> ▁ it's  \n\n ok", "fr", "c", 1, "y"),
        (10, "x" * 5_000, "en", "c", 1, "y"),
    ]
    schema = "doc_id long, text string, lang string, source string, words int, `row` string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(spark, documents):
    return documents.where("false")

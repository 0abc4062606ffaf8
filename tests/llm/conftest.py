import pytest

ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 0), (4, "word", "en", "b", 4), (5, "42 !! 7", None, "b", 7),
    (6, "Ünï çödé ça va où été <|endoftext|> it's  two   spaces   nbsp", "fr", None, 30), (7, "the idiot and the clown " * 300, "en", "a", 1), (7, "the idiot and the clown " * 300, "en", "a", 1),
    (8, "the cat sat on the mat and the dog ran to the hill " * 40, "en", "a", 1), (9, "the cat sat on the mat and the dog ran to the hill " * 39 + "the end", "en", "a", 1),
    (None, "a row without an id but with some words in it to read", "en", "a", 1), (11, "x" * 60_000, "de", "c", 1), (12, "der hund und die katze gehen in den wald " * 20, "de", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and columns whose names an operator might want itself."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("contamination", "fp", "mix", "n_words", "score", "key", "id", "kept_id", "text_of", "th"):
        df = df.selectExpr("*", f"'mine' AS {name}")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

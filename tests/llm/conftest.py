import pytest

TABLES = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, ties, repeats, a very long text, letters beyond ASCII.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "ONE"), (7, "one two"), (8, "ÄÖ ß   ǅ"),
    (9, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3), (10, "same " * 500), (11, "same " * 37),
    (12, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (13, "x\x00y\x7fz. 12,3"), (14, "lorem ipsum " * 30_000),
    (15, "\U0001f600 " * 25), (16, "A B C D E F G H I J K L M N O P Q R S T"),
]


@pytest.fixture()
def documents(spark):
    """Documents with extra columns whose names clash with those of results."""
    def make(rows):
        return spark.createDataFrame(
            [(d, t, "en", "x", 0, "y", 1) for d, t in rows],
            "doc_id bigint, text string, lang string, n_words string, n_chars bigint, fp string, component_id int")

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture()
def rows_of():
    return lambda df, *columns: {tuple(r) for r in df.select(*columns).collect()}

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = ("the quick brown fox jumps over a lazy dog while seven wise owls watch from their old oak "
         "tree and count every falling leaf of the long autumn").split()


def prose(n: int, step: int = 1, at: int = 0) -> str:
    return " ".join(WORDS[(at + i * step) % len(WORDS)] + str((at + i) // 7) for i in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = prose(30_000, 3)
    return [
        (1, prose(60), "en", "a", 1),
        (2, prose(60), "en", "b", 1),  # a copy
        (2, prose(60), "en", "b", 1),  # a repeated row
        (3, None, "en", "a", None),
        (4, "", None, "a", 0),
        (None, prose(40, 5, 3), "en", None, 9),
        (None, None, None, None, None),
        (5, long, "en", "c", len(long)),
        (6, "12 34 !!", "de", "c", 8),
        (7, "é", "fr", "b", 1),
        (8, prose(60) + " tail", "en", "a", 2),
        (9, "\t\n ", "en", "c", 3),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()

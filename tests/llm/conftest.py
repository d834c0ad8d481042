import pytest

EDGE = [(1, "", "x"), (2, None, None), (None, "one two three four five six seven eight nine ten eleven", "n"),
        (4, "one two three four five six seven eight nine ten eleven", "a"),
        (4, "one two three four five six seven eight nine ten eleven", "a"), (5, " \t\n ", "b"), (6, "word " * 30000, "c")]


@pytest.fixture()
def edge(spark):
    """Nulls, empty, repeated and very long texts, with columns whose names clash."""
    return spark.createDataFrame([(*r, 7, "q", 1) for r in EDGE],
                                 "doc_id bigint, text string, node string, n_words int, quality string, root int")


@pytest.fixture()
def nothing(spark, edge):
    return edge.limit(0)

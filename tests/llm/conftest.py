import pytest

#: Rows that every text operator must take: nulls, empty and very long texts, repeated rows, odd white space.
AWKWARD = [
    (1, "The river ran low that year and the boats lay dry on both of its banks."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "12345 --- !!!"),
    (6, "word " * 40_000),
    (7, "The river ran low that year and the boats lay dry on both of its banks."),
    (7, "The river ran low that year and the boats lay dry on both of its banks."),
    (None, "A row without an id."),
    (8, "é漢字😀   ß x"),
    (9, "short"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward rows with extra columns whose names operators may use themselves."""
    rows = [(i, t, 0.5, "x", [1], True) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score double, node string, ids array<int>, kept boolean")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)

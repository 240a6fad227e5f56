import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls, empty and long texts, ties, repeats and columns that clash with the operators' own names."""
    rows = [
        (1, "the cat sat on the mat", "x"),
        (1, "the cat sat on the mat", "x"),
        (2, None, None),
        (3, "", "y"),
        (None, "a text without an id", "z"),
        (4, "word " * 5000, None),
        (5, "  \n\t ", None),
        (-7, "Ünïcödé 日本語 🙂 café", "x"),
    ]
    rows = [(i, t, o, o, 1.5, 9) for i, t, o in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, words string, score double, n long")

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, rank string, length string, spans string, key string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda " * 12_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty, one-word and very long texts, ties, repeated rows, other scripts, clashing columns."""
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, LONG), (6, "The same text of seven words here"), (7, "The same text of seven words here"), (7, "The same text of seven words here"), (None, "no id but a text of some words"), (8, "日本語 ünïcödé \x00 \x85 ǅ <|endoftext|> 😀"), (9, "\\ <| <|im_end|> #*$%"), (10, "a\x0bb\x0cc\rd")]
    return spark.createDataFrame([(i, t, None, None, None, i, 1, "x", "y", "z", "k") for i, t in texts], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

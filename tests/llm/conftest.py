import pytest


@pytest.fixture
def documents(spark):
    """Nulls, blanks, repeats, copies, a long text, and columns called like results."""
    base = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, base, "a"), (2, base, "a"), (3, base + " phi", "b"), (4, None, "b"), (5, "", None), (6, " \t\n ", "c"), (7, "One two", "c"),
        (8, "Été ça va, l'eau <|endoftext|> 2024!", "a"), (9, "word " * 60_000, "a"), (10, "x" * 200_000, None), (10, "x" * 200_000, None), (None, "lonely text", "c"),
        (12, "the quick brown fox jumps over the lazy dog and then rests under a tree", "b")]
    return spark.createDataFrame(
        [(i, t, "en", s, 0, 1.5, 7, "mine") for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, _text string")


@pytest.fixture
def empty(documents):
    return documents.limit(0)

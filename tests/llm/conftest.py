import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size string, host string, component_id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    words = " ".join(f"Wort{i % 97}x{i % 11}" for i in range(4000))
    prose = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    rows = [
        (0, prose, "en", "b", 1), (1, prose, "en", "b", 1), (1, prose, "en", "b", 1),
        (2, None, None, None, None), (3, "", "de", "a", 0), (4, "one", "de", "a", 3),
        (5, words, "fr", None, 5), (6, prose + " tail", "en", "a", 2), (None, prose, "en", "b", 1),
        (7, "ünïcödé ß x\n\nünïcödé ß x\n\t\nlast # line %", "de", "c", 9), (8, "a b c d e f g h a b c d e f g h " * 9, "en", "c", 9),
        (9, " \t\n ", "en", "c", 4), (10, "😀 " * 30, "en", "\U0001F600", 60),
    ]
    return spark.createDataFrame([r + (7, "s", "h", "c") for r in rows], SCHEMA).repartition(3)

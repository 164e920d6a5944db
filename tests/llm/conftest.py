import pytest

#: Names that operators use inside or return, as columns of the input.
CLASHES = ["fp", "component_id", "slot", "position", "rank", "count", "key", "spans", "_spans", "_fp", "block", "q", "k", "run", "text_id", "held"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def rows_of(rows):
    return [(*r, *["x"] * len(CLASHES)) for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = "Le chat mange la souris verte et " * 4000
    text = "The quick brown fox jumps over the lazy dog and runs away from 10.0.0.1 to me@site.org today"
    rows = [
        (1, text, "en", "a", 10),
        (1, text, "en", "a", 10),
        (2, text, "en", None, None),
        (3, None, "en", "a", 0),
        (4, "", None, "b", 0),
        (5, long, "fr", "b", len(long)),
        (None, "un texte sans identifiant mais avec des mots", "fr", "a", 3),
        (None, None, None, None, None),
        (6, "1234 !!! 5678", "en", "c", 3),
        (7, "é\U0001f389 \x00 a\tb\nc", "fr", "c", 9),
    ]
    return spark.createDataFrame(rows_of(rows), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

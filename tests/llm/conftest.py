import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, k string, key string, set_id string, weight string"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, lang, source) to a table with extra columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", "z", "u", "w") for i, t, lang, s in rows], COLUMNS)

    return make


WORDS = "the of and alpha beta gamma delta house river stone cloud paper light green seven eight north".split()


@pytest.fixture
def prose():
    import random

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "a", "en", "ix", "or"]) + r.choice(["", "t", "s"]) for _ in range(n)) + "."

    return make


@pytest.fixture
def odd_rows(prose):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = prose(6000, 1)
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "   \n\t ", "en", None),
        (4, long, "en", "a"),
        (5, prose(80, 2), "en", "b"),
        (5, prose(80, 2), "en", "b"),
        (6, prose(80, 2), "de", "b"),
        (None, prose(70, 3), "en", "b"),
        (7, "é" * 300 + " 中文 😀", "fr", "c"),
        (8, "x", "fr", "c"),
        (9, "a b", "fr", "c"),
        (10, "|||| ---- 1234 ....", None, "c"),
    ]

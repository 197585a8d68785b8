import pytest

LONG = ("word%d " * 40_000) % tuple(range(40_000))
PASSAGE = " ".join(f"passage{k}" for k in range(30))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, score double, fp long, key string, length long, bunch long, held_out boolean, classes string, _toxic_score double"


def rows():
    texts = [
        None, "", "   \t\n ", LONG, "same text here and there", "same text here and there", f"start {PASSAGE} end", f"another {PASSAGE} finish", "one", "Mail me: joe.doe@mail.example.org or +1 (555) 010-2030.", "same text here and there",
    ]
    out = [(k, t, "en", "s", len(t or ""), 1, 0.5, 7, "k", 3, 4, True, "c", 0.1) for k, t in enumerate(texts)]
    return [*out, out[4], (None, "nameless words of a row", *[None] * 12)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with the operators' own names."""
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

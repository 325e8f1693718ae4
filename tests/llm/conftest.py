import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, words array<string>, block int, kept string"


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows; extra columns with the names of results."""
    extra = (7, -1, ["x"], 3, "no")
    words = [f"w{k % 97}{'abcdefg'[k % 7]}" for k in range(12_000)]
    passage = " ".join(f"shared{k} passage" for k in range(30)) + "."
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, "a"), (4, " ".join(words), "en", None),
        (5, "One short line.", "en", "a"), (6, "One short line.", "en", "b"), (7, "!!! ### $$$", "de", "a"),
        (8, f"Begin here now.\n{passage}\nAnd an end of it.", "en", "a"), (9, f"Other words first.\n{passage}\nMore.", "en", "a"),
        (9, f"Other words first.\n{passage}\nMore.", "en", "a"), (10, "a b " * 300, "fr", "b"), (11, "été 中文 \U0001f600<|endoftext|>", "zh", "b"),
        (None, "No number here, only text.", "en", "b"), (None, None, None, None), (12, "x" * 5000, "en", "a"),
    ]
    return [(*r, *extra) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

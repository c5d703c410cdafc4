import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog " * 12),
    (2, "The quick brown fox jumps over the lazy dog " * 12),
    (3, None),
    (4, ""),
    (None, "a row without an id, and a few more words to go with it"),
    (5, " \t\n "),
    (6, "one"),
    (6, "one"),
    (7, "x" * 200_000),
    (8, "same line\n" * 3000),
    (9, "naïve café – 漢字 😀 \x01 \x00 <|endoftext|> it's 's É"),
    (10, " ".join(f"w{i}" for i in range(30_000))),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeats, ties, and columns whose names clash with the operators' own."""
    rows = [(i, t, None if i == 2 else f"s{(i or 0) % 3}", "w", 1, "h") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, word string, block int, `__key` string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, label int, s string, n int, score double"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["the", "stone", "river", "over", "light", "and", "winter", "garden", "of", "table", "quiet", "runs"]) + r.choice(["", "", "s", "ed", ","]) for _ in range(n))


def texts() -> list[str | None]:
    long = prose(1, 200)
    near = long.replace("river", "lake", 1)
    return [None, "", " \t\n\x0b\x0c\r", "a", "A  b", "ab", long, long, " " + long, near, long.upper(), prose(2, 120), prose(2, 120) + " tail", "é日本 \x00 ▁x", "x" * 3000, prose(3, 4000), "one two three four five", "ONE two  three four five", "1 2 3", "line\n" * 60]


@pytest.fixture(scope="module")
def docs(spark):
    """Every awkward text, a repeated row, and columns whose names clash with the operators' own."""
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or ""), 1, "k", 0, "s", 5, 0.5) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[6]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _dg string, n_words string, score string, rank int"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows; columns that clash with the operators' own."""
    rng = random.Random(3)
    base = [words(rng, 120) for _ in range(6)]
    passage = words(rng, 60, 5000)
    texts: list[str | None] = [None, "", "   \n", "one two", "One TWO", "É é", "É é", *base, base[0], base[0].upper(), base[1].replace("w", "W")]
    edited = base[2].split()
    edited[50] = "changed"
    further = list(edited)
    further[90] = "again"
    texts += [" ".join(edited), " ".join(further), f"{words(rng, 80)} {passage} {words(rng, 80)}", f"{words(rng, 50)} {passage}", passage + " " + words(rng, 40)]
    texts += [words(rng, 4000, 100_000), "a" * 1000, "ab " * 700, "The MIT License here", "Apache-License, General Public License v3 or later"]
    rows = [(k, t, ["en", "fr", None][k % 3], f"s{k % 2}", None, "x", "y", "z", k) for k, t in enumerate(texts)]
    rows.append((None, base[3], "en", None, 1, None, None, None, None))
    rows.append(rows[8])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in odd_rows()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

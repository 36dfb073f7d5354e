import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice(["ta", "ri", "mo", "en", "ül", "sh"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls in any column, empty, very long, repeated and odd texts."""
    rng = random.Random(4)
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [
        (1, None), (2, ""), (3, " "), (4, "\n\n \t"), (5, "a"), (6, long), (7, "x" * 5_000), (8, "mail bob.42@mail1.example.com now"), (8, "mail bob.42@mail1.example.com now"),
        (None, "no id here"), (None, None), (9, "é́ \U0001f600 ﬁ  two  spaces\r\n end "), (10, "same text here"), (11, "same text here"), (12, "<|endoftext|> it's we'll 3.14 ### $$$"),
    ]


@pytest.fixture(scope="session")
def some_rows(words):
    rng = random.Random(5)
    return [(100 + i, ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 14))) for _ in range(rng.randint(1, 30))) + ".") for i in range(120)]

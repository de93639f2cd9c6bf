import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rep long, `key` string, n long, h long, c long, copies long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(["an", "the", "er", "ou", "ti", "on", "ha", "es"], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, shared passages, odd white space."""
    rng = random.Random(1)
    base, passage = words(rng, 200), words(rng, 60)
    out = [(None, None, None, None), (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (None, base, "en", "b"), (4, "12 34", "en", "b"), (5, "one", None, None), (6, "one two", "fr", "b")]
    out += [(10, base, "en", "a"), (11, base, "en", "b"), (12, base.upper(), "en", "b"), (13, base + " tail", "en", "b"), (14, "head " + base, "fr", None), (14, "head " + base, "fr", None)]
    out += [(20 + i, words(rng, 40) + " " + passage + "\x0b" + words(rng, 40), rng.choice(["en", "fr"]), rng.choice("abc")) for i in range(12)]
    out += [(40, words(rng, 20_000), "en", "a"), (41, "x " * 3000, "en", "a"), (42, "É日本 ẞ é " * 30, "de", "c")]
    for i in range(12):  # near copies of one text
        w = words(random.Random(7), 150).split()
        for k in range(i):
            w[(k * 13 + 5) % 150] = f"w{i}{k}"
        out.append((60 + i, " ".join(w), "en", "c"))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, None, 7, 8, "k", 9, 1, 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket long, label int"


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and columns of clashing names."""
    rng = random.Random(3)
    out = []
    for i in range(60):
        text = "\n".join(sentence(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 6)))
        out.append((i, text, "en" if i % 3 else "fr", f"s{i % 4}", len(text), "k", i, 1))
    base = sentence(rng, 120)
    for i in range(60, 66):
        words = base.split(" ")
        words[i % len(words)] = f"edit{i}"
        out.append((i, " ".join(words), "en", "s0", 0, "k", 0, 1))
    out += [(70, None, "en", "s0", None, None, None, None), (71, "", None, None, 0, None, None, None), (72, "   \n\t ", "en", None, 6, "", 0, 0)]
    out += [(73, "one", "en", "s1", 3, "", 0, 0), (74, "One", "en", "s1", 3, "", 0, 0), (75, "é ß 日本語, a  b\n\n c", None, "s1", 3, "", 0, 0)]
    out += [(80, sentence(rng, 30), "en", "s0", 0, "", 0, 0)] * 3  # repeated rows
    out += [(81, sentence(rng, 12_000), "fr", "s2", 0, "", 0, 0), (82, "x" * 100_000, "en", "s2", 0, "", 0, 0)]
    out += [(None, "no id here at all", "en", "s0", 0, "", 0, 0), (-5, base, "en", "s3", 0, "", 0, 0), (2**62, "far", "en", "s3", 0, "", 0, 0)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

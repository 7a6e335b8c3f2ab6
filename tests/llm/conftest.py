"""Small tables with what the operators must bear: nulls, blanks, long texts, repeated rows, clashing columns."""

import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "ti", "vo", "we", "zu") for b in ("ba", "da", "fi", "go", "ha", "je", "ky", "mo")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, null and blank texts, a long one, repeated and id-less rows."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 40)
    words = base.split()
    rows = [(1, base), (2, base), (3, " ".join(words[:60] + ["odd"] + words[61:])), (4, " ".join(words[3:])), (5, base.upper())]
    rows += [(10 + i, f"{prose(rng, 30 + i)} {passage} {prose(rng, 20)}") for i in range(6)]
    rows += [(20, None), (21, ""), (22, " \t\n"), (23, "ka"), (24, "ka"), (25, "one two three four"), (26, "ba " * 90)]
    rows += [(30, prose(rng, 20_000)), (31, "é ü ñ " * 20), (1, base), (None, prose(rng, 50)), (None, None)]
    rows += [(40 + i, prose(rng, 60)) for i in range(10)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if i == 3 else f"s{(i or 0) % 4}", len(t or ""), "clash", 1) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash string, component long"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)

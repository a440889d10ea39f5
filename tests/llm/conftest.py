import random

import pytest

SMALL = "/root/testdata/sf0.001"
WORDS = "the of and a to in is was he for it with as his on be at by i this had not are but from or have an they which".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts of all awkward kinds, with ids that skip."""
    rng = random.Random(3)
    base = [prose(rng, n) for n in (0, 1, 2, 3, 9, 10, 40, 40, 120, 400)]
    base += [base[6], base[8], base[8] + " extra", "One line here, long enough.\n" * 5 + "tail", "É à ß ΑΣ 日本語 mixed TEXT here", " \t\n ", "12345 67890", "....", None, ""]
    base.append("\n".join(prose(rng, 12) + "." for _ in range(800)))
    return [(3 * i + 1, t) for i, t in enumerate(base)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with extra columns whose names clash with inner ones."""
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 5 == 0 else f"s{i % 4}", len(t or ""), i, "x", 1.5) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, row string, h double")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, repeated rows, ties."""
    rows = [(None, "alpha beta gamma delta", "en"), (None, None, None), (5, "alpha beta gamma delta", "en"), (5, "alpha beta gamma delta", "en"), (5, "other words are here", None), (-2, "", "de"), (7, None, "de")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")

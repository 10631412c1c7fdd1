import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size long, row string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "ti", "or", "eu", "sh", "lo", "be"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


def document_rows():
    """Small documents with the awkward cases: nulls in every column, empty
    and blank texts, a long text, exact copies, near copies, repeated rows,
    repeated lines, columns whose names clash with internal ones."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    base = prose(rng, 200).split()
    for k in range(6):
        t = list(base)
        for _ in range(k):
            t[rng.randrange(len(t))] = f"x{k}"
        texts.append(" ".join(t))
    texts += [texts[0], texts[0], "", "   \t\n", None, "one", "one two three", "é ü ß", prose(rng, 6000),
              "\n".join([texts[1], texts[2], texts[1]]), "\n".join([texts[2], prose(rng, 30)]), "a" * 500, "ab" * 300]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), None if t is None else len(t),
             "clash", 7, "clash") for k, t in enumerate(texts)]
    rows.append((None, texts[3], None, None, None, None, None, None))
    rows.append(rows[5])
    return rows


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)

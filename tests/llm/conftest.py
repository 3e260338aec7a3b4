import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, uid string, n int, row_id double, score string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text[, lang, source]), with extra columns whose names operators use inside."""

    def make(rows):
        full = []
        for row in rows:
            doc, text, lang, source = (*row, *[None] * (4 - len(row)))
            full.append((doc, text, lang, source, len(text or ""), 7, "u", 1, 0.5, "s"))
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Nulls, empty and blank texts, repeated rows and ids, odd characters, and a very long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two three four"), (6, "ONE two Three FOUR"), (None, "one two three four"), (7, "é ü 日本 😀 x\x1fy\x85z\xa0"),
    (8, "same words again " * 30), (9, "same words again " * 30), (9, "same words again " * 30), (10, " ".join(f"long{k}" for k in range(30_000))), (None, None), (11, "#### $$ %%\n####\n####\n"),
]


@pytest.fixture
def odd():
    return list(ODD)


def by_null(row):
    return tuple((v is None, v) for v in row)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=by_null)

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rid string, _id string, keep_id string, size int, _text string, kept string, _n int, _block int, _found string"
WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz ba dc fe hg".split()


def rows_of(texts, **columns):
    """Rows of DOCS, with names that clash with the operators' own."""
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, ("en", "de", None)[i % 3], (None, "s1", "s0", "s2")[i % 4], len(t or ""), "x", "y", "z", 7, "w", "v", 3, 4, "u"))
    return out


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(5)
    base = [" ".join(rng.choices(WORDS, k=40)) for _ in range(6)]
    near = []
    for b in base:
        w = b.split()
        for k in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = f"new{k}"
            near.append(" ".join(v))
    long = " ".join(rng.choices(WORDS, k=30_000))
    return [*base, *near, base[0].upper(), base[0], base[1], None, "", None, "   \n\t", "one", "One", "one two three", "x" * 5000, "é漢😀 " * 50, long, long + " tail", "\n".join(["same line here"] * 30), "\x0b\x0c\r odd\x1cblank\x85words\xa0here", "tail"]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """Nulls in every column, empty and very long texts, ties, and repeated rows; ids from 0, then one null id and two repeated rows."""
    rows = rows_of(odd_texts)
    nulls = tuple([None] * len(rows[0]))
    return spark.createDataFrame([*rows, nulls, rows[0], rows[0], (None, "an id is missing here", None, None, None, *rows[0][5:])], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)

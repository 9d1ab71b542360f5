import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, kept string, z string, pack int, got int, n int, bands int, at int, h int"


def table(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text[, lang]) with extra columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, "k", 1, "kept", "z", 1, 1, 1, 1, 1, 1) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "Delta", "über", "año", "漢字", "the", "of", "12", "x-y", "licence", "😀"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(30_000)
    base = [prose(60) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "two words"), (None, base[0]), (7, base[0]), (7, base[0]), (8, base[1]), (9, base[1] + " tail"), (10, long), (11, long), (12, "ab" * 3000)]
    rows += [(20 + i, b + "\n" + base[2] + "\n" + b.upper()) for i, b in enumerate(base)]
    rows += [(40, "!!! ??? ..."), (41, "Licensed under CC BY-NC 4.0.\nAll rights reserved\n" + base[3]), (42, "line one here\nline two here\nline three\nline four\n\nline one here\nline two here\nline three\nline four"), (43, "line one here\nline two here\nline three\nline four")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def rows(documents):
    return [tuple(r) for r in documents.collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and blank texts, one very long text, ties, repeated rows, columns that clash."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, some = text(40_000), text(200)
    rows = [
        (1, None, "en", None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, "a", 4),
        (4, long, "en", "a", len(long)),
        (5, some, "de", "b", len(some)),
        (6, some, "de", "b", len(some)),
        (6, some, "de", "b", len(some)),
        (6, some + " end", "de", "b", len(some)),
        (7, "1234 !!! 5678", "en", "a", 13),
        (None, some, "fr", "c", 1),
        (None, None, None, None, None),
        (9, "\x1c\x1d    x́ <|endoftext|> ᄀ￿ 𝒳𝒴", "en", "a", 9),
        *((k, text(k % 7), "en", "d", 3) for k in range(20, 40)),
    ]
    # names that the operators use inside
    clash = "fp long, key long, part long, body string, node long, id long, spans string, items string, score double, root long, line string, x double, `_doc` long, pos int"
    return spark.createDataFrame([(*r, *(7, 7, 7, "b", 7, 7, "s", "i", 0.5, 7, "l", 1.0, 7, 7)) for r in rows], f"{COLUMNS}, {clash}")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)

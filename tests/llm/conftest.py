import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["_key", "spans", "bucket", "fp", "_hit", "_score", "_head", "_turn", "score", "hits", "words", "component_id", "findings", "items", "length", "_label"]


def sentence(rnd, n, words):
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rnd = random.Random(5)
    words = [a + b + c for a in "bcdf" for b in "aeiou" for c in ("n", "st", "ré", "K")]
    long = sentence(rnd, 60_000, words)
    base = sentence(rnd, 120, words)
    texts = [None, "", "   \n\t", "one", "One TWO three", base, base, base + " tail", "".join(c.upper() if c.isascii() else c for c in base), long, "x" * 200_000, "é ñ ß 　 \xa0 ü", "a\x00b \x1f c", 'password = "abcDEF123456"', "Released under the MIT License."]
    rows = [(k, t, "en", "src0", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[0], (None, base, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some(spark):
    """A small table with texts of a few hundred words, copies and near copies."""
    rnd = random.Random(9)
    words = [a + b + c for a in "bcdfgh" for b in "aeiou" for c in ("n", "st", "l", "mo")]
    rows = []
    for k in range(120):
        if k % 10 == 7:
            text = rows[rnd.randrange(len(rows))][1]
        elif k % 10 == 8:
            parts = rows[rnd.randrange(len(rows))][1].split(" ")
            at = rnd.randrange(len(parts))
            text = " ".join([*parts[:at], "changed", *parts[at + 1 :]])
        elif k % 10 == 9:
            cut = rows[0][1].split(" ")[:70]
            text = " ".join([sentence(rnd, 40, words), *cut, sentence(rnd, 30, words)])
        else:
            text = sentence(rnd, rnd.randrange(1, 400), words) + "."
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
    return spark.createDataFrame(rows, SCHEMA).cache()

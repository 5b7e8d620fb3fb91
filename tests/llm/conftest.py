import random

import pytest
from pyspark.sql import types as T

# names that operators use inside; as columns of the input they must come through unharmed
CLASHING = ["row", "id", "digest", "length", "score", "ids", "group", "copies", "key", "component_id", "print",
            "keep_id", "_bit0", "_word1", "_mask0", "maybe_repeated", "gone", "times", "a.b"]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(name, T.StringType()) for name in CLASHING],
])


def words(rng, count):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8))) for _ in range(count))


def messy_rows():
    """Nulls everywhere, empty and very long texts, ties, copies, near copies, repeated rows."""
    rng = random.Random(7)
    passage, base = words(rng, 70), words(rng, 120)
    texts = [None, "", " \t\r\n", "a", "A b", "é😀 ü", words(rng, 30_000), base, base, base + " ", base.replace(" ", "  ", 1),
             base.upper(), base.rsplit(" ", 1)[0] + " other", words(rng, 40) + " " + passage + " " + words(rng, 30),
             words(rng, 25) + " " + passage + " " + words(rng, 50), passage, "x" * 300, "x" * 301, "ab" * 200,
             "En En En En En En En En", "<|endoftext|> a  b \n c", "\x00\x1c\x85 \u3000z"]
    texts += [words(rng, rng.randrange(1, 60)) for _ in range(25)]
    rows = [(number, text, "en", f"s{number % 3}" if number % 7 else None, len(text or "")) for number, text in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base, None, "s1", None), (None, None, None, None, None), (3, "another text", None, "", 1)]
    rng.shuffle(rows)
    return [(*row, *(f"{name}{number}" for name in CLASHING)) for number, row in enumerate(rows)]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make_words():
    return words

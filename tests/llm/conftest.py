import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
BASE = "/root/testdata/sf0.001"


def documents(spark, rows, extra=()):
    """A table of documents from (doc_id, text); ``extra`` names further columns holding junk."""
    data = [(i, t, "en", "s", len(t or ""), *["x"] * len(extra)) for i, t in rows]
    schema = T.StructType(DOCS.fields + [T.StructField(c, T.StringType()) for c in extra])
    return spark.createDataFrame(data, schema)


def odd_texts():
    """Nulls, blanks, repeated and long texts, near copies, foreign letters, broken ids."""
    rng = random.Random(7)
    vocabulary = [
        "".join(rng.choice("abcdeéüßñоюt'’.,!#%&|<>0123") for _ in range(rng.randint(1, 9))) for _ in range(400)
    ]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, other = prose(120), prose(90)
    near = prose(200).split(" ")
    texts = [None, "", " \t\n", "One", "one two", "a b c d", "Ünïcode İstanbul Σίσυφος éa b c\x1cd"]
    texts += [prose(60), prose(60), "x" * 1500, "ab" * 900, "la la la " * 300, "\n".join(["same line here"] * 90)]
    texts += [passage + " " + prose(40), prose(30) + " " + passage, prose(10) + passage + prose(5) + "\n" + passage]
    texts += [other + prose(20)] * 3 + [prose(50).upper() + other, prose(4000), passage.upper()]
    for k in range(6):
        copy = list(near)
        copy[k * 30] = "changed"
        texts.append(" ".join(copy))
    texts += ["<|endoftext|> x<|startoftext|>y don't WE'LL It's 123 ... $$%", "a​b ﻿ tab\tend", "🙂🙂 日本語 text"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def odd(spark):
    rows = odd_texts()
    return [*rows, rows[7], rows[19], (None, rows[8][1]), (None, "null id " * 70), (3, "another text under id three")]

"""Rows with nulls, empty and very long texts, ties and repeats, and columns named like those of the operators."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns beside doc_id and text, named as operators name their own.
CLASHING = ["score", "k1", "k2", "row", "part", "halo", "id", "tie", "bucket", "ids", "n_words", "mix", "turn", "null", "t1", "t2", "key", "pos", "__text", "node", "class_id", "n_tokens"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])


def awkward_rows():
    rng = random.Random(11)
    words = lambda n, v=60: " ".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdklmnrst") + str(rng.randrange(v)) for _ in range(n))
    passage, base = words(45), words(200)
    near = base.split()
    near[20], near[120] = "changed", "again"
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, base),
        (5, base),
        (5, base),  # a repeated row
        (6, " ".join(near)),
        (7, words(30) + "\n" + passage + "\n" + words(30)),
        (8, words(10) + " " + passage + " " + words(50)),
        (9, "Größe naïve ñandú 東京 😀 Ω²½ it's we'll 12345 #*$"),
        (10, words(40_000, 10_000)),  # very long
        (11, "a " * 300),
        (None, words(80)),
        (None, None),
        (12, words(80)),
        (12, words(80)),  # one key, two texts
        (13, "x"),
        (14, "..."),
        (15, "the\x0bend\x0cof\rlines  here"),
    ]
    return rows


def pairs(df, text="text"):
    return [(r.doc_id, r[text]) for r in df.select("doc_id", F.col(text)).collect()]

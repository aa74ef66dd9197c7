import random

import pytest
from pyspark.sql import types as T

#: Columns whose names the operators use inside.
CLASHING = "id text2 fp key words kept score t u v node root line row pos n at component label hits hit ids decoded html_ wrapper host span near order grams __x".split()


@pytest.fixture(scope="session")
def messy(spark):
    """Texts that are null, empty, blank, very long, repeated and alike; null and repeated ids; columns with the operators' own names."""
    rng = random.Random(5)
    words = ["the", "of", "anble", "tion", "heou", "ring", "wh", "est", "ner", "lyst"]
    long = " ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(30_000))
    plain = "\n".join(" ".join(rng.choice(words) + rng.choice(words) for _ in range(12)) + "." for _ in range(8))
    texts = [None, "", " \t\n", "word", "1234 !!", long, plain, plain, plain.replace("anble", "anbla", 1), "é ü ☃ 日本 ▁x\U0001f600", "a\x00b", "\n\n\n", "x" * 5000, plain + "\nlast line with some words in it."]
    rows = [(k, x) for k, x in enumerate(texts)] + [(6, plain), (6, "another text under an id that was there before."), (None, "text of a document without an id, but with words."), (None, None)]
    extra = [T.StructField(c, T.StringType()) for c in CLASHING]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *extra])
    made = [(i, x, ("en", "de", "fr", None)[k % 4], "s", len(x or ""), *["z"] * len(extra)) for k, (i, x) in enumerate(rows)]
    return spark.createDataFrame(made, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)

import random

import pytest

WORDS = [a + b for a in ("th", "re", "on", "er", "ti", "al", "ou", "ne") for b in ("and", "ing", "est", "ly", "for", "ment", "os", "que")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n)).replace("\n ", "\n")


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, lang, source: prose, exact and near copies, chains of copies, nulls, empties, odd and long texts, repeated rows."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(5, 200)) for _ in range(60)]
    texts += texts[:5] + texts[:2]
    base = texts[10].split(" ")
    for i in range(25):  # near copies of each other's copies
        j = rng.randrange(len(base))
        base = [*base[:j], f"new{i}", *base[j + 1 :]]
        texts.append(" ".join(base))
    texts += [None, "", " \t\n", "a", "A b", "a B", "12 34 !!", "été ß中文 😀 naïve", "x<|endoftext|>y", "tabs\there  two  blanks\x1cfs", "nul\x00 byte", "word " * 3000, prose(rng, 5000)]
    langs = ["en", "fr", None]
    out = [(i, t, langs[i % 3] if t else None, f"s{i % 2}" if i % 7 else None) for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, "no id here at all", "en", "s0")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("key", "node", "shard", "n", "_g", "row", "score", "kept", "size"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df.repartition(3, "doc_id")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")

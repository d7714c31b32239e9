"""Word pieces of a text, by greedy longest match, for static token embeddings."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: A word of more symbols is unknown; unknown words are left out.
LONGEST = 100


def _cut(text: str) -> list[str]:
    """Lower case, accents off, control characters out, white space and punctuation (and CJK symbols) apart."""
    out = []
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn" or (kind[0] == "C" and c not in "\t\n\r"):
            continue
        alone = kind[0] == "P" or (c.isascii() and not c.isalnum() and not c.isspace()) or "一" <= c <= "鿿"
        out.append(f" {c} " if alone else " " if c.isspace() else c)
    return "".join(out).split()


def pieces(text: str | None, vocabulary: set[str]) -> list[str]:
    found = []
    for word in _cut(text or ""):
        at, got = 0, []
        while at < len(word) <= LONGEST:
            head = "##" if at else ""
            end = next((e for e in range(len(word), at, -1) if head + word[at:e] in vocabulary), None)
            if end is None:
                got = []
                break
            got.append(head + word[at:end])
            at = end
        found += got
    return found


def encoder(spark: SparkSession, vocabulary: list[str]) -> Callable[[Column], Column]:
    """A function from text to its pieces. The vocabulary (its size is the model's, not the data's) is broadcast once."""
    sent = spark.sparkContext.broadcast(frozenset(vocabulary))

    @F.pandas_udf(ArrayType(StringType()))
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pieces(t, sent.value))

    return encode
